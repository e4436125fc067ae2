"""The tables, views, checks and models a user asks for."""

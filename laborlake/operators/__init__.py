"""Relational building blocks shared by the table builds."""

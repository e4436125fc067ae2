"""Readers, writers, schemas and the run ledger."""

"""Registered queries: each library operator on the given tables, with SQL to check it."""


def registered() -> dict:
    """Name -> (query, checking SQL or None)."""
    from catalog import gold_queries, model_queries, storage_queries, table_queries, text_queries

    parts = (gold_queries, text_queries, table_queries, model_queries, storage_queries)
    return {name: pair for part in parts for name, pair in part.QUERIES.items()}

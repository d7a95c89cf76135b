from velocis.sources.tables import read_table, transactions_from_events, requests_from_transactions  # noqa: F401

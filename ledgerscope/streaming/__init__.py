"""Incremental jobs over the ledger's log, as Structured Streaming."""

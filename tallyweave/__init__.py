"""Invoice-to-ledger reconciliation as Spark DataFrame operations."""

"""Log-first governed analytics on PySpark: every table is a view of an append-only event log."""

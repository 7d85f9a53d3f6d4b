"""Set-at-a-time event-log analytics on PySpark."""

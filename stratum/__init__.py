"""An analytics engine on Spark: two-tier tables, a SQL gate, ingest and maintenance."""

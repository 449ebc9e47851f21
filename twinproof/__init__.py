"""Table parity, ordered change apply and replication monitoring as Spark jobs."""

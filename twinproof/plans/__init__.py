"""The registered workload: each operator over the given tables, with its SQL twin."""

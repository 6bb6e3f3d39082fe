"""Evidence analytics on Spark: deterministic DataFrame operators over software-change evidence."""

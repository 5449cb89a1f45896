"""docloom: a Spark-first engine for grounded document records."""

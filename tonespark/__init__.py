"""Signal analytics on Spark: recordings as long tables, operators as plans."""

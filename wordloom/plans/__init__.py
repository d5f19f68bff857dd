"""The query catalogue: Spark plans and the SQL they must equal."""

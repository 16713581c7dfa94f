"""casework: court-case text analytics expressed as Spark DataFrame jobs."""

"""Strategy-research analytics over daily bars, expressed as Spark jobs."""

"""Market-microstructure monitoring as Spark DataFrame jobs."""

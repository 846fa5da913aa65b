"""City-scale map analytics as PySpark DataFrame jobs."""

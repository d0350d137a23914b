"""Finance and commerce-accounting analytics as Spark DataFrame jobs."""

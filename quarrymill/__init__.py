"""Data quality, matching and review of company and product records, as Spark DataFrame jobs."""

"""Order-profitability analytics as Spark DataFrame jobs."""

"""Place metrics: local-market, plan-finance and funding analytics as Spark jobs."""

"""Analytics over daily price bars, supply reports, filings and fundamentals as Spark DataFrame jobs."""

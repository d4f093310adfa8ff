"""sparkloom: an analytics library made of DataFrame, SQL and Structured Streaming jobs."""

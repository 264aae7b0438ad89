"""Risk analytics for AI-agent payment sessions, written as Spark DataFrame jobs."""

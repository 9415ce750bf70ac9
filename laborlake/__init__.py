"""laborlake — job-market analytics as Spark DataFrame / SQL / MLlib / Structured
Streaming jobs."""
__version__ = "0.1.0"

"""talkgrid: timed-transcript analytics expressed as Spark DataFrame operations."""

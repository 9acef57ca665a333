"""Text-sentiment analytics and monitoring as lazy Spark plans."""

"""Consumer-lag analytics for message logs, written as Spark DataFrame programs."""

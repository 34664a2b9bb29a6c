"""loomlog: event-log analytics and data processing on Spark DataFrames."""

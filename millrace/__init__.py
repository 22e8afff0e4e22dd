"""millrace: a Spark-native analytics engine for turn-based game records and similar event data."""

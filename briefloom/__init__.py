"""Spark-native operators for a daily market-news briefing."""

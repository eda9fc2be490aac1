"""Spark-native analytics for a booking marketplace: staging, star schema, marts, table operations and analytical queries."""

"""Analytics for sensor-monitoring networks and text corpora, written for Spark."""

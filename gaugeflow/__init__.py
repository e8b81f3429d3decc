"""gaugeflow: Spark-native auditing, deduplication, splitting and evaluation of annotated datasets."""

"""Redaction-layout analytics on Spark: DataFrame in, DataFrame out."""

"""Tidewell: a Spark-first engine for job-posting pipelines and their text corpora."""

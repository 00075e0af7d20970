"""Judging and curating the outputs of log-analysis models, as Spark DataFrame jobs."""

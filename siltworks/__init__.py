"""siltworks: Spark-first curation, scoring and reporting of instruction, code and trace data."""

__version__ = "0.1.0"

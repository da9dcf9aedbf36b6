"""Table protection jobs on Spark: masking, redaction, chunking, lineage, retention, fleet health."""

__version__ = "0.1.0"

"""Row-level expressions: columns built from Spark's own functions."""

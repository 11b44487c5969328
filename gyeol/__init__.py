"""A Spark-first engine for document corpora: quality, versioning, chunking, retrieval and evaluation."""

__version__ = "0.1.0"

"""Spark jobs for document ingestion, chunking, retrieval, evaluation and corpus preparation."""

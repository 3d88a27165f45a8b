"""Crawl-frontier, document-index and search analytics as Spark DataFrame jobs."""

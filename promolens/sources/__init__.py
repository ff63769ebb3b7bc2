"""Crawled pages to offer rows, and stored tables."""

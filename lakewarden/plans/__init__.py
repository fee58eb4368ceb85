"""Whole tasks put together from operators: question templates, governed queries, ingestion runs."""

"""Readers and writers: raw files, catalog tables, the column contract, audit tables."""

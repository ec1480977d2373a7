"""Scholarly-document analytics on Spark: pages to chunks, metadata, outlines, tables, references, graphs, exports and retrieval."""

"""Chunk codecs, filters and column expressions."""

"""Readers and writers of segments, pixels, catalogues, file indexes and granules."""

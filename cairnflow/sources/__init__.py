"""Readers and writers: JSON lines, Parquet, provenance, contracts and manifests."""

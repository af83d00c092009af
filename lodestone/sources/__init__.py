"""Readers and writers: pages, text pages, markdown, manifests, golden sets and ingest."""

"""Streaming forms of the decrypt job."""

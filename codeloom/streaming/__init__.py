"""Structured Streaming entry of the (stateless) preparation job."""

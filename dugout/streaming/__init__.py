"""Structured Streaming refresh of live days."""

"""Structured Streaming over the run log (an extension; the batch forms are in operators)."""

"""Structured Streaming with frozen models; an extension."""

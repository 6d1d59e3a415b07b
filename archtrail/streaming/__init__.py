"""Structured Streaming: live activity logs."""

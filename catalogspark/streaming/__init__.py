"""Streaming operators over the request log; each has a batch twin with the same result."""

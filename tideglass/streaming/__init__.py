"""Structured Streaming: the live tick, its feed and its throttles."""

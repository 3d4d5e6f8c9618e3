"""Readers of captured payloads and of the live interfaces."""

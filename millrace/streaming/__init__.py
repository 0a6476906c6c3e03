"""Structured Streaming jobs that drain what is there and stop, and pick up later where they left."""

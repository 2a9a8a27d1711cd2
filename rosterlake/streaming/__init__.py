"""Structured Streaming jobs that keep the warehouse tables up to date."""

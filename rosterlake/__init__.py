"""Workforce analytics and dimensional-warehouse jobs for Spark."""

__all__ = ["functions", "operators", "plans", "registry", "sources", "streaming"]

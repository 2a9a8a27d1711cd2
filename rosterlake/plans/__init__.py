"""Whole jobs: current-state loads, star loads, synthesis and analytics."""

"""Whole jobs and the registered query catalogue with its SQL."""

"""Whole jobs: the query catalogue and the command line."""

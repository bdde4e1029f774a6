"""Whole runs: configuration, the extraction pipeline, registered queries."""

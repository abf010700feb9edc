"""Pipelines, reports and the command line."""

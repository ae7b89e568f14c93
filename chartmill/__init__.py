"""Curation of generated document datasets and scoring of structured extraction, on Spark."""

"""Batch jobs: ingestion into the warehouse and the analysis marts."""

"""Posting intelligence and corpus preparation as Spark jobs."""

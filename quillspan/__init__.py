"""Recorded HTTP traffic turned into API descriptions, as Spark jobs."""

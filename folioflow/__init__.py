"""Narration text preparation and listening analytics as Spark jobs."""

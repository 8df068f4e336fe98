"""Surveillance-panel analytics and corpus operators expressed as Spark jobs."""

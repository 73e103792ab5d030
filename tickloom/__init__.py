"""Tickloom: activity-capture analytics as Spark jobs."""

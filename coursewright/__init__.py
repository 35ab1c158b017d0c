"""Lesson-content analytics as Spark jobs."""

"""Booking analytics as Spark jobs."""

"""Spark-first engine for building and auditing policy-conditioned moderation data."""

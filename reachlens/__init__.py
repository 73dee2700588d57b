"""Audience-affinity analytics on Spark: weekly roll-ups, affinity, insights, report scope and a news archive."""

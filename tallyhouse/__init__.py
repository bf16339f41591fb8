"""Tallyhouse: counting anonymous poll votes on Spark, in batch and in streams."""

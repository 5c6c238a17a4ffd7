"""Reaction analytics on Spark: per-person and per-task signals from observation tables, and one wide row per recording."""

"""Operators on DataFrames. Column names that begin with two underscores are theirs to use and must not occur in their inputs."""

"""Scalar expressions: text rules, geometry and scores."""

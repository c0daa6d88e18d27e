"""Scalar expressions that operators and queries share."""

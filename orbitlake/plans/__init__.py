"""Whole questions assembled from the operators."""

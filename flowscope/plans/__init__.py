"""Composed analyses: feature tables and detections made from the operators."""

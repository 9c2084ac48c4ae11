"""Requirement validation and traceability over many building models, on Spark."""

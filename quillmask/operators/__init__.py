"""Operators on DataFrames: detection, redaction, residual scans and reports."""

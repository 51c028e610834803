"""Placement of work: spreading small inputs and storing intermediate results."""

"""Wiring of the operators into the domain tables."""

"""Whole-step jobs composed from the operators."""

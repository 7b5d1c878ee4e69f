"""Whole experiments chained from the operators."""

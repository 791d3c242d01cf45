"""Operators for preparing training data: one module for each, and their registered queries."""

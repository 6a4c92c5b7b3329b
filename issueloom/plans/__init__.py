"""Whole queries composed from the operators, and the bindings of the test tables."""

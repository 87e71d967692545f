"""Operators for preparing training data, each independent of the read-analysis side of the library."""

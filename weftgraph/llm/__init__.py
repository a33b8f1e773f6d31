"""Operators for training data, one module for each problem; nothing else in the package imports this one."""

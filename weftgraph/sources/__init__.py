"""Readers and writers of source trees, slices, labels and graphs."""

"""Operators on ORC files: a reader of files and stripes, and column decoding by hand."""

"""Relational operators over elements, files and frames."""

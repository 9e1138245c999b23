"""Relational operators over findings, graphs, versions and lines."""

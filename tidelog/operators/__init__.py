"""Operators over versions: pages, differences, definitions, objects, checks."""

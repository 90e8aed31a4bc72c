"""Scalar expressions: canonical text, hashes, identifiers, literals, statements."""

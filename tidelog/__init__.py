"""Versioned tables on Spark: canonical hashes, manifests, differences, time travel and checks, as DataFrames."""

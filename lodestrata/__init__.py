"""Lodestrata: speaker-attributed transcripts, voice identities and their reports as Spark DataFrames."""

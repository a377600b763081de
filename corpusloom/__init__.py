"""Corpus and conversation analytics on Spark."""

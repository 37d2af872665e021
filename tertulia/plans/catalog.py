"""Imports every query module so the registry is complete."""

from . import classification_run, corpus_queries, model_queries, profile_queries, text_queries  # noqa: F401

"""Readers of conversation records, checkpoints and evaluation sets."""

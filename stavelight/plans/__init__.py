"""Vocabularies, encoders, grammars and generation plans."""

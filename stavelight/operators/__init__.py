"""Operators over the music tables."""

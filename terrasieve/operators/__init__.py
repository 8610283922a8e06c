"""Operators on tables of pixels, windows and scenes."""

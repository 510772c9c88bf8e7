"""Readers and writers over files: elevation tiles, map features, weather, gazetteers, saved plans."""

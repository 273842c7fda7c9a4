"""Scans of text cues, playlists, sheets, tags and uncompressed media."""

"""Timed media, packets and text cues as DataFrames."""

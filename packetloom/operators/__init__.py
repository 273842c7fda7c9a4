"""Operators on packets, indices, cues and segments: DataFrame to DataFrame."""

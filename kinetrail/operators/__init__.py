"""Operators on tracks, detections and tables, as DataFrame to DataFrame functions."""

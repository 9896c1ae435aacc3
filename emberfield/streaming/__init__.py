"""Structured Streaming jobs for detections that keep arriving."""

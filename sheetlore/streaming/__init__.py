"""Structured Streaming ingestion of detections."""

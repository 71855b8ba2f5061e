"""Spark-native operators for text detections taken from scanned map sheets."""

from sheetlore.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]

"""Source-audit analytics expressed as Spark DataFrame and Structured Streaming jobs."""

from sparkwarden.session import prepare, scratch_path

__all__ = ["prepare", "scratch_path"]

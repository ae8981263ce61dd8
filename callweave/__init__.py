"""Text-driven event research on Spark: transcripts to topics, themes, sentiment,
event studies and portfolio sorts, all expressed as DataFrame plans."""

from callweave.session import build_session

__all__ = ["build_session"]

"""Structured Streaming entry points (micro-batch scoring against a fitted index)."""

from lexiscope.streaming.scoring import QUERY_SCHEMA, rank_batch, score_query_stream

__all__ = ["QUERY_SCHEMA", "rank_batch", "score_query_stream"]

"""Operators of a training-data pipeline and their queries."""

from tidewatch.llm import context_trees, conversations, embedding_dedup, hard_negatives, mixing, near_dedup, packing, quality, sharding, spotsigs, token_counts, toxicity, warc
from tidewatch.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "context_trees", "conversations", "embedding_dedup", "hard_negatives", "mixing", "near_dedup", "packing", "quality", "sharding", "spotsigs", "token_counts", "toxicity", "warc"]

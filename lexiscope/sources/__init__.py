"""Readers and writers for collections, topics, judgments, pairs and vectors."""

from lexiscope.sources.readers import (
    clean_text, read_collection, read_json_array, read_labelled, read_pairs, read_qrels,
    read_rootless_collection, read_topics,
)
from lexiscope.sources.store import (
    corpus_digest, load_published_shards, load_shards, load_vectors, publish, published, save_shards, save_vectors,
    settings_digest, vector_path, write_shards_resumable,
)

__all__ = [
    "clean_text", "read_collection", "read_json_array", "read_labelled", "read_pairs",
    "read_qrels", "read_rootless_collection", "read_topics", "load_shards", "load_vectors",
    "save_shards", "save_vectors", "vector_path", "corpus_digest", "settings_digest", "publish", "published",
    "write_shards_resumable", "load_published_shards",
]

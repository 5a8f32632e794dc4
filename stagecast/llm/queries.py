"""All queries of this package."""

import corpus_pipeline
from stagecast.llm import (
    alignment,
    bpe,
    conversations,
    counts,
    embeddings,
    fingerprints,
    languages,
    mixing,
    quality,
    secrets,
    simhash,
    substrings,
    tokenfiles,
)
from stagecast.llm.common import REGISTRY

REGISTRY["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)

__all__ = [
    "REGISTRY",
    "alignment",
    "bpe",
    "conversations",
    "counts",
    "embeddings",
    "fingerprints",
    "languages",
    "mixing",
    "quality",
    "secrets",
    "simhash",
    "substrings",
    "tokenfiles",
]

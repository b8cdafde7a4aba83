"""What an installation chooses: which embeddings are there and which of their preparations."""

from __future__ import annotations

import json
from typing import NamedTuple

# What holds without a file of settings.
DEFAULTS = {"metrics": [], "embeddings": ["fasttext"], "fasttext": "wiki-news-300d-1M-subword.vec"}


class Settings(NamedTuple):
    metrics: list[str]
    embeddings: list[str]
    fasttext: str


def load(path: str | None = None) -> Settings:
    """A file replaces all defaults, so it must name every setting."""
    if path is None:
        return Settings(**DEFAULTS)
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if lacking := [k for k in DEFAULTS if k not in found]:
        raise KeyError(f"settings without {', '.join(lacking)}")
    return Settings(**{k: found[k] for k in DEFAULTS})

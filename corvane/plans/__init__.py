"""Whole queries, built from operators."""

from __future__ import annotations

import importlib

MODULES = ("texts", "retrieval", "metrics", "storage", "sessions", "pages", "helpers", "streams", "more", "dialogue", "answers", "tables", "curation", "bench", "corpus")


def load() -> None:
    """Registers the plans of all modules."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")

"""Splitters on one text, for Arrow functions: recursive, semantic."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from docflow.schema import SplitConfig

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def estimate_tokens(text: str) -> int:
    """As ``functions.text.token_count``."""
    return max(1, int(len(text.split()) * 1.3 + len(text) * 0.2))


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of a text; a separator stays with the part after it."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [x for x in (first, *(separator + r for r in rest)) if x]


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Chunks of at most ``size`` characters, split at the coarsest separator that does, with whole parts repeated up to ``overlap``."""
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), None)
    if at is None:
        return [x] if (x := text.strip()) else []
    out: list[str] = []
    held: list[str] = []
    length = 0

    def close() -> None:
        if chunk := "".join(held).strip():
            out.append(chunk)

    for piece in _pieces(text, separators[at]):
        if len(piece) > size:
            if held:
                close()
                held, length = [], 0
            out += recursive_split(piece, size, overlap, separators[at + 1 :])
            continue
        if held and length + len(piece) > size:
            close()
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if held:
        close()
    return out


def semantic_split(text: str, embed: Callable[[str], np.ndarray], percentile: float) -> list[str]:
    """Sentences, cut where the distance of neighbours exceeds a percentile of all distances."""
    sentences = [x for x in _SENTENCE.split(text) if x.strip()]
    if len(sentences) < 2:
        return [x] if (x := text.strip()) else []
    vectors = np.array([embed(x) for x in sentences], float)
    norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
    distances = 1 - (vectors[:-1] * vectors[1:]).sum(axis=1) / (norms[:-1] * norms[1:])
    breaks = np.flatnonzero(distances > np.percentile(distances, percentile)) + 1
    bounds = [0, *breaks.tolist(), len(sentences)]
    return [" ".join(sentences[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

"""Defaults for what lies outside this package: embedding, OCR, answer generation.

Each is a plain function on Python values that the operators call in Arrow
batches; any function of the same shape can take its place.
"""

from __future__ import annotations

import json
import zlib

import numpy as np


def hash_embedding(text: str, size: int = 64) -> np.ndarray:
    """A unit vector from the words of a text; equal texts have equal vectors."""
    out = np.zeros(size)
    for word in text.lower().split():
        h = zlib.crc32(word.encode())
        out[h % size] += 1.0 if h >> 16 & 1 else -1.0
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def hash_embeddings(texts: list[str]) -> np.ndarray:
    """``hash_embedding`` of each text, a row each."""
    return np.array([hash_embedding(x) for x in texts])


def no_ocr(image: bytes) -> str:
    """No engine here: a scanned page has no text."""
    return ""


def extractive_answer(context: str, question: str) -> str:
    """The first passage of the context as an answer, in the generator's JSON."""
    return json.dumps({"contextAnswer": context.split("\n\n---\n\n")[0], "additionalInfo": ""})

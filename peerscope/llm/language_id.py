"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point. An
n-gram binds its letters: the vectors are rotated by their place and multiplied.
A text is the bundle (sum) of its n-grams, a language the bundle of all its
training texts, and a text belongs to the prototype with the highest cosine.
N-grams are counted first, so each distinct one is bound once per slice.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any labelled row everything is ``und``; equal cosines go to the first
language in order. Rows that repeat are each scored. Long texts are counted in
slices, so memory does not grow with them beyond their own size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.texts import doc_texts, map_texts

DIMENSIONS = 512
GRAM = 3
UNKNOWN = "und"


@lru_cache(maxsize=4096)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The same random signs for a code point in every task."""
    return np.random.default_rng(code).integers(0, 2, dimensions).astype(np.int8) * 2 - 1


@lru_cache(maxsize=8)
def _classes() -> np.ndarray:
    """Per code point of the basic plane: its lower case, or 0 for what is no letter."""
    table = np.zeros(1 << 16, np.int32)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of n-grams that are packed 21 bits a letter."""
    out = np.ones((len(grams), dimensions), np.int8)
    for place in range(GRAM):
        codes = (grams >> (21 * (GRAM - 1 - place))) & 0x1FFFFF
        known, where = np.unique(codes, return_inverse=True)
        rotated = np.stack([np.roll(letter_vector(int(c), dimensions), GRAM - 1 - place) for c in known])
        out *= rotated[where]
    return out


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, and for each n-gram of the rows its index and its row.

    N-grams are packed 21 bits a letter, sorted, and do not cross rows.
    """
    whole = data[int(offsets[0]):int(offsets[-1])]
    # A 0 byte between rows is an edge, and marks where the next row begins.
    n = len(offsets) - 1
    buffer = np.zeros(len(whole) + n + 1, np.uint8)
    row_of = np.repeat(np.arange(1, n + 1), np.diff(offsets))
    row_of += np.arange(len(whole))
    buffer[row_of] = np.where(whole == 0, 32, whole)
    codes = np.frombuffer(buffer.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    row_of = np.cumsum(codes == 0, dtype=np.int32) - 1
    low = _classes()[np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        low[at] = int(codes[at]) if chr(codes[at]).isalpha() else 0
    keep = low != 0
    keep[1:] |= low[:-1] != 0
    keep[codes == 0] = True
    low, row_of = low[keep], row_of[keep]
    size = len(low) - GRAM + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    same = (row_of[:size] == row_of[GRAM - 1:]) | (low[GRAM - 1:] == 0)
    good = np.flatnonzero(same & (low[1:size + 1] != 0))
    row = row_of[good]
    # Few letters occur, so n-grams of letter numbers are counted without a sort.
    present = np.zeros(int(low.max()) + 1, bool)
    present[low] = True
    alphabet = np.flatnonzero(present)
    number = (np.cumsum(present) - 1)[low]
    packed = np.zeros(len(good), np.int64)
    for j in range(GRAM):
        packed = packed * len(alphabet) + number[good + j]
    if len(alphabet) ** GRAM <= 1 << 22:
        seen = np.zeros(len(alphabet) ** GRAM, bool)
        seen[packed] = True
        known, where = np.flatnonzero(seen), (np.cumsum(seen) - 1)[packed]
    else:
        known, where = np.unique(packed, return_inverse=True)
    full = np.zeros(len(known), np.int64)
    for j in range(GRAM):
        full = (full << 21) | alphabet[(known // len(alphabet) ** (GRAM - 1 - j)) % len(alphabet)]
    return full, where, row


def _has_letter(grams_rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(grams_rows, minlength=n) > 0


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(lang, bundle)``: the summed vectors of every labelled text, summed in the tasks first."""
    def bundle(rows, data, offsets):
        langs = rows.column("lang").to_pylist()
        names, index = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
        known, where, row = text_grams(data, offsets)
        if not len(known):
            return None
        counts = np.bincount(index[row] * len(known) + where, minlength=len(names) * len(known)).reshape(len(names), -1)
        total = _matmul(counts, known, dimensions)
        lang = np.repeat(names, dimensions)
        return {"lang": pa.array(list(lang)), "dim": np.tile(np.arange(dimensions), len(names)), "value": total.ravel().astype(np.float64)}

    rows = doc_texts(labelled, "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    return (
        map_texts(rows, bundle, "lang string, dim bigint, value double")
        .groupBy("lang", "dim").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("bundle"))
    )


class _Bound:
    """Bound vectors met so far in this process, at most ``limit`` of them."""

    def __init__(self, dimensions: int, limit: int = 16384):
        self.grams = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, dimensions), np.float32)
        self.limit = limit

    def get(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct n-grams."""
        dimensions = self.vectors.shape[1]
        new = grams[~np.isin(grams, self.grams, assume_unique=True)]
        if len(new) and len(self.grams) + len(new) <= self.limit:
            merged = np.concatenate([self.grams, new])
            order = np.argsort(merged)
            self.vectors = np.concatenate([self.vectors, gram_vectors(new, dimensions).astype(np.float32)])[order]
            self.grams, new = merged[order], new[:0]
        if not len(new):
            return self.vectors[np.searchsorted(self.grams, grams)]
        out = np.empty((len(grams), dimensions), np.float32)
        fresh = np.isin(grams, new, assume_unique=True)
        out[fresh] = gram_vectors(new, dimensions)
        out[~fresh] = self.vectors[np.searchsorted(self.grams, grams[~fresh])]
        return out


@lru_cache(maxsize=2)
def _bound(dimensions: int) -> _Bound:
    return _Bound(dimensions)


def _matmul(counts: np.ndarray, grams: np.ndarray, dimensions: int, step: int = 8192) -> np.ndarray:
    """``counts @ vectors``, binding some n-grams at a time."""
    total = np.zeros((len(counts), dimensions), np.float32)
    for first in range(0, len(grams), step):
        part = slice(first, first + step)
        total += counts[:, part].astype(np.float32) @ _bound(dimensions).get(grams[part])
    return total


def identify(docs: DataFrame, learned: DataFrame, dimensions: int = DIMENSIONS, rows_at_once: int = 256) -> DataFrame:
    """``(doc_id, lang_pred, score)``; the score is the cosine with the prototype, not below 0.

    ``learned`` has a row per language, which is what the driver reads.
    """
    model = sorted((r["lang"], r["bundle"]) for r in learned.collect())
    langs = [m[0] for m in model]
    matrix = np.array([m[1] for m in model], np.float64).reshape(len(model), dimensions)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12) if len(model) else 1
    matrix = matrix.astype(np.float32)

    def predict(rows, data, offsets):
        n = len(offsets) - 1
        known, where, row = text_grams(data, offsets)
        best, score = np.full(n, -1), np.zeros(n)
        if len(known) and len(langs):
            for first in range(0, n, rows_at_once):
                after = min(first + rows_at_once, n)
                a, b = np.searchsorted(row, [first, after])
                if a == b:
                    continue
                counts = np.bincount((row[a:b] - first) * len(known) + where[a:b], minlength=(after - first) * len(known))
                bundle = _matmul(counts.reshape(after - first, -1), known, dimensions)
                norm = np.linalg.norm(bundle, axis=1)
                cosine = bundle @ matrix.T / np.maximum(norm, 1e-12)[:, None]
                top = np.argmax(cosine, axis=1)
                some = norm > 0
                best[first:after] = np.where(some, top, 0)
                score[first:after] = np.where(some, cosine[np.arange(after - first), top], 0)
            best[~_has_letter(row, n)] = -1
        names = np.array([*langs, UNKNOWN], dtype=object)
        score[best < 0] = 0
        return {"doc_id": rows.column("doc_id"), "lang_pred": pa.array(list(names[best])), "score": np.clip(score.astype(np.float64), 0, 1)}

    return map_texts(doc_texts(docs), predict, "doc_id bigint, lang_pred string, score double")

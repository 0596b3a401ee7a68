"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the whole table in the order of ``doc_id``, its index a table
of anchored seeds (``repeats``) whose hash blocks lie on different tasks. Every
document looks its seeds up in each block that can hold them and learns their
earliest place. It is then parsed greedily: at each position the match that
reaches furthest becomes a factor ``(start, length, source, source_start)``.
Matches have at least ``window`` words. A factor may begin inside a match that
straddles the end of the one before; that boundary is kept as part of the match,
so exactly the words inside earlier-seen windows are in factors.

Seeds whose block holds different neighbourhoods are compared window by window
in a second, smaller round before the parse.

Defined cases: null, empty and shorter texts have no window and stay whole; rows
that repeat a ``doc_id`` are one document and each get its row; of equal texts
the lowest ``doc_id`` stays; a null ``doc_id`` sorts first. Texts may have any
length: what a task holds follows its longest single text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerscope.llm.hashing import Words, mix, prefix_hashes, span_hashes
from peerscope.llm.repeats import MATCHED, by_document, find_runs, unpack
from peerscope.llm.texts import doc_texts, flat_structs, map_texts, public_id, struct_lists

WINDOW = 20
GRAM = 6

OPEN_WINDOWS = (
    "doc_id bigint, start bigint, settled boolean, anchor bigint, hash bigint, source bigint, source_start bigint"
)
FACTORS = "array<struct<start:bigint,length:bigint,source:bigint,source_start:bigint>>"


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offsets)
    return words.hashes, words.bounds


def join_matches(row, start, end, source, source_start):
    """Overlapping matches on one diagonal of one source become one match."""
    if not len(row):
        return row, start, end, source, source_start
    shift = source_start - start
    order = np.lexsort((start, shift, source, row))
    row, start, end, source, shift = row[order], start[order], end[order], source[order], shift[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])
    group = np.cumsum(new) - 1
    span = int(end.max(initial=0)) + 1
    furthest = np.maximum.accumulate(end + group * span) - group * span
    new[1:] |= start[1:] > furthest[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    return row[head], start[head], furthest[last], source[head], start[head] + shift[head]


def parse(start, end, source, source_start) -> list[tuple[int, int, int, int]]:
    """Greedy factors of one document from its matches."""
    order = np.argsort(start, kind="stable")
    matches = list(zip(start[order].tolist(), end[order].tolist(), source[order].tolist(), source_start[order].tolist(), strict=True))
    factors, i, position, best = [], 0, 0, None
    while i < len(matches) or best is not None:
        while i < len(matches) and matches[i][0] <= position:
            if best is None or matches[i][1] > best[1]:
                best = matches[i]
            i += 1
        if best is not None and best[1] > position:
            factors.append((position, best[1] - position, best[2], best[3] + position - best[0]))
            position, best = best[1], best
        elif i < len(matches):
            position, best = matches[i][0], None  # literal words up to the next match
        else:
            break
    return factors


def _factor_rows(words: Words, matches) -> tuple[list, np.ndarray]:
    """Factors per row, and which words they cover: those are removed."""
    n = len(words.offsets) - 1
    row, start, end, source, source_start = join_matches(*matches)
    factors: list[list] = [[] for _ in range(n)]
    covered = np.zeros(len(words.start) + 1, np.int64)
    edges = np.searchsorted(row, np.arange(n + 1))
    for r in np.unique(row):
        own = slice(edges[r], edges[r + 1])
        factors[r] = parse(start[own], end[own], source[own], source_start[own])
        place = np.array([f[:2] for f in factors[r]], np.int64) + [words.bounds[r], 0]
        # Factors do not overlap, but one may begin where another ends.
        np.add.at(covered, place[:, 0], 1)
        np.add.at(covered, place.sum(axis=1), -1)
    return factors, np.cumsum(covered)[:-1] > 0


def kept_texts(words: Words, removed: np.ndarray) -> list[bytes]:
    """Kept words of each row, joined by one space."""
    keep = ~removed
    start, end = words.start[keep], words.end[keep]
    # One byte before each word holds the space.
    sizes = end - start + 1
    after = np.cumsum(sizes)
    out = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    at = np.arange(len(out)) - np.repeat(after - sizes, sizes)
    inside = at > 0
    out[inside] = words.data[(np.repeat(start, sizes) + at - 1)[inside]]
    words_kept = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
    edge = np.concatenate([[0], after])[words_kept]
    whole = out.tobytes()
    return [whole[edge[i] + 1:edge[i + 1]] if edge[i + 1] > edge[i] else b"" for i in range(len(edge) - 1)]


def factor_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, rows: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, factors)``; with ``rows`` also ``kept_text`` and the caller's ``row``.

    ``kept_text`` is the text as it was where nothing is removed.
    """
    texts = doc_texts(docs, rows=rows)
    # Both rounds join the texts with their runs alike, so Spark shuffles them once.
    seeded = texts.join(by_document(find_runs(doc_texts(docs), word_units, window, gram)), "doc_id", "left")
    place = Window.partitionBy("settled", "anchor", "hash").orderBy("doc_id", "start")
    more = (
        map_texts(seeded, _open_windows(window), OPEN_WINDOWS)
        .withColumns({
            "source": F.coalesce("source", F.first("doc_id").over(place)),
            "source_start": F.coalesce("source_start", F.first("start").over(place)),
        })
        .filter("doc_id != source OR start != source_start")
        .groupBy("doc_id").agg(F.collect_list(F.struct("start", "source", "source_start")).alias("more"))
    )
    base = f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, factors {FACTORS}"
    own = [T.StructField("kept_text", T.StringType()), texts.schema["row"]] if rows else []
    schema = T.StructType([*T.StructType.fromDDL(base).fields, *own])
    return map_texts(seeded.join(more, "doc_id", "left"), _finisher(window, rows), schema).withColumn("doc_id", public_id())


def _result(rows, words: Words, factors: list, removed: np.ndarray, whole_rows: bool) -> dict:
    kept = kept_texts(words, removed)
    total = np.concatenate([[0], np.cumsum(removed)])
    out = {
        "doc_id": rows.column("doc_id"), "n_words": words.counts(), "n_removed": np.diff(total[words.bounds]),
        "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "factors": _struct_lists(factors),
    }
    if not whole_rows:
        return out
    touched = np.diff(total[words.bounds]) > 0
    texts = rows.column("text").to_pylist()
    texts = [k.decode("utf-8", "replace") if t else old for k, t, old in zip(kept, touched, texts, strict=True)]
    return out | {"kept_text": pa.array(texts, pa.string()), "row": rows.column("row")}


def _struct_lists(lists: list) -> pa.Array:
    flat = np.array([x for one in lists for x in one], np.int64).reshape(-1, 4)
    bounds = np.concatenate([[0], np.cumsum([len(one) for one in lists])])
    return struct_lists(bounds, start=flat[:, 0], length=flat[:, 1], source=flat[:, 2], source_start=flat[:, 3])


def _open_windows(window: int):
    """The windows of open runs, one by one; copies within a slice come with their source."""
    def list_windows(rows, data, offsets):
        row, runs = flat_structs(rows.column("runs"))
        open_run = runs["state"] != MATCHED
        if not open_run.any():
            return None
        words = Words(data, offsets)
        row, anchor = row[open_run], runs["anchor"][open_run]
        first, many, _ = unpack(runs["place"][open_run].astype(np.int64))
        start = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = words.bounds[np.repeat(row, many)] + start
        value = mix(span_hashes(prefix_hashes(words.hashes), at, at + window)).view(np.int64)
        doc, anchor = rows.column("doc_id").to_numpy()[np.repeat(row, many)], np.repeat(anchor, many).astype(np.int64)
        order = np.lexsort((start, doc, value, anchor))
        doc, start, anchor, value = doc[order], start[order], anchor[order], value[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (value[1:] != value[:-1])
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        late = (doc != doc[head]) | (start != start[head])
        keep = fresh | late
        # A settled window is spread by its own place.
        spread = mix(doc.view(np.uint64) + start.astype(np.uint64)).view(np.int64)
        return {
            "doc_id": doc[keep], "start": start[keep], "settled": late[keep], "anchor": np.where(late, spread, anchor)[keep],
            "hash": value[keep], "source": pa.array(doc[head][keep], mask=~late[keep]),
            "source_start": pa.array(start[head][keep], mask=~late[keep]),
        }

    return list_windows


def _finisher(window: int, whole_rows: bool):
    def finish(rows, data, offsets):
        words = Words(data, offsets)
        row, runs = flat_structs(rows.column("runs"))
        matched = runs["state"] == MATCHED
        start, windows, _ = unpack(runs["place"][matched].astype(np.int64))
        source_start, _, _ = unpack(runs["source_place"][matched].astype(np.int64))
        late, more = flat_structs(rows.column("more"))
        match = [
            np.concatenate([row[matched], late]), np.concatenate([start, more["start"]]).astype(np.int64),
            np.concatenate([start + windows + window - 1, more["start"] + window]).astype(np.int64),
            np.concatenate([runs["source"][matched], more["source"]]).astype(np.int64),
            np.concatenate([source_start, more["source_start"]]).astype(np.int64),
        ]
        factors, removed = _factor_rows(words, match)
        return _result(rows, words, factors, removed, whole_rows)

    return finish

"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark window (``window`` consecutive words; a shorter item is one
window) is a set of word shingles that a document has to contain whole, so its
prefix is a single shingle: the one that is rarest in the documents. Documents
probe only these prefix shingles. A hit is aligned by the shingle's place in
the window (position bound), must lie within the document (length bound), and
is then compared word by word.

The benchmark is taken in blocks of at most ``block_windows`` windows, each
shipped to the tasks with its size known; documents are never shuffled.

Defined cases: a null or empty text has no words; an item without words matches
nothing; items that repeat an id count once; a null item id is the empty
string; rows that repeat a ``doc_id`` each get a row; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.hashing import ALNUM, BASE, Words, gram_hashes, mix
from peerscope.llm.texts import arrow_lists, doc_texts, map_texts, public_id
from peerscope.session import materialize

WINDOW = 13
SHINGLE = 5
BLOCK_WINDOWS = 200_000


@dataclass
class Block:
    """Some benchmark windows: word hashes per window, zero beyond its length."""

    words: np.ndarray
    length: np.ndarray
    item: np.ndarray
    items: list[str]

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, gram length, window and offset of every shingle."""
        parts = []
        for size in np.unique(self.length):
            rows = np.flatnonzero(self.length == size)
            gram = min(int(size), SHINGLE)
            for offset in range(int(size) - gram + 1):
                run = self.words[rows, offset:offset + gram]
                value = run[:, 0].copy()
                for j in range(1, gram):
                    value = value * BASE + run[:, j]
                parts.append((mix(value), np.full(len(rows), gram), rows, np.full(len(rows), offset)))
        if not parts:
            empty = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), empty, empty, empty
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, words)`` for each distinct window of each item."""
    def cut(rows, data, offsets):
        words = Words(data, offsets, ALNUM, lower=True)
        ids, values, bounds = [], [], [0]
        for i, item in enumerate(rows.column("item_id").to_pylist()):
            own = words.hashes[words.bounds[i]:words.bounds[i + 1]]
            for start in range(max(len(own) - window + 1, min(len(own), 1))):
                part = own[start:start + window]
                ids.append(item)
                values.append(part)
                bounds.append(bounds[-1] + len(part))
        flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
        return {"item_id": pa.array(ids, pa.string()), "words": arrow_lists(flat.view(np.int64), np.array(bounds))}

    named = items.select(
        F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item_id"), items["text"].cast("string").alias("text")
    )
    return map_texts(named, cut, "item_id string, words array<bigint>").distinct()


def _blocks(items: DataFrame, window: int, block_windows: int) -> list[Block]:
    """The benchmark's windows, in parts of about ``block_windows``."""
    cut = materialize(item_windows(items, window), "windows")
    parts = -(-cut.count() // block_windows)
    blocks = []
    for part in range(parts):
        rows = cut.filter(F.pmod(F.hash("item_id", "words"), F.lit(parts)) == part).toArrow()
        lists = rows.column("words").combine_chunks()
        length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        words = np.zeros((len(length), window), np.uint64)
        words[np.arange(window) < length[:, None]] = lists.flatten().to_numpy().view(np.uint64)
        names, item = np.unique(np.array(rows.column("item_id").to_pylist(), dtype=object).astype(str), return_inverse=True)
        blocks.append(Block(words, length, item, list(names)))
    return blocks


def _rare_shingles(docs: DataFrame, block: Block) -> dict[int, tuple[np.ndarray, ...]]:
    """Per gram length: the rarest shingle of each window that any document can hold."""
    value, gram, window, offset = block.shingles()
    sizes = np.unique(gram)
    known = {int(g): np.unique(value[gram == g]) for g in sizes}

    def count(rows, data, offsets):
        words = Words(data, offsets, ALNUM, lower=True)
        grams, hashes, counts = [], [], []
        for g, wanted in known.items():
            found = gram_hashes(words.hashes, g)
            place = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
            seen, n = np.unique(place[wanted[place] == found], return_counts=True)
            grams.append(np.full(len(seen), g))
            hashes.append(wanted[seen].view(np.int64))
            counts.append(n)
        if not grams:
            return None
        return {"gram": np.concatenate(grams), "hash": np.concatenate(hashes), "n": np.concatenate(counts)}

    totals = (
        map_texts(docs, count, "gram bigint, hash bigint, n bigint").groupBy("gram", "hash").agg(F.sum("n").alias("n")).toArrow()
    )
    frequency = np.zeros(len(value), np.int64)
    for g in sizes:
        rows = totals.filter(pc.equal(totals["gram"], int(g)))
        seen = rows["hash"].to_numpy().view(np.uint64)
        order = np.argsort(seen)
        own = np.flatnonzero(gram == g)
        if len(seen):
            place = np.minimum(np.searchsorted(seen, value[own], sorter=order), len(seen) - 1)
            hit = seen[order][place] == value[own]
            frequency[own[hit]] = rows["n"].to_numpy()[order][place[hit]]
    order = np.lexsort((value, frequency, window))
    first = order[np.r_[True, window[order][1:] != window[order][:-1]]] if len(order) else order
    first = first[frequency[first] > 0]  # a shingle no document has rules its window out
    index = {}
    for g in np.unique(gram[first]):
        own = first[gram[first] == g]
        own = own[np.argsort(value[own], kind="stable")]
        index[int(g)] = (value[own], window[own], offset[own])
    return index


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``(doc_id, text, row, n_words, hits, items)``: word ranges within occurring windows, and whose they are.

    ``hits`` holds ``start, end`` of disjoint word ranges one after the other;
    ``row`` is the caller's row but for its text.
    """
    marked = doc_texts(docs, rows=True).withColumns({
        "n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>"),
    })
    schema = marked.schema
    blocks = _blocks(items, window, block_windows)
    empty = Block(np.zeros((0, window), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    for block in blocks or [empty]:
        index = _rare_shingles(doc_texts(docs), block) if len(block.length) else {}
        shipped = docs.sparkSession.sparkContext.broadcast((block.words, block.length, block.item, block.items, index))
        marked = map_texts(marked, _marker(shipped, window), schema)
    return marked


def _marker(shipped, window: int):
    def mark(rows, data, offsets):
        patterns, length, item, names, index = shipped.value
        words = Words(data, offsets, ALNUM, lower=True)
        row_of = words.rows()
        starts, found = [], []
        for gram, (values, windows, offset) in index.items():
            probe = gram_hashes(words.hashes, gram)
            low = np.searchsorted(values, probe, side="left")
            at = np.flatnonzero(low < len(values))
            at = at[values[low[at]] == probe[at]]
            many = np.searchsorted(values, probe[at], side="right") - low[at]
            entry = np.repeat(low[at], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            start, which = np.repeat(at, many) - offset[entry], windows[entry]
            end = start + length[which]
            inside = (start >= 0) & (end <= len(row_of))
            start, which, end = start[inside], which[inside], end[inside]
            inside = row_of[start] == row_of[end - 1]
            start, which = start[inside], which[inside]
            span = start[:, None] + np.arange(window)
            beyond = np.arange(window) >= length[which][:, None]
            same = beyond | (words.hashes[np.minimum(span, len(row_of) - 1)] == patterns[which])
            same = same.all(axis=1)
            starts.append(start[same])
            found.append(which[same])
        hits, owners = rows.column("hits"), rows.column("items")
        counts = words.counts()
        if any(len(s) for s in starts):
            start, which = np.concatenate(starts), np.concatenate(found)
            hits, owners = hits.to_pylist(), owners.to_pylist()
            owner_row = row_of[start]
            for row in np.unique(owner_row):
                own = np.flatnonzero(owner_row == row)
                base = words.bounds[row]
                covered = np.zeros(counts[row] + 2, np.int64)
                earlier = np.array(hits[row], np.int64).reshape(-1, 2)
                np.add.at(covered, np.concatenate([start[own] - base, earlier[:, 0]]), 1)
                np.add.at(covered, np.concatenate([start[own] + length[which[own]] - base, earlier[:, 1]]), -1)
                inside = (np.cumsum(covered) > 0).astype(np.int8)
                hits[row] = np.flatnonzero(np.diff(inside, prepend=0)).tolist()
                owners[row] = sorted({*owners[row], *(names[i] for i in np.unique(item[which[own]]))})
            hits, owners = pa.array(hits, pa.list_(pa.int64())), pa.array(owners, pa.list_(pa.string()))
        return {"doc_id": rows.column("doc_id"), "text": rows.column("text"), "row": rows.column("row"), "n_words": counts, "hits": hits, "items": owners}

    return mark


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document its words, hit words and benchmark items.

    ``contaminated`` needs a hit, and at least a twentieth of the words hit.
    """
    pairs = F.expr("aggregate(sequence(1, size(hits) div 2), 0L, (n, i) -> n + hits[2 * i - 1] - hits[2 * i - 2])")
    return find_items(docs, items, window, block_windows).select(
        public_id(), "row", "text", "n_words", F.when(F.size("hits") > 0, pairs).otherwise(F.lit(0)).cast("long").alias("n_hit"), "hits", "items",
    ).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))

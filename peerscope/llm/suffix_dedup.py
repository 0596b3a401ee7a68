"""Suffix-array dedup of bytes.

Texts are scanned for anchored runs (``repeats``), which settles whole copies.
The suffixes that are left, where texts share an anchor but not all around it,
go to the task of their anchor and are sorted there: a bottom-up mergesort that
compares two suffixes by the length of their common extension, found by binary
search over prefix polynomial hashes, and the byte after it. Equal neighbours
over ``window`` bytes are verified byte by byte, and all but the earliest of a
class are removed. Suffixes are compared over ``window`` bytes, since a longer
repeat is one in each of its windows.

Defined cases: null is empty; empty and shorter texts stay whole; rows that
repeat a ``doc_id`` are one document and each get their row; a null ``doc_id``
sorts first. Bytes are cut wherever a window ends, also inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.hashing import mix, powers_inverse, prefix_hashes, span_hashes
from peerscope.llm.repeats import HOT, MATCHED, by_document, find_runs, pack, unpack
from peerscope.llm.texts import doc_texts, flat_structs, map_texts, public_id, struct_lists

WINDOW = 100
GRAM = 32
#: Windows of one hash that a task holds before it drops those that it has found removed.
HELD_ROWS = 4096

SPANS = "array<struct<start:bigint,end:bigint>>"


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data[int(offsets[0]):int(offsets[-1])], offsets - offsets[0]


class Suffixes:
    """Suffixes of a text, compared over at most ``limit`` bytes."""

    def __init__(self, text: np.ndarray, limit: int):
        self.text, self.limit = text, limit
        self.prefix = prefix_hashes(text)
        self.inverse = powers_inverse(len(self.prefix))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``a`` and ``b``: binary search over equal hashes."""
        at_a, at_b, inverse_a, inverse_b = self.prefix[a], self.prefix[b], self.inverse[a], self.inverse[b]

        def equal(length):
            return (self.prefix[a + length] - at_a) * inverse_a == (self.prefix[b + length] - at_b) * inverse_b

        low = np.where(equal(self.limit), self.limit, 0)
        step = 1 << (self.limit.bit_length() - 1)
        while step:
            longer = low + step
            fits = longer < self.limit
            longer = np.where(fits, longer, low)
            low = np.where(fits & equal(longer), longer, low)
            step >>= 1
        return low

    def before(self, a: np.ndarray, b: np.ndarray, rank_a: np.ndarray, rank_b: np.ndarray) -> np.ndarray:
        """Whether ``a`` sorts before ``b``; equal ones go by their rank."""
        length = self.common(a, b)
        same = length == self.limit
        inside = np.where(same, 0, length)
        return np.where(same, rank_a < rank_b, self.text[a + inside] < self.text[b + inside])

    def equal_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(self.text, self.limit)
        return (windows[a] == windows[b]).all(axis=1)


def merge_sort(suffixes: Suffixes, start: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of suffixes within their groups; ``group`` is sorted, ``rank`` breaks ties.

    Runs of doubling width are merged for all groups at once: every suffix finds
    its place in the neighbouring run by binary search.
    """
    n = len(start)
    order = np.arange(n)
    if not n:
        return order
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.append(head, n))
    first, many = np.repeat(head, size), np.repeat(size, size)
    local = np.arange(n) - first
    width = 1
    while width < size.max():
        at = np.flatnonzero(many > width)
        own_run = local[at] // width
        right = (own_run & 1).astype(bool)
        begin = first[at] + (own_run ^ 1) * width
        end = np.minimum(begin + width, first[at] + many[at])
        begin = np.minimum(begin, end)
        low, high = begin.copy(), end.copy()
        me = order[at]
        while True:
            active = np.flatnonzero(low < high)
            if not len(active):
                break
            middle = (low[active] + high[active]) // 2
            other, own = order[middle], me[active]
            less = suffixes.before(start[other], start[own], rank[other], rank[own])
            low[active] = np.where(less, middle + 1, low[active])
            high[active] = np.where(less, high[active], middle)
        pair = first[at] + (own_run & ~1) * width
        within = local[at] - own_run * width
        place = pair + within + (low - begin)
        order[place] = me
        width *= 2
    return order


def repeated_suffixes(text: np.ndarray, start: np.ndarray, group: np.ndarray, rank: np.ndarray, limit: int) -> np.ndarray:
    """Marks the suffixes that equal one of lower rank in their group over ``limit`` bytes."""
    late = np.zeros(len(start), bool)
    by_group = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    by_group = by_group[sizes[group[by_group]] > 1]
    if not len(by_group):
        return late
    suffixes = Suffixes(text, limit)
    start, group, rank = start[by_group], group[by_group], rank[by_group]
    order = merge_sort(suffixes, start, group, rank)
    left, right = order[:-1], order[1:]
    same = (group[left] == group[right]) & (suffixes.common(start[left], start[right]) == limit)
    near = np.flatnonzero(same)
    same[near] = suffixes.equal_bytes(start[left[near]], start[right[near]])
    # Ranks rise within a class, so its head is the earliest; equal ranks are one suffix given twice.
    head = np.flatnonzero(np.r_[True, ~same])[np.cumsum(np.r_[True, ~same]) - 1]
    late[by_group[order]] = rank[order] != rank[order[head]]
    return late


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)``: bytes that an earlier window covers."""
    texts = doc_texts(docs)
    # Both rounds join the texts with their runs alike, so Spark shuffles them once.
    seeded = texts.join(by_document(find_runs(texts, byte_units, window, gram)), "doc_id", "left")
    pieces = map_texts(seeded, _open_pieces(window), "key bigint, doc_id bigint, place bigint, piece binary")
    dealt = pieces.repartition("key").sortWithinPartitions("key", "doc_id", "place")
    more = dealt.mapInArrow(_sorter(window, HELD_ROWS), "doc_id bigint, start bigint, end bigint").groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "end")).alias("more")
    )
    schema = f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans {SPANS}"
    return map_texts(seeded.join(more, "doc_id", "left"), _finisher(window), schema).withColumn("doc_id", public_id())


def _cut(rows, data: np.ndarray, offsets: np.ndarray, row, start, end) -> dict:
    """Results of some rows whose ``[start, end)`` byte ranges go."""
    first = int(offsets[0])
    text, bounds = data[first:int(offsets[-1])], offsets - first
    edges = np.zeros(len(text) + 1, np.int64)
    np.add.at(edges, bounds[row] + start, 1)
    np.add.at(edges, bounds[row] + end, -1)
    gone = np.cumsum(edges)[:-1] > 0
    new = gone.copy()
    new[1:] &= ~gone[:-1]
    starts = bounds[:-1][np.diff(bounds) > 0]
    new[starts] |= gone[starts]
    total = np.concatenate([[0], np.cumsum(gone)])
    runs = np.concatenate([[0], np.cumsum(new)])
    kept, edge = text[~gone].tobytes(), bounds - total[bounds]
    begin = np.flatnonzero(new)
    stop = np.flatnonzero(np.r_[gone[:-1] & (~gone[1:] | new[1:]), gone[-1:]]) + 1
    owner = np.searchsorted(bounds, begin, side="right") - 1
    spans = struct_lists(np.searchsorted(begin, bounds), start=begin - bounds[owner], end=stop - bounds[owner])
    return {
        "doc_id": rows.column("doc_id"), "n_bytes": np.diff(bounds), "n_removed": np.diff(total[bounds]),
        "n_spans": np.diff(runs[bounds]),
        "kept_sha256": [hashlib.sha256(kept[edge[i]:edge[i + 1]]).hexdigest() for i in range(len(edge) - 1)], "spans": spans,
    }


def _open_pieces(window: int):
    """The bytes of open runs, keyed by their anchor.

    Runs of a hot anchor are taken window by window, keyed by the window, so
    that they spread; its copies within a slice come settled, without bytes.
    """
    def list_pieces(rows, data, offsets):
        row, runs = flat_structs(rows.column("runs"))
        open_run = runs["state"] != MATCHED
        if not open_run.any():
            return None
        first = int(offsets[0])
        text, bounds = data[first:int(offsets[-1])], offsets - first
        doc = rows.column("doc_id").to_numpy()
        row, anchor, hot = row[open_run], runs["anchor"][open_run].astype(np.int64), runs["state"][open_run] == HOT
        start, windows, offset = unpack(runs["place"][open_run].astype(np.int64))
        many = np.where(hot, windows, 0)
        owner = np.repeat(row, many)
        where = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = bounds[owner] + where
        value = mix(span_hashes(prefix_hashes(text), at, at + window)).view(np.int64) ^ np.repeat(anchor, many)
        order = np.lexsort((where, doc[owner], value))
        owner, where, value = owner[order], where[order], value[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = value[1:] != value[:-1]
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        late = (doc[owner] != doc[owner[head]]) | (where != where[head])
        keep = fresh | late
        owner, where, value, late = owner[keep], where[keep], value[keep], late[keep]
        value[late] = mix(doc[owner[late]].view(np.uint64) + where[late].astype(np.uint64)).view(np.int64)
        whole = ~hot
        piece_row = np.concatenate([row[whole], owner])
        piece_start = np.concatenate([start[whole], where])
        piece_windows = np.concatenate([windows[whole], np.ones(len(owner), np.int64)])
        settled = np.concatenate([np.zeros(whole.sum(), bool), late])
        base = bounds[piece_row] + piece_start
        ends = base + np.where(settled, 0, piece_windows + window - 1)
        return {
            "key": np.concatenate([anchor[whole], value]), "doc_id": doc[piece_row],
            "place": pack(piece_start, piece_windows, np.concatenate([offset[whole], np.zeros(len(owner), np.int64)])),
            "piece": pa.array([text[a:b].tobytes() for a, b in zip(base.tolist(), ends.tolist(), strict=True)], pa.binary()),
        }

    return list_pieces


def _sorter(window: int, held_rows: int = HELD_ROWS):
    def sort(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
        """Removed ranges of some pieces, all earlier pieces of their keys among them, and which pieces have none."""
        doc, key = table["doc_id"].to_numpy(), table["key"].to_numpy()
        start, windows, offset = unpack(table["place"].to_numpy())
        # Pieces without bytes were settled before; they are removed as they are.
        settled = pc.equal(pc.binary_length(table["piece"]), 0).to_numpy()
        windows = np.where(settled, 0, windows)
        pieces = table["piece"].combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
        text = np.frombuffer(pieces.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        owner = np.repeat(np.arange(len(doc)), windows)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        # Equal windows hold the anchor at the same place.
        lead = offset[owner] - step
        number = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        _, group = np.unique(number[owner] * 256 + lead + 128, return_inverse=True)
        at = start[owner] + step
        order = np.lexsort((at, doc[owner]))
        rank = np.empty(len(order), np.int64)
        changed = np.r_[False, (doc[owner[order]][1:] != doc[owner[order]][:-1]) | (at[order][1:] != at[order][:-1])]
        rank[order] = np.cumsum(changed)
        late = repeated_suffixes(text, bounds[owner] + step, group, rank, window)
        new = late.copy()
        new[1:] &= ~late[:-1] | (owner[1:] != owner[:-1])
        last = late.copy()
        last[:-1] &= ~late[1:] | (owner[1:] != owner[:-1])
        left = ~settled
        left[owner[late]] = False
        return pa.RecordBatch.from_pydict({
            "doc_id": np.concatenate([doc[settled], doc[owner[new]]]), "start": np.concatenate([start[settled], at[new]]),
            "end": np.concatenate([start[settled], at[last]]) + window,
        }), left

    def shorten(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        """What single windows of an unfinished key give so far, and the first of each, which later ones may equal."""
        table = pa.Table.from_batches(held).combine_chunks()
        doc, place = table["doc_id"].to_numpy(), table["place"].to_numpy()
        if (unpack(place)[1] > 1).any():
            return None, held  # of an open anchor, whose runs are bounded
        out, left = sort(table)
        left[1:] &= (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        return out, table.filter(pa.array(left)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            # Keys before the last one of this batch are complete.
            if cut or (held and held[-1].column("key")[-1].as_py() != key[0]):
                yield sort(pa.Table.from_batches([*held, batch.slice(0, cut)]))[0]
                held = []
            held.append(batch.slice(cut))
            if sum(h.num_rows for h in held) > held_rows:
                out, held = shorten(held)
                if out is not None:
                    yield out
        if held:
            yield sort(pa.Table.from_batches(held))[0]

    return run


def _finisher(window: int):
    def finish(rows, data, offsets):
        row, runs = flat_structs(rows.column("runs"))
        matched = runs["state"] == MATCHED
        start, windows, _ = unpack(runs["place"][matched].astype(np.int64))
        late, more = flat_structs(rows.column("more"))
        return _cut(
            rows, data, offsets, np.concatenate([row[matched], late]), np.concatenate([start, more["start"]]).astype(np.int64),
            np.concatenate([start + windows + window - 1, more["end"]]).astype(np.int64),
        )

    return finish

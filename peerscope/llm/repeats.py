"""Finds runs of ``window`` units (words or bytes) that occur earlier, without sending all of them.

Every window chooses an anchor: the smallest hash among its grams. Equal windows
choose the same anchor, so only anchors are shuffled. Neighbouring windows that
share an anchor form a run; a run is one row with a hash of everything it spans.
Runs with equal anchor and span are equal in all their windows, and all but the
earliest are *matched* at once. A run that shares its anchor but not its span
with another stays *open*: its windows have to be compared one by one.

Copies within a slice are matched before the shuffle, so a text that holds a
third of all rows sends one row per slice. An anchor with more than
``HOT_RUNS`` different runs in a slice is spread by span and left open, so a
line that most documents hold does not meet in one task. An anchor that comes
to more than ``OPEN_RUNS`` different runs over all slices is hot as well, so the
open runs of any other are bounded, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.hashing import mix, prefix_hashes, sliding_argmin, span_hashes
from peerscope.llm.texts import map_texts

HOT_RUNS, OPEN_RUNS, SPREAD = 64, 4096, 1024
#: ``place`` packs a run: its first unit, how many windows, and where in the first one the anchor is.
PLACE_BITS = 7
MATCHED, OPEN, HOT = 1, 0, 2
_MARK = -(1 << 63)

#: Units of some rows as an array, and the bounds of the rows in it.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start << (2 * PLACE_BITS)) | (windows << PLACE_BITS) | offset


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << PLACE_BITS) - 1
    return place >> (2 * PLACE_BITS), (place >> PLACE_BITS) & low, place & low


def runs(values: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """``(row, start, windows, offset, anchor, span)`` of all runs, and the prefix hashes."""
    prefix = prefix_hashes(values)
    size = len(values) - window + 1
    if size <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), prefix
    at = np.arange(len(values) - gram + 1)
    grams = mix(span_hashes(prefix, at, at + gram))
    anchor = sliding_argmin(grams, window - gram + 1)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:size]
    whole = np.arange(size) + window <= bounds[row + 1]
    start = np.flatnonzero(whole)
    row, anchor = row[start], anchor[start]
    first = np.ones(len(start), bool)
    first[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(first)
    windows = np.diff(np.append(first, len(start)))
    start, anchor, row = start[first], anchor[first], row[first]
    span = mix(span_hashes(prefix, start, start + windows + window - 1) + (pack(start * 0, windows, anchor - start)).astype(np.uint64))
    return row, start, windows, anchor - start, grams[anchor], span, prefix


def find_runs(texts: DataFrame, units: Units, window: int, gram: int, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``(doc_id, place, anchor, state, source, source_place)`` of matched and open runs.

    ``texts`` holds ``doc_id`` and ``text``. ``source`` is the document that has
    the run earlier. Rows that repeat a ``doc_id`` are taken as one document.
    """
    if window - gram + 1 >= 1 << PLACE_BITS:
        raise ValueError(f"a window may have at most {(1 << PLACE_BITS) - 2} units more than a gram")

    def scan(rows, data, offsets):
        values, bounds = units(data, offsets)
        row, start, windows, offset, anchor, span, _ = runs(values, bounds, window, gram)
        if not len(row):
            return None
        doc = rows.column("doc_id").to_numpy()[row]
        place = pack(start - bounds[row], windows, offset)
        order = np.lexsort((place, doc, span, anchor))
        doc, place, anchor, span = doc[order], place[order], anchor[order].view(np.int64), span[order].view(np.int64)
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        again = (doc != doc[head]) | (place != place[head])  # else a repeated row
        # Rows leave in the order of the texts, whose ids and places then pack well.
        keep = np.flatnonzero(fresh | again)
        keep = keep[np.argsort(order[keep])]
        group = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1
        hot = (np.bincount(group[fresh], minlength=group[-1] + 1) > hot_runs)[group]
        # A matched row carries its source in place of the keys, and is spread at random.
        part = np.where(again, -1 - np.arange(len(doc)) % SPREAD, np.where(hot, 1 + (span & (SPREAD - 1)), 0))
        key, second = np.where(again, doc[head], anchor), np.where(again, place[head], span)
        marked = np.unique(anchor[hot])
        return {
            "part": np.append(part[keep], np.zeros(len(marked), np.int64)).astype(np.int32),
            "key": np.append(key[keep], marked), "second": np.append(second[keep], np.full(len(marked), _MARK)),
            "doc_id": np.append(doc[keep], np.zeros(len(marked), np.int64)),
            "place": np.append(place[keep], np.zeros(len(marked), np.int64)),
        }

    scanned = map_texts(texts, scan, "part int, key bigint, second bigint, doc_id bigint, place bigint")
    dealt = scanned.repartition("key", "part").sortWithinPartitions("part", "key", "second", "doc_id", "place")
    return dealt.mapInArrow(
        _matcher(OPEN_RUNS), "doc_id bigint, place bigint, anchor bigint, state tinyint, source bigint, source_place bigint"
    )


def _matcher(open_runs: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _heat(_match(batches), open_runs)

    return match


def _heat(found: Iterator[pa.RecordBatch], open_runs: int) -> Iterator[pa.RecordBatch]:
    """Make the open runs of an anchor hot if they are more than ``open_runs``; no more than those are held back.

    Open runs of an anchor come one after the other, one for each of its spans.
    """
    held, heated = None, None  # open runs of the last anchor, or that anchor if it is hot by now
    for batch in found:
        is_open = batch.column("state").to_numpy() == OPEN
        if not is_open.any():
            yield batch
            continue
        if not is_open.all():
            yield batch.filter(pa.array(~is_open))
        rows = pa.Table.from_batches(([] if held is None else [held]) + [batch.filter(pa.array(is_open))]).combine_chunks()
        anchor = rows["anchor"].to_numpy()
        head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(np.append(head, len(anchor)))
        hot = sizes > open_runs
        hot[0] |= heated is not None and heated == anchor[0]
        heated = anchor[-1] if hot[-1] else None
        rows = rows.set_column(rows.schema.get_field_index("state"), "state", pa.array(np.repeat(np.where(hot, HOT, OPEN), sizes).astype(np.int8)))
        done = len(anchor) if hot[-1] else int(head[-1])
        held = None if hot[-1] else rows.slice(done).combine_chunks().to_batches()[0]
        if done:
            yield from rows.slice(0, done).to_batches()
    if held is not None:
        yield held


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match runs that come sorted; across batches only one open run and the state of its anchor are kept."""
    last = None  # part, key, second, first doc and place of that span, whether the anchor has several spans, hot, held back
    for batch in batches:
        part, key, second, doc, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        held = 0
        several, hot, waiting = False, False, False
        if last is not None:
            # The first row of the unfinished span leads this batch again.
            head, several, hot, waiting = last
            part, key, second, doc, place = (np.append(np.array([h], a.dtype), a) for h, a in zip(head, (part, key, second, doc, place), strict=True))
            held = 1
        n = len(part)
        if n == 0:
            continue
        anchor_start = np.ones(n, bool)
        anchor_start[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        span_start = anchor_start.copy()
        span_start[1:] |= second[1:] != second[:-1]
        group = np.cumsum(anchor_start) - 1
        head = np.flatnonzero(span_start)[np.cumsum(span_start) - 1]
        marker = (second == _MARK) & (part == 0) & (doc == 0) & (place == 0)
        spans = np.bincount(group[span_start], minlength=group[-1] + 1)
        is_hot = np.zeros(group[-1] + 1, bool)
        is_hot[group[marker]] = True
        is_hot[group[part > 0]] = True
        if held:
            is_hot[0] |= hot
            spans[0] += several
        many = (spans > 1) | is_hot
        same = (doc == doc[head]) & (place == place[head])
        ready = part < 0
        matched = ready | (~span_start & ~same & ~marker)
        open_run = span_start & ~marker & ~ready & many[group]
        if held and not waiting:
            open_run[0] = False
        if held:
            matched[0] = False
        # The last span's first row may still learn of another span of its anchor.
        tail = head[-1]
        pending = bool(span_start[tail] and not ready[tail] and not marker[tail] and not open_run[tail] and (waiting or tail >= held))
        last = (
            (part[tail], key[tail], second[tail], doc[tail], place[tail]), bool(spans[-1] > 1), bool(is_hot[-1]), pending,
        )
        if ready[tail]:
            last = None
        out = np.flatnonzero(matched | open_run)
        if not len(out):
            continue
        state = np.where(matched, MATCHED, np.where(is_hot[group], HOT, OPEN)).astype(np.int8)
        source = np.where(ready, key, doc[head])
        source_place = np.where(ready, second, place[head])
        yield pa.RecordBatch.from_pydict({
            "doc_id": doc[out], "place": place[out], "anchor": np.where(ready, 0, key)[out], "state": state[out],
            "source": source[out], "source_place": source_place[out],
        })


def by_document(found: DataFrame) -> DataFrame:
    """``(doc_id, runs)``: what a document has, at most one entry per unit of it."""
    return found.groupBy("doc_id").agg(
        F.collect_list(F.struct("place", "anchor", "state", "source", "source_place")).alias("runs")
    )

"""Best-two-fit packing of token sequences.

A document is the ids of its text and an end id; only a longer one is cut, into
pieces of ``capacity`` ids. Pieces are packed by length: lengths are counted over
the whole table, at most ``capacity`` numbers, and bins are planned on the counts.
A bin is filled greedily, the longest piece that fits first. Then its smallest
piece gives way to the two unpacked pieces that fit the gap with it most tightly,
as long as two fit tighter than it did. A planned bin is repeated as often as the
counts allow, so the plan has a few rows per length, however many pieces there
are. The pieces of a length are then numbered, and a number finds its bin and
its place there in the plan.

Numbers come from buckets of about ``BUCKET_ROWS`` pieces of one length, whose
sizes are summed up per length, so a length that a third of all pieces have is
spread over many tasks. The plan (some tens of thousands of rows at most, since a
bin holds fewer than a hundred different lengths) is all that is shipped.

Words are encoded once per worker as long as it remembers them: the parts of the
default tokenizer never cross a blank, so a text's ids are those of its words one
after the other. Texts are encoded whole if the tokenizer is of another build.

Defined cases: a null or empty text is the end id alone; rows that repeat a
``doc_id`` are packed one by one; ties in length are settled by the place of the
row in the written table; an empty table has no sequence; texts of any length
are encoded whole, in memory that follows the longest single text.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerscope.llm.hashing import WORD
from peerscope.llm.texts import doc_texts, map_texts, named, public_id
from peerscope.session import materialize

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are numbered together, and the most buckets of a length.
BUCKET_ROWS, MAX_BUCKETS = 512, 4096
#: Words that a worker remembers the ids of.
CACHE_WORDS = 3 << 17
_RANK_BITS = 44


#: The normaliser and splitter whose parts never cross a blank or the edge between Latin
#: letters and ASCII signs, so that the ids of a text are those of such parts one after the other.
_BLANKS_DROPPED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes: Latin letters of one or two bytes, ASCII signs and digits that never join a letter, all others.
_LETTER, _SIGN, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[*b"'<|>"]] = _OTHER  # contractions and special tokens
_ENCODED_AT_ONCE = 2048


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return "".join(chr(k if k in printable else next(others)) for k in range(256))


class WordEncoder:
    """Ids of words, remembered for the next slices: those of the last ``CACHE_WORDS`` parts or more."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        known = json.loads(vocabulary)
        splitters = (known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        #: Whether words may be encoded apart; otherwise whole texts are.
        self.by_words = (
            (known.get("normalizer") or {}).get("normalizers") == _BLANKS_DROPPED and len(splitters) == 2
            and (splitters[0].get("pattern") or {}).get("Regex") == _SPLIT and splitters[1].get("type") == "ByteLevel"
        )
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.letters = _byte_letters()

    def encode(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part as little-endian 32-bit numbers."""
        out: list[bytes] = []
        later: list[int] = []
        tokenize = self.tokenizer.model.tokenize
        for k, part in enumerate(parts):
            ids = self.new.get(part)
            if ids is None:
                ids = self.old.get(part)
                if ids is None:
                    word = part.decode("utf-8", "replace")
                    if self.by_words and word.isalpha() and word.islower() and max(word) <= "\xff":
                        # Lower-case Latin letters are one part of the splitter as they are.
                        ids = array("I", [t.id for t in tokenize(part.decode("latin-1").translate(self.letters))]).tobytes()
                    else:
                        later.append(k)
                        out.append(b"")
                        continue
                self._keep(part, ids)
            out.append(ids)
        for first in range(0, len(later), _ENCODED_AT_ONCE):
            some = later[first:first + _ENCODED_AT_ONCE]
            found = self.tokenizer.encode_batch_fast([parts[k].decode("utf-8", "replace") for k in some], add_special_tokens=False)
            for k, one in zip(some, found, strict=True):
                out[k] = array("I", one.ids).tobytes()
                if self.by_words:
                    self._keep(parts[k], out[k])
        return out

    def _keep(self, part: bytes, ids: bytes) -> None:
        if len(self.new) >= CACHE_WORDS:
            self.old, self.new = self.new, {}
        self.new[part] = ids


_encoders: dict[int, WordEncoder] = {}


def _encoder(vocabulary: str) -> WordEncoder:
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = WordEncoder(vocabulary)
    return _encoders[key]


def _parts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the blanks between them, cut between letters and signs; those in lower case that hold nothing else."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    # A letter of two bytes: 0xC3 and what follows, but for the signs of multiplication and division.
    lead = np.flatnonzero((data[:-1] == 0xC3) & ~edge[1:-1])
    second = data[lead + 1]
    latin = (second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)
    lead, second = lead[latin], second[latin]
    kind[lead] = kind[lead + 1] = _LETTER
    others = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == _OTHER, out=others[1:])
    limits = np.append(starts, len(data))
    plain = np.repeat(others[limits[1:]] == others[limits[:-1]], np.diff(limits))
    lowered = np.where(plain & (data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    upper = lead[(second < 0x9F) & plain[lead]] + 1
    lowered[upper] += 0x20
    edge[1:-1] |= plain[1:] & plain[:-1] & (kind[1:] != kind[:-1])
    return lowered, np.flatnonzero(edge[:-1])


def encode_texts(data: np.ndarray, offsets: np.ndarray, encoder: WordEncoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, the end id after each, and the bounds of the rows."""
    first = int(offsets[0])
    data, offsets = data[first:int(offsets[-1])], offsets - first
    rows = len(offsets) - 1
    if encoder.by_words:
        inside = WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        words = np.flatnonzero(inside & (~before | edge[:-1]))
        # Without the blanks the words lie one after the other.
        place = np.zeros(len(data) + 1, np.int64)
        np.cumsum(inside, out=place[1:])
        offsets = place[offsets]
        data, starts = _parts(data[inside], place[words]) if len(words) else (data[:0], words)
    else:
        starts = offsets[:-1]
        data = np.ascontiguousarray(data)
    limits = np.append(starts, len(data))
    packed = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(data)]
    ).dictionary_encode()
    codes = packed.indices.to_numpy().astype(np.int64)
    pieces = encoder.encode(packed.dictionary.to_pylist())
    sizes = np.array([len(p) // 4 for p in pieces], np.int64)
    ids = np.frombuffer(b"".join(pieces), "<u4")
    at = np.cumsum(sizes) - sizes
    many = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.cumsum(many)
    source = np.arange(int(many.sum())) + np.repeat((at[codes] if len(codes) else many) - (ends - many), many)
    # The ids of a row begin after those of the rows before and their end ids.
    row_parts = np.searchsorted(starts, offsets) if encoder.by_words else np.arange(rows + 1)
    total = np.append(0, ends)[row_parts]
    bounds = total + np.arange(rows + 1)
    out = np.full(int(bounds[-1]), end_id, "<u4")
    out[np.arange(len(source)) + np.repeat(np.arange(rows), np.diff(total))] = ids[source]
    return out, bounds


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: every document's ids, cut where it has more than ``capacity``.

    ``vocabulary`` is the path of a tokenizer file; ``ids`` are little-endian 32-bit numbers.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    with open(vocabulary, encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def cut(rows, data, offsets):
        ids, bounds = encode_texts(data, offsets, _encoder(shipped.value), end_id)
        pieces = -(-np.diff(bounds) // capacity)
        row = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = number * capacity
        length = np.minimum(np.diff(bounds)[row] - start, capacity)
        limits = np.append(bounds[row] + start, bounds[-1]) * 4
        return {
            "doc_id": rows.column("doc_id").take(pa.array(row)), "piece": number.astype(np.int32), "start": start, "length": length,
            "ids": pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(limits), pa.py_buffer(ids)]).cast(pa.binary()),
        }

    return map_texts(doc_texts(docs), cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary").withColumn("doc_id", public_id())


@dataclass
class Plan:
    """Bins as slots: pieces ``first``, ``first + 1``, ... of a length go ``each`` to a bin, from bin ``sequence`` on, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.searchsorted((self.length << _RANK_BITS) + self.first, (length << _RANK_BITS) + rank, side="right") - 1
        behind = rank - self.first[slot]
        copy, within = behind // self.each[slot], behind % self.each[slot]
        return self.sequence[slot] + copy, self.offset[slot] + within * length


def _fill(left: np.ndarray, capacity: int) -> dict[int, int]:
    """One bin, the longest that fits first: copies by length."""
    lengths = np.flatnonzero(left)
    own: dict[int, int] = {}
    gap = capacity
    while gap > 0:
        lengths = lengths[:np.searchsorted(lengths, gap, side="right")]
        if not len(lengths):
            break
        longest = int(lengths[-1])
        own[longest] = min(int(left[longest]), gap // longest)
        gap -= own[longest] * longest
        lengths = lengths[:-1]
    return own


def _two_fit(own: dict[int, int], left: np.ndarray, capacity: int) -> dict[int, int]:
    """Let the smallest piece give way to two that leave a smaller gap, until there are none."""
    gap = capacity - sum(k * n for k, n in own.items())
    while gap > 0:
        smallest = min(own)
        free = left.copy()
        for k, n in own.items():
            free[k] -= n
        room = gap + smallest
        lengths = np.flatnonzero(free[:room])
        lengths = lengths[lengths > 0]
        if not len(lengths):
            break
        partner = np.searchsorted(lengths, room - lengths, side="right") - 1
        # A length with one piece left is no partner of its own.
        partner -= (partner >= 0) & (lengths[partner] == lengths) & (free[lengths] < 2)
        total = np.where(partner >= 0, lengths + lengths[partner], 0)
        best = int(np.argmax(total))
        if total[best] <= smallest:
            break
        own = dict(own)
        own[smallest] -= 1
        if not own[smallest]:
            del own[smallest]
        for k in (int(lengths[best]), int(lengths[partner[best]])):
            own[k] = own.get(k, 0) + 1
        gap = room - int(total[best])
    return own


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Bins for ``counts`` pieces of each length from 1 to ``capacity``."""
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    given = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    while left.any():
        own = _two_fit(_fill(left, capacity), left, capacity)
        times = min(int(left[k]) // n for k, n in own.items())
        offset = 0
        for k in sorted(own, reverse=True):
            slots.append((k, int(given[k]), sequence, own[k], offset))
            offset += k * own[k]
            given[k] += own[k] * times
            left[k] -= own[k] * times
        sequence += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(*table.T.copy(), sequences=sequence)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` has a ``length`` from 1 to ``capacity`` and any other columns."""
    spark = pieces.sparkSession
    whole = F.struct(*[named(pieces, c) for c in pieces.columns]).alias("row")
    stored = materialize(
        pieces.select(whole, pieces["length"].cast("bigint").alias("length"), F.monotonically_increasing_id().alias("number")), "pieces"
    )
    counts = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}
    plan = plan_bins(counts, capacity)
    buckets = [(k, min(-(-n // BUCKET_ROWS), MAX_BUCKETS)) for k, n in counts.items()]
    sizes = F.broadcast(spark.createDataFrame(buckets, "length bigint, buckets bigint"))
    dealt = stored.join(sizes, "length").withColumn("bucket", F.pmod(F.xxhash64("number"), F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "bucket").agg(F.count("*").alias("rows")).select(
        "length", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")
    )
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("number")) - 1
    ranked = dealt.withColumn("own", own).join(bases, ["length", "bucket"]).select("row", "length", (F.col("base") + F.col("own")).alias("rank"))
    shipped = spark.sparkContext.broadcast(plan)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shipped.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    schema = T.StructType([ranked.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = ranked.mapInArrow(look_up, schema)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in pieces.columns], "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)`` of every piece of ``docs``."""
    return place(token_pieces(docs, vocabulary, capacity, end_id), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids, pieces)``: one row per sequence of at most ``capacity`` ids."""
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "start", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    pieces = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda done, part: done + part["length"])
    return grouped.select("sequence_id", total.alias("length"), joined.alias("ids"), pieces.alias("pieces"))

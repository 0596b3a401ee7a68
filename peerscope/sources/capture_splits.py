"""Capture files (pcap) of any size, each decoded by many tasks.

A pcap file has no marks between its records, so a task that begins inside it has
to guess where a record starts: it takes the first offset from which several
headers in a row are plausible. The guess is then verified. Every split walks from
its first record to the first border at or behind its end, and that border must be
where the next split began. Splits that began elsewhere (a packet may carry another
capture) are walked again from the border before them, until all agree. So the
result is that of one walk from the head of the file, whatever the packets hold.

Tasks read their ranges with ``pyarrow.fs``, in windows of some megabytes: paths must be
local to all executors or on a store that pyarrow opens (S3, GCS, HDFS with libhdfs).
pcapng files go through ``captures.read_captures``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerscope.session import materialize
from peerscope.sources.captures import DECODED, FRAMES_AT_ONCE, MOST_CAPTURED, dissect_frames, packets_of

#: Bytes that a split begins in; a task reads little more.
SPLIT_BYTES = 128 * 1024 * 1024
#: Bytes in memory at a time.
WINDOW_BYTES = 8 * 1024 * 1024
#: So many plausible headers in a row make a border.
CHAIN = 8
#: Tasks at most; a task takes several splits beyond them, and of small splits.
MOST_TASKS = 100_000
HEAD, RECORD = 24, 16
UNKNOWN = -1

#: ``start`` and ``end`` are borders, ``broken`` the byte of an impossible record, else -1.
WALKED = "path string, length long, lower long, upper long, start long, end long, records long, broken long"


class Shape(NamedTuple):
    """What the head of a file says."""

    order: str
    ticks_per_us: int
    longest: int
    link: int


def read_large_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All pcap files below ``path`` as raw packets, equal to ``read_captures``, packet ids included."""
    # Only names and lengths: the content is not read here.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return decode_splits(verified_splits(files, split_bytes))


def verified_splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, length)`` to :data:`WALKED`: splits whose borders meet; an impossible record fails."""
    if split_bytes < 1:
        raise ValueError("a split needs a byte")
    lower = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    splits = files.filter("length > 0").select("path", "length", lower.alias("lower")).select(
        "*", F.least(F.col("lower") + split_bytes, "length").alias("upper"), F.lit(UNKNOWN).cast("long").alias("start")
    )
    walked = _walk(splits)
    while True:
        before = F.lag("end").over(Window.partitionBy("path").orderBy("lower"))
        met = walked.withColumn("border", F.coalesce(before, F.lit(HEAD).cast("long")))
        # A broken split ends nowhere; what comes behind it cannot be walked.
        apart = materialize(met.filter("border <> -1 AND start <> border"), "apart")
        if apart.isEmpty():
            break
        again = apart.select("path", "length", "lower", "upper", F.col("border").alias("start"))
        kept = walked.join(again.select("path", "lower"), ["path", "lower"], "left_anti")
        walked = materialize(kept.select(walked.columns).unionByName(_walk(again)), "walked")
    # The first of a file has a true start, as have all behind it up to this one.
    wrong = walked.filter("broken >= 0").groupBy("path").agg(F.min("broken").alias("broken")).first()
    if wrong:
        raise ValueError(f"{wrong['path']}: impossible record at byte {wrong['broken']}")
    return walked


def decode_splits(walked: DataFrame) -> DataFrame:
    """Raw packets of verified splits; records are numbered through each file."""
    earlier = Window.partitionBy("path").orderBy("lower").rowsBetween(Window.unboundedPreceding, -1)
    numbered = walked.withColumn("first_record", F.coalesce(F.sum("records").over(earlier), F.lit(0))).filter("records > 0")
    return packets_of(_dealt(materialize(numbered, "numbered")).mapInPandas(_decode, DECODED))


def _dealt(splits: DataFrame) -> DataFrame:
    """A task for each split, or for so many small ones as make a large one: their rows are tiny, so Spark would put them together."""
    count, total = splits.agg(F.count("*"), F.coalesce(F.sum(F.col("upper") - F.col("lower")), F.lit(0))).first()
    tasks = max(4 * splits.sparkSession.sparkContext.defaultParallelism, total // SPLIT_BYTES)
    return splits.repartition(max(1, min(count, tasks, MOST_TASKS)), "path", "lower")


def _walk(splits: DataFrame) -> DataFrame:
    return materialize(_dealt(splits).mapInPandas(_walk_splits, WALKED), "walked")


def _open(path: str):
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _shape(file, path: str) -> Shape:
    head = file.read_at(HEAD, 0)
    kinds = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1), b"\xa1\xb2\x3c\x4d": (">", 1000)}
    if head[:4] not in kinds or len(head) < HEAD:
        raise ValueError(f"{path}: not a pcap file")
    order, ticks = kinds[head[:4]]
    longest, link = struct.unpack_from(order + "II", head, 16)
    return Shape(order, ticks, max(longest, MOST_CAPTURED), link & 0xFFFF)


class Broken(ValueError):
    """An impossible record at byte ``at``."""

    def __init__(self, at: int):
        super().__init__(at)
        self.at = at


def _pieces(file, shape: Shape, at: int, upper: int, length: int) -> Iterator[tuple[bytes, list[tuple], int]]:
    """Windows of whole records that begin at ``at`` or behind it and before ``upper``.

    Gives the window's bytes, its frames as ``captures`` has them, and the border behind
    them, which is ``length`` if the file ends inside a packet.
    """
    header, window = struct.Struct(shape.order + "IIII"), WINDOW_BYTES
    while at < upper:
        content, here, frames = file.read_at(min(window, length - at), at), 0, []
        window = WINDOW_BYTES
        while at + here < upper and len(frames) < FRAMES_AT_ONCE:
            if at + here + RECORD > length:
                here = length - at
                break
            if here + RECORD > len(content):
                break
            seconds, fraction, captured, wire = header.unpack_from(content, here)
            if captured > shape.longest:
                raise Broken(at + here)
            if at + here + RECORD + captured > length:
                here = length - at  # the capture was cut off inside this packet
                break
            if here + RECORD + captured > len(content):
                if not frames:
                    window = RECORD + captured  # one packet is larger than a window
                break
            frames.append((here + RECORD, captured, wire, seconds * 1_000_000 + fraction // shape.ticks_per_us, shape.link))
            here += RECORD + captured
        at += here
        if here:
            yield content, frames, at


def _guess(file, shape: Shape, lower: int, length: int) -> int:
    """The first offset at ``lower`` or soon behind it that looks like a border; the end of the file if none does."""
    header = struct.Struct(shape.order + "IIII")
    # A record that began before lower ends within so many bytes; a header may claim any length.
    reach = RECORD + min(shape.longest, MOST_CAPTURED)
    content = file.read_at(min(reach * 2, length - lower), lower)

    def plausible(at: int) -> int:
        """The border behind a plausible record, or -1."""
        _, fraction, captured, wire = header.unpack_from(content, at)
        fits = fraction < 1_000_000 * shape.ticks_per_us and 0 < captured <= wire and captured <= shape.longest
        return at + RECORD + captured if fits else UNKNOWN

    for first in range(min(reach, len(content))):
        at, seen = first, 0
        while seen < CHAIN and at != UNKNOWN and at + RECORD <= len(content):
            at, seen = plausible(at), seen + 1
        if at != UNKNOWN and (seen == CHAIN or seen and lower + at <= length):
            return lower + first
    return length


def _walk_splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, length, lower, upper, start in batch[["path", "length", "lower", "upper", "start"]].itertuples(index=False):
            with _open(path) as file:
                shape = _shape(file, path)
                if start == UNKNOWN:
                    start = HEAD if lower <= HEAD else _guess(file, shape, lower, length)
                end, records, broken = start, 0, UNKNOWN
                try:
                    for _, frames, end in _pieces(file, shape, start, upper, length):
                        records += len(frames)
                except Broken as error:
                    end, broken = UNKNOWN, error.at
            out.append((path, length, lower, upper, start, end, records, broken))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in WALKED.split(", ")])


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, length, upper, start, done in batch[["path", "length", "upper", "start", "first_record"]].itertuples(index=False):
            with _open(path) as file:
                for content, frames, _ in _pieces(file, _shape(file, path), start, upper, length):
                    if frames:
                        yield dissect_frames(path, content, np.array(frames, dtype=np.int64), done)
                    done += len(frames)

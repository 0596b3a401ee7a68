"""Quality rules by distribution divergence.

A text gives two histograms: character classes, and the common words of a
language with one bin for all others. Both are compared with language
references by the Jensen-Shannon distance (base 2, 0 to 1). A histogram with
too few entries is not judged, since its distance is mostly chance. References
are sums over all texts of a language; a text is held against the reference of
its language, or the nearest one where its language is unknown.

Defined cases: a null or empty text has no words, all counts 0, and fails the
base rules; a table without languages has no reference, and the base rules alone
decide; rows that repeat are each judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.llm.hashing import Words, byte_hashes, gram_hashes, mix
from peerscope.llm.texts import doc_texts, map_texts, public_id

COMMON_WORDS = 64
#: Largest distances of a kept text, and the entries below which one is not judged.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.2, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.39, 100
MIN_TEXT_WORDS, MAX_REPEATED_PERCENT = 50, 50

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"


def _char_classes() -> tuple[np.ndarray, int]:
    """A class per byte; bytes that continue a character have class 0 and are not counted."""
    table = np.zeros(256, np.int64)
    groups = [
        b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c",
        b".", b",;:", b"!?", b"'\"-", b"()[]{}", SYMBOLS,
    ]
    for number, group in enumerate(groups, 1):
        table[list(group)] = number
    other = len(groups) + 1
    ascii_rest = [c for c in range(0x80) if table[c] == 0]
    table[ascii_rest] = other
    table[0xC2:0xE0], table[0xE0:0xF0], table[0xF0:] = other + 1, other + 2, other + 3
    return table, other + 4


CLASS_OF, CLASSES = _char_classes()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _row_counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _char_histograms(words: Words) -> np.ndarray:
    n = len(words.offsets) - 1
    row = np.repeat(np.arange(n) * CLASSES, np.diff(words.offsets))
    counts = np.bincount(row + CLASS_OF[words.data], minlength=n * CLASSES).reshape(n, CLASSES)
    return counts[:, 1:]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether a value occurs twice or more."""
    _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[where] > 1


def _repeat_words(words: Words, row: np.ndarray, window: int = 3) -> np.ndarray:
    """Per row, the words inside a run of three words that the row holds twice or more."""
    n = len(words.offsets) - 1
    grams = gram_hashes(words.hashes, window)
    if not len(grams):
        return np.zeros(n, np.int64)
    start = np.flatnonzero(row[:len(grams)] == row[window - 1:])
    again = start[_repeated(mix(grams[start] + row[start].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))]
    covered = np.zeros(len(row), bool)
    for j in range(window):
        covered[again + j] = True
    return np.bincount(row[covered], minlength=n)


def _repeat_lines(words: Words) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    n = len(words.offsets) - 1
    if not len(words.start):
        return np.zeros(n, np.int64)
    breaks = np.flatnonzero(words.data == 0x0A)
    start = np.unique(np.concatenate([words.offsets[:-1], breaks + 1]))
    start = start[start < len(words.data)]
    place = np.searchsorted(breaks, start)
    end = np.append(breaks, len(words.data))[place]
    row = np.searchsorted(words.offsets, start, side="right") - 1
    end = np.minimum(end, words.offsets[row + 1])
    some = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[some], end[some], row[some]
    key = mix(byte_hashes(words.data, start, end) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    return np.bincount(row[again], minlength=n)


def references(docs: DataFrame, common_words: int = COMMON_WORDS) -> DataFrame:
    """``(lang, chars, words, counts, total)`` from all texts with a language.

    Words are counted whole: every distinct word of a task is one row of the shuffle.
    """
    rows = doc_texts(docs, "lang").filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batch, data, offsets):
        words = Words(data, offsets)
        names, index = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
        lang, kind, key, n = [], [], [], []
        histograms = _char_histograms(words)
        owner = index[words.rows()]
        for i, name in enumerate(names):
            chars = histograms[index == i].sum(axis=0)
            hashes, counts = np.unique(words.hashes[owner == i], return_counts=True)
            lang += [name] * (len(chars) + len(hashes))
            kind += [np.zeros(len(chars), np.int64), np.ones(len(hashes), np.int64)]
            key += [np.arange(len(chars)), hashes.view(np.int64)]
            n += [chars, counts]
        return {"lang": pa.array(lang, pa.string()), "kind": np.concatenate(kind), "key": np.concatenate(key), "n": np.concatenate(n)}

    totals = map_texts(rows, count, "lang string, kind bigint, key bigint, n bigint", 1 << 22).groupBy("lang", "kind", "key").agg(
        F.sum("n").alias("n")
    )
    chars = totals.filter("kind = 0").groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("key", "n"))), lambda x: x["n"]).alias("chars")
    )
    words = totals.filter("kind = 1")
    # Spark keeps only the first ranks of a window before the shuffle by language.
    ranked = words.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key")))
    top = ranked.filter(F.col("place") <= common_words).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("key", "n"))).alias("top")
    )
    return chars.join(words.groupBy("lang").agg(F.sum("n").alias("total")), "lang").join(top, "lang").select(
        "lang", "chars", F.col("top.key").alias("words"), F.col("top.n").alias("counts"), "total"
    )


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``counts`` from ``reference``; rows without entries are at 0."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)

    def entropy(x):
        return -(x * np.log2(np.maximum(x, 1e-300))).sum(axis=1)

    divergence = entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(divergence, 0, 1)), 0.0)


def judge(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """Counts, distances and the verdict per document.

    ``learned`` has a row per language, which is what the driver reads.
    """
    model = sorted((r.asDict() for r in learned.collect()), key=lambda r: r["lang"])
    profiles = [
        (m["lang"], np.array(m["chars"], float), np.array(m["words"], np.int64).view(np.uint64),
         np.array([*m["counts"], m["total"] - sum(m["counts"])], float))
        for m in model
    ]
    for k, (lang, chars, words, counts) in enumerate(profiles):
        order = np.argsort(words)
        profiles[k] = (lang, chars, words[order], np.append(counts[:-1][order], counts[-1]))

    def measure(batch, data, offsets):
        words = Words(data, offsets)
        n, row, n_words = len(offsets) - 1, words.rows(), words.counts()
        chars = _char_histograms(words)
        distance, char_distance, word_distance = np.full(n, np.inf), np.zeros(n), np.zeros(n)
        own = batch.column("lang").to_pylist()
        names = [p[0] for p in profiles]
        own = np.array([names.index(x) if x in names else -1 for x in own])
        for k, (_, ref_chars, ref_words, ref_counts) in enumerate(profiles):
            bins = len(ref_words) + 1
            place = np.minimum(np.searchsorted(ref_words, words.hashes), len(ref_words) - 1)
            place = np.where(ref_words[place] == words.hashes, place, len(ref_words))
            counts = np.bincount(row * bins + place, minlength=n * bins).reshape(n, bins)
            by_char = np.where(chars.sum(axis=1) >= MIN_CHARS, js_distance(chars, ref_chars), 0)
            by_word = np.where(n_words >= MIN_WORDS, js_distance(counts, ref_counts), 0)
            better = np.where(own >= 0, own == k, by_char + by_word < distance)
            distance = np.where(better, by_char + by_word, distance)
            char_distance, word_distance = np.where(better, by_char, char_distance), np.where(better, by_word, word_distance)
        inside = np.zeros(len(words.data) + 1, np.int64)
        np.cumsum((words.data & 0xC0) != 0x80, out=inside[1:])
        letters = np.zeros(len(words.start) + 1, np.int64)
        np.cumsum(inside[words.end] - inside[words.start], out=letters[1:])
        return {
            "doc_id": batch.column("doc_id"), "n_words": n_words,
            "word_chars": letters[words.bounds[1:]] - letters[words.bounds[:-1]],
            "n_symbols": _row_counts(_SYMBOL[words.data], words.offsets),
            "n_dup_lines": _repeat_lines(words), "n_repeat_words": _repeat_words(words, row),
            "char_distance": char_distance, "word_distance": word_distance,
        }

    schema = (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "char_distance double, word_distance double"
    )
    measured = map_texts(doc_texts(docs, "lang"), measure, schema)
    failed = (F.col("n_words") < MIN_TEXT_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    near = (F.col("char_distance") <= MAX_CHAR_DISTANCE) & (F.col("word_distance") <= MAX_WORD_DISTANCE)
    return measured.withColumns({"doc_id": public_id(), "base_failed": failed, "kept": ~failed & near})

"""Collocations: phrases of two and three words, counted by multikey three-way quicksort of suffix pointers.

Texts are split into pieces at punctuation and line ends; every word of a piece
begins a suffix, of which the first three words matter. Words are counted first;
a suffix whose leading words are infrequent is abandoned where it is read. The
others are combined per slice of text and routed by language and their two leading
words, so all suffixes that share two words meet. A task sorts pointers to its
suffixes word by word: around a pivot they part into less, equal and greater, and
the equal ones go on with the next word. The weight of an equal part is the count
of its phrase, and a part that weighs less than ``least`` is abandoned. All parts
of a depth are sorted in step, as whole arrays.

A pair of words that very many suffixes begin with (``hot``: a share of a route)
is routed by its third word as well, while its own count is summed up in the
slices. Routes grow in number with the words, so a task holds about ``route_words``
suffixes at a time. Infrequent words are told by a bit map of at most 2**27 bits;
what it lets through is abandoned in the sort.

Words are compared by 64-bit hashes, counts and scores are exact integers.

Defined cases: a null language is ``und``; null, empty and blank texts and pieces
without words have no phrase; rows that repeat are counted each; ties go by phrase;
an empty table has no phrase; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.llm.hashing import Words, mix, separators
from peerscope.llm.ngram_join import complete_groups
from peerscope.llm.texts import map_texts
from peerscope.session import materialize

LEAST = 10
#: A shorter phrase goes if a longer one that holds it has at least this percentage of its count.
COVERED = 50
UNKNOWN = "und"
ROUTE_WORDS = 1 << 20
#: A pair is counted ahead if a slice has it so often, and is hot at this share of a route.
PAIR_COUNT, HOT_SHARE = 32, 0.25
FILTER_BITS = 27
SLICE_BYTES = 1 << 22
_BREAKS = [*b".,;:!?", *range(0x0A, 0x0E)]
_WORD = separators([0x20, 0x09, *_BREAKS])
_IS_BREAK = ~separators(_BREAKS)


def suffix_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, their hashes (never 0), and whether the next word is in the same piece."""
    words = Words(data, offsets, table=_WORD, lower=True)
    row = words.rows()
    breaks = np.zeros(len(words.data) + 1, np.int32)
    np.cumsum(_IS_BREAK[words.data], out=breaks[1:])
    follows = np.zeros(len(row), bool)
    follows[:-1] = (row[1:] == row[:-1]) & (breaks[words.start[1:]] == breaks[words.end[:-1]])
    return words, np.maximum(words.hashes, np.uint64(1)), follows


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _languages(column: pa.Array, counts: np.ndarray):
    """Each language with the words of its rows."""
    known = column.cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
    code = np.repeat(known.indices.to_numpy(), counts)
    for k, lang in enumerate(known.dictionary.to_pylist()):
        yield lang, np.flatnonzero(code == k)


def _spelled(words: Words, which: np.ndarray) -> pa.Array:
    """The words themselves."""
    sizes = words.end[which] - words.start[which]
    ends = np.cumsum(sizes)
    data = words.data[np.arange(int(sizes.sum())) + np.repeat(words.start[which] - (ends - sizes), sizes)]
    return pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def word_counts(texts: DataFrame, slice_bytes: int, pair_count: int) -> DataFrame:
    """``(lang, hash, word, n)``: every word, the total (no hash, no word) and pairs that a slice repeats (no word)."""
    def scan(rows, data, offsets):
        words, hashes, follows = suffix_words(data, offsets)
        out: dict[str, list] = {"lang": [], "hash": [], "word": [], "n": []}

        def add(lang, hashed, word, n):
            for k, v in zip(out, (pa.array([lang] * len(n), pa.string()), hashed, word, pa.array(n, pa.int64())), strict=True):
                out[k].append(v)

        for lang, own in _languages(rows.column("lang"), words.counts()):
            if not len(own):
                continue
            known, at, n = np.unique(hashes[own], return_index=True, return_counts=True)
            add(lang, pa.array(known.view(np.int64)), _spelled(words, own[at]), n)
            add(lang, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), np.array([len(own)]))
            first = own[follows[own]]
            pairs, n = np.unique(_pair(hashes[first], hashes[first + 1]), return_counts=True)
            often = n >= pair_count
            add(lang, pa.array(pairs[often].view(np.int64)), pa.nulls(int(often.sum()), pa.binary()), n[often])
        return {k: pa.concat_arrays(v) for k, v in out.items()} if out["n"] else None

    counted = map_texts(texts, scan, "lang string, hash bigint, word binary, n bigint", slice_bytes)
    return counted.groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))


def frequent_bits(words: DataFrame, bits: int = FILTER_BITS) -> tuple[np.ndarray, int]:
    """A bit map over the leading bits of the hashes of ``words``, sixteen bits a word and 2**``bits`` at most."""
    bits = min(bits, max(int(np.ceil(np.log2(16 * max(words.count(), 1)))), 15))
    place = F.shiftrightunsigned("hash", 64 - bits) + 1
    parts = words.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for part in parts:
        at = (part["bucket"] - 1) * 4096
        own = np.frombuffer(bytes(part["map"]), np.uint8)
        out[at:at + 4096] = own[:len(out) - at]
    return out, bits


def has_bit(known: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    table, bits = known
    place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def quicksort_counts(keys: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(depth, suffix, weight)`` of every part with equal first words that weighs ``least`` or more.

    ``keys[d]`` is word ``d`` of each suffix, 0 behind its end; ``suffix`` is one of the part's.
    """
    depths, n = keys.shape
    pointers = np.arange(n)
    start, size, depth = np.array([0]), np.array([n]), np.array([0])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if n == 0 or weight.sum() < least:
        start, size, depth = start[:0], size[:0], depth[:0]
    while len(start):
        part = np.repeat(np.arange(len(start)), size)
        where = np.arange(len(part)) + np.repeat(start - (np.cumsum(size) - size), size)
        own = pointers[where]
        key = keys[depth[part], own]
        pivot = keys[depth, pointers[start + size // 2]][part]
        side = np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        cell = part * 3 + side
        sizes = np.bincount(cell, minlength=3 * len(start))
        weights = np.bincount(cell, weights=weight[own], minlength=3 * len(start)).astype(np.int64)
        begins = np.cumsum(sizes.reshape(-1, 3), axis=1) - sizes.reshape(-1, 3) + start[:, None]
        for k in range(3):
            mine = np.flatnonzero(side == k)
            count = sizes[k::3]
            pointers[begins[:, k][part[mine]] + np.arange(len(mine)) - (np.cumsum(count) - count)[part[mine]]] = own[mine]
        begins = begins.ravel()
        deeper = np.repeat(depth, 3)
        deeper[1::3] += 1
        stays = (weights >= least) & (sizes > 0)
        equal = np.zeros(len(stays), bool)
        equal[1::3] = True
        at = np.flatnonzero(stays & equal)
        word = pointers[begins[at]]
        ended = keys[deeper[at] - 1, word] == 0
        stays[at[ended]] = False
        at, word = at[~ended], word[~ended]
        found.append((deeper[at], word, weights[at]))
        stays &= deeper < depths
        start, size, depth = begins[stays], sizes[stays], deeper[stays]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _routed(texts: DataFrame, known, hot: np.ndarray, routes: dict[str, int], slice_bytes: int) -> DataFrame:
    """``(lang, route, first, second, third, n)``: suffixes as arrays, per slice and route; negative routes are of hot pairs."""
    shipped = texts.sparkSession.sparkContext.broadcast((known, hot))

    def scan(rows, data, offsets):
        known, hot = shipped.value
        words, hashes, follows = suffix_words(data, offsets)
        often = has_bit(known, hashes)
        out: dict[str, list] = {k: [] for k in ("lang", "route", "first", "second", "third", "n")}
        for lang, own in _languages(rows.column("lang"), words.counts()):
            at = own[follows[own]]
            at = at[often[at] & often[at + 1]]
            if not len(at):
                continue
            first, second = hashes[at], hashes[at + 1]
            after = np.minimum(at + 2, len(hashes) - 1)
            third = np.where(follows[at + 1] & often[after], hashes[after], np.uint64(0))
            pair = _pair(first, second)
            many = np.uint64(routes.get(lang, 1))
            route = (pair % many).astype(np.int64)
            is_hot = np.isin(pair, hot)
            if is_hot.any():
                # The pair goes its own way without the third word, each third word goes another.
                more = is_hot & (third != 0)
                route = np.append(route, -1 - (mix(pair[more] + third[more]) % many).astype(np.int64))
                first, second = np.append(first, first[more]), np.append(second, second[more])
                third = np.append(np.where(is_hot, np.uint64(0), third), third[more])
            order = np.lexsort((third, second, first, route))
            first, second, third, route = first[order], second[order], third[order], route[order]
            new = np.ones(len(order), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (third[1:] != third[:-1]) | (route[1:] != route[:-1])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(order))).astype(np.uint32)
            first, second, third, route = first[head], second[head], third[head], route[head]
            edges = [0, *(np.flatnonzero(route[1:] != route[:-1]) + 1).tolist(), len(route)]
            for a, b in zip(edges, edges[1:], strict=False):
                out["lang"].append(lang)
                out["route"].append(int(route[a]))
                for k, v in (("first", first), ("second", second), ("third", third), ("n", n)):
                    out[k].append(v[a:b].tobytes())
        return out if out["n"] else None

    return map_texts(texts, scan, "lang string, route bigint, first binary, second binary, third binary, n binary", slice_bytes)


def _counter(least: int):
    def count(table: pa.Table) -> pa.RecordBatch | None:
        first, second, third = (np.frombuffer(b"".join(table[k].to_pylist()), np.uint64) for k in ("first", "second", "third"))
        weight = np.frombuffer(b"".join(table["n"].to_pylist()), np.uint32).astype(np.int64)
        # Pairs that even all of their hash's bucket do not make frequent are left out before the sort.
        bucket = (_pair(first, second) >> np.uint64(44)).astype(np.int64)
        keep = np.bincount(bucket, weights=weight)[bucket] >= least
        keys, weight = np.stack([first[keep], second[keep], third[keep]]), weight[keep]
        depth, suffix, total = quicksort_counts(keys, weight, least)
        of_hot = table["route"][0].as_py() < 0
        wanted = depth == 3 if of_hot else depth >= 2
        depth, suffix, total = depth[wanted], suffix[wanted], total[wanted]
        if not len(depth):
            return None
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([table["lang"][0].as_py()] * len(depth), pa.string()),
            "first": keys[0, suffix].view(np.int64), "second": keys[1, suffix].view(np.int64),
            "third": pa.array(keys[2, suffix].view(np.int64), mask=depth == 2), "a": total,
        })

    return complete_groups(count, "lang", "route")


def phrase_counts(docs: DataFrame, least: int = LEAST, route_words: int = ROUTE_WORDS, pair_count: int = PAIR_COUNT,
                  slice_bytes: int = SLICE_BYTES, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``(lang, hash, word, n)`` of frequent words and totals, and ``(lang, first, second, third, a)`` of frequent phrases, words as hashes."""
    texts = docs.select(docs["text"].cast("string").alias("text"), F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN)).alias("lang"))
    counted = materialize(word_counts(texts, slice_bytes, pair_count).filter((F.col("n") >= least) | F.col("hash").isNull()), "words")
    totals = {r["lang"]: r["n"] for r in counted.filter("hash IS NULL").filter(F.col("n") > route_words).collect()}
    routes = {lang: -(-n // route_words) for lang, n in totals.items()}
    # A hot pair is a share of a route, so their number is bounded by that of the routes.
    hot = counted.filter("word IS NULL AND hash IS NOT NULL").filter(F.col("n") >= HOT_SHARE * route_words).select("hash").distinct().toArrow()
    words = counted.filter("word IS NOT NULL")
    known = frequent_bits(words.select("hash"), filter_bits)
    routed = _routed(texts, known, np.sort(hot["hash"].to_numpy().view(np.uint64)), routes, slice_bytes)
    grouped = routed.repartition("lang", "route").sortWithinPartitions("lang", "route")
    phrases = grouped.mapInArrow(_counter(least), "lang string, first bigint, second bigint, third bigint, a bigint")
    return counted.filter("word IS NOT NULL OR hash IS NULL"), materialize(phrases, "phrases")


def _scored(cut: str, a: str = "a") -> str:
    """Association of both parts of a cut: decimals, since the products pass 64 bits."""
    return f"CAST({a} AS DECIMAL(19,0)) * CAST({a} AS DECIMAL(19,0)) * 1000000 DIV (CAST({cut}.l AS DECIMAL(19,0)) * CAST({cut}.r AS DECIMAL(19,0)))"


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, most: int | None = None, **limits: int) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of all phrases that no longer one covers.

    With ``most`` only the first ``most`` of each language, with their ``rank``.
    """
    counted, phrases = phrase_counts(docs, least, **limits)
    words = counted.filter("word IS NOT NULL").select("lang", "hash", F.col("word").cast("string").alias("word"), "n")
    totals = counted.filter("hash IS NULL").select("lang", "n")

    def word(place: str, name: str) -> DataFrame:
        return words.select("lang", F.col("hash").alias(place), F.col("word").alias(name), F.col("n").alias(f"{name}_n"))

    spelled = phrases.join(word("first", "w1"), ["lang", "first"]).join(word("second", "w2"), ["lang", "second"])
    pairs = spelled.filter("third IS NULL").select("lang", "first", "second", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a",
                                                   F.struct(F.col("w1_n").alias("l"), F.col("w2_n").alias("r")).alias("cut"))
    counts = phrases.filter("third IS NULL").drop("third")
    heads = counts.withColumnRenamed("a", "head")
    tails = counts.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("tail"))
    triples = (
        spelled.filter("third IS NOT NULL").join(word("third", "w3"), ["lang", "third"])
        .join(heads, ["lang", "first", "second"]).join(tails, ["lang", "second", "third"])
        .withColumns({"one": F.struct(F.col("w1_n").alias("l"), F.col("tail").alias("r")), "two": F.struct(F.col("head").alias("l"), F.col("w3_n").alias("r"))})
        .withColumn("cut", F.when(F.expr(_scored("two")) < F.expr(_scored("one")), F.col("two")).otherwise(F.col("one")))
        .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut")
    )
    # The most frequent longer phrase around each pair.
    longer = phrases.filter("third IS NOT NULL")
    around = longer.select("lang", "first", "second", "a").unionByName(
        longer.select("lang", F.col("second").alias("first"), F.col("third").alias("second"), "a")
    ).groupBy("lang", "first", "second").agg(F.max("a").alias("longer"))
    free = pairs.join(around, ["lang", "first", "second"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))
    ).select("lang", "phrase", "a", "cut")
    found = free.unionByName(triples).select("lang", "phrase", "a", "cut.l", "cut.r", F.expr(_scored("cut")).cast("bigint").alias("score"))
    if most is None:
        return found.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")
    return top(found, most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def top(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language, with their ``rank``; tasks send no more than that."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = materialize(found, "scored").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))

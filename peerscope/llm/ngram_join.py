"""N-gram Jaccard self-join with prefix trees, and the groups it forms.

A text's set holds the hashes of its distinct five-word shingles. Equal sets are
one class from the start. All tokens have one global order: frequent ones last,
the rest by hash. Two sets with a Jaccard similarity of at least ``percent`` share a
token among the first ``n - ceil(percent * n) + 1`` of each. What follows the
first shared token bounds their overlap, so its place in a set gives the largest
size that the other may have, the *reach*; sets whose reach is below their own
size are *probes*, and two probes are never linked. So classes that share such a
token, and whose sizes and reaches allow a link, go to the block of the smallest
of them, its centre.

In a block the sets form a compressed trie over one order of their tokens. A
query walks it once for all sets: shared beginnings are overlapped once, and a
subtree is left when neither its remaining length nor that of the query can
reach the overlap its sizes ask for. The centre is queried first; sets in its
group need not be compared with each other, since only the groups count. Every
other set is queried against the whole block. A block of more than
``block_sets`` sets is dealt over several tasks, each with the centre. Then the
sets outside of its group are dealt in parts of about ``block_sets``, as are those
inside, and every task gets two parts, unless both hold probes only or both
are of the group.

Which tokens count as frequent changes the work, never the result: the most
frequent ``order_tokens`` are shipped to the tasks.

Defined cases: null, empty and blank texts have an empty set and are alone; a
text of fewer than five words has its whole sequence as its one shingle; ties
in size or order do not matter; rows that repeat a ``doc_id`` each get a row and
belong to one group if their texts are linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.llm.hashing import BASE, Words, gram_hashes, mix, text_column
from peerscope.llm.texts import NO_ID, doc_texts, map_texts, most_frequent, public_id
from peerscope.operators.components import connected_components
from peerscope.session import materialize

SHINGLE = 5
PERCENT = 80
ORDER_TOKENS = 1 << 20
#: A token in fewer sets than this is not worth a place among the frequent ones.
MIN_FREQUENT = 4
BLOCK_SETS = 256
#: What a set is in a part of a block: the one that is queried first, one that is
#: queried if the centre does not link it, one that is queried in a tile of two
#: parts, one that is only compared with those.
CENTRE, MEMBER, ASKED, COMPARED = range(4)
_LOW_PART = np.uint64(int(0.25 * 2**64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes row after row, ascending, and the bounds of the rows."""
    words = Words(data, offsets, lower=True)
    n = len(offsets) - 1
    row, counts = words.rows(), words.counts()
    grams = gram_hashes(words.hashes, size)
    start = np.flatnonzero(row[:len(grams)] == row[size - 1:size - 1 + len(grams)]) if len(grams) else np.zeros(0, np.int64)
    token, owner = grams[start], row[start]
    # Texts with fewer words: one shingle of the whole sequence, its length in the hash.
    for few in range(1, size):
        short = np.flatnonzero(counts == few)
        if len(short):
            value = words.hashes[words.bounds[short]].copy()
            for j in range(1, few):
                value = value * BASE + words.hashes[words.bounds[short] + j]
            token = np.append(token, mix(value + np.uint64(few)))
            owner = np.append(owner, short)
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    return token, np.searchsorted(owner, np.arange(n + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def _class_keys(token: np.ndarray, bounds: np.ndarray, taken: dict[tuple[int, int], int] | None = None) -> np.ndarray:
    """A 64-bit name of each row's set; ``taken`` has other names for sets that share one, see ``set_classes``."""
    sizes = np.diff(bounds).astype(np.uint64)
    first = mix(_sums(mix(token ^ np.uint64(0x5851F42D4C957F2D)), bounds) + mix(_sums(token, bounds) + sizes)).view(np.int64)
    if taken:
        shared = np.flatnonzero(np.isin(first, np.array([k for k, _ in taken], np.int64)))
        second = _second_keys(token, bounds)
        for k in shared.tolist():
            first[k] = taken.get((int(first[k]), int(second[k])), first[k])
    return first


def _second_keys(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 more bits of each row's set."""
    return mix(_sums(mix(token + np.uint64(0x14057B7EF767814F)), bounds) ^ np.diff(bounds).astype(np.uint64)).view(np.int64)


def set_classes(texts: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """``(doc_id, n_shingles, class)``, where equal sets have one class, and the names of sets that had to give way.

    Two sets are equal if 128 bits of them are. Of different sets with one 64-bit
    name, all but one get another name, made of all their bits. Those are about
    one pair in 2**64, so the driver can hold them.
    """
    def scan(rows, data, offsets):
        token, bounds = shingle_sets(data, offsets)
        return {
            "doc_id": rows.column("doc_id"), "n_shingles": np.diff(bounds), "class": _class_keys(token, bounds), "second": _second_keys(token, bounds),
        }

    classes = materialize(map_texts(texts, scan, "doc_id bigint, n_shingles bigint, class bigint, second bigint"), "classes")
    seconds = classes.groupBy("class").agg(F.min("second").alias("stays"), F.max("second").alias("other")).filter("stays != other").drop("other")
    names = classes.join(seconds, "class").filter("second != stays").select("class", "second").distinct().collect()
    taken = {
        (r["class"], r["second"]): int.from_bytes(hashlib.blake2b(f"{r['class']} {r['second']}".encode(), digest_size=8).digest(), "little", signed=True) for r in names
    }
    if taken:
        renamed = texts.sparkSession.createDataFrame([(*key, name) for key, name in taken.items()], "class bigint, second bigint, name bigint")
        classes = materialize(classes.join(renamed, ["class", "second"], "left").withColumn("class", F.coalesce("name", "class")).drop("name"), "classes")
    return classes.drop("second"), taken


def frequent_tokens(texts: DataFrame, limit: int) -> np.ndarray:
    """The most frequent tokens with their counts' order, most frequent last.

    Counted over all texts. Beyond the low part of the hashes only tokens that a
    slice holds twice or more are sent, since only texts full of frequent tokens
    have a prefix that reaches so far.
    """
    def scan(rows, data, offsets):
        token, _ = shingle_sets(data, offsets)
        known, counts = np.unique(token, return_counts=True)
        sent = (known < _LOW_PART) | (counts > 1)
        return {"token": known[sent].view(np.int64), "n": counts[sent]}

    counted = map_texts(texts, scan, "token bigint, n bigint", 1 << 22).groupBy("token").agg(F.sum("n").alias("n"))
    tokens, counts = most_frequent(materialize(counted.filter(F.col("n") >= MIN_FREQUENT), "tokens"), limit)
    return tokens[np.lexsort((tokens, counts))]


def prefix_tokens(texts: DataFrame, frequent: np.ndarray, percent: int, taken: dict | None = None) -> DataFrame:
    """``(token, class, size, reach)``: the first tokens of each set in the global order.

    Two sets whose first shared token leaves ``l`` tokens of one, itself counted,
    have an overlap of at most ``l``, so the other's size is at most ``reach``.
    """
    order = np.argsort(frequent)
    shipped = texts.sparkSession.sparkContext.broadcast((frequent[order], order))

    def scan(rows, data, offsets):
        known, rank = shipped.value
        token, bounds = shingle_sets(data, offsets)
        key = _class_keys(token, bounds, taken)
        n = np.diff(bounds)
        _, first = np.unique(key, return_index=True)  # one row per class and slice
        keep = np.zeros(len(n), bool)
        keep[first] = True
        length = np.where(keep & (n > 0), n - (percent * n + 99) // 100 + 1, 0)
        owner = np.repeat(np.arange(len(n)), n)
        last = np.zeros(len(token), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, token), len(known) - 1)
            last = np.where(known[place] == token, rank[place] + 1, 0)
        order = np.lexsort((token, last, owner))
        within = np.arange(len(token)) - np.repeat(bounds[:-1], n)
        first = within < np.repeat(length, n)
        chosen = order[first]
        size = n[owner[chosen]]
        # 100 * l >= percent * (size + m - l)  <=>  m <= (100 + percent) * l / percent - size
        reach = (100 + percent) * (size - within[first]) // percent - size
        return {"token": token[chosen].view(np.int64), "class": key[owner[chosen]], "size": size.astype(np.int32), "reach": reach.astype(np.int32)}

    return map_texts(texts, scan, "token bigint, class bigint, size int, reach int")


def block_members(prefixes: DataFrame) -> DataFrame:
    """``(centre, class, probe)``: each class with the smallest class of every block that it is in.

    A class leaves a token's list where sizes and reaches allow it no link there,
    and the list is cut where no set before reaches the sizes after. ``probe``
    classes are not linked with each other in any list of the block.
    """
    by_size = Window.partitionBy("token").orderBy("size", "reach", "class")
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("reach") >= F.col("size")
    # Of two linked sets the smaller, or both if they are equal, is no probe.
    back = (F.max("reach").over(before) >= F.col("size")) & (F.min(F.when(full, F.col("size"))).over(before) <= F.col("reach"))
    ahead = F.lead("size").over(by_size) <= F.col("reach")
    far = F.coalesce(F.max("reach").over(before) < F.col("size"), F.lit(True))
    return (
        prefixes.withColumn("some", F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))).filter("some")
        .withColumn("head", F.when(far, F.col("class")))
        .withColumn("centre", F.last("head", ignorenulls=True).over(by_size))
        .filter("class != centre").groupBy("centre", "class").agg(F.min(~full).alias("probe"))
    )


def tiles(sets: DataFrame, block_sets: int) -> DataFrame:
    """``(centre, class, parts, part, role)``: parts of a block, two and two, where its ``sets`` may have a link left.

    ``sets`` holds ``(centre, class, probe, lonely)``; pairs of a lonely set with
    any other set meet in some tile, unless both are probes.
    """
    kinds = sets.withColumn("kind", 2 * F.col("lonely").cast("int") + (~F.col("probe")).cast("int"))
    sizes = kinds.groupBy("centre", "kind").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("of"))
    slot = F.col("kind") + 4 * F.col("number")
    dealt = kinds.join(sizes, ["centre", "kind"]).withColumn("number", F.pmod(F.xxhash64("class", "centre"), F.col("of")).cast("int")).select(
        "centre", "class", slot.alias("slot")
    )
    slots = sizes.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select("centre", slot.alias("slot"), "kind")
    others = slots.select("centre", F.col("slot").alias("other"), F.col("kind").alias("other_kind"))
    pairs = slots.filter("kind >= 2").join(others, "centre").filter(
        "(kind % 2 = 1 OR other_kind % 2 = 1) AND (other_kind < 2 OR slot <= other)"
    ).select("centre", "slot", "other", (F.col("slot").cast("bigint") * (1 << 31) + F.col("other")).alias("part"))
    sides = pairs.select("centre", "slot", "part", F.lit(ASKED).alias("role")).unionByName(
        pairs.filter("slot != other").select("centre", F.col("other").alias("slot"), "part", F.lit(COMPARED).alias("role"))
    )
    return dealt.join(sides, ["centre", "slot"]).select("centre", "class", F.lit(0).alias("parts"), "part", "role")


class Trie:
    """Sets as paths over one token order; chains of tokens without a branch are one node."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray):
        sizes = np.diff(bounds)
        self.vocabulary, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((self.vocabulary, -counts))] = np.arange(len(counts))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        path = rank[inverse]
        order = np.lexsort((path, owner))
        self.ids = path[order]  # per set, ascending in the order of the trie
        self.bounds, self.sizes = bounds, sizes
        paths = [self.ids[bounds[i]:bounds[i + 1]] for i in range(len(sizes))]
        by_path = sorted(range(len(sizes)), key=lambda i: paths[i].astype(">i8").tobytes())
        # Neighbouring paths share their common beginning: that is the trie.
        segments, nodes, stack = [], [], []
        self.roots: list[int] = []
        used = 0
        previous = None
        for i in by_path:
            own = paths[i]
            shared = 0
            if previous is not None:
                m = min(len(own), len(previous))
                differ = np.flatnonzero(own[:m] != previous[:m])
                shared = int(differ[0]) if len(differ) else m
            while stack and nodes[stack[-1]][1] > shared:
                top = nodes[stack[-1]]
                if top[0] >= shared:
                    stack.pop()
                else:
                    # Split the chain: its tail becomes a child that keeps what hung below.
                    tail = [shared, top[1], top[2] + shared - top[0], top[3], top[4], top[5], top[6]]
                    nodes.append(tail)
                    top[1], top[3], top[4] = shared, [len(nodes) - 1], []
                    break
            parent = stack[-1] if stack else None
            if len(own) > shared or parent is None:
                nodes.append([shared, len(own), used, [], [i], len(own), len(own)])
                segments.append(own[shared:])
                used += len(own) - shared
                number = len(nodes) - 1
                if parent is not None:
                    nodes[parent][3].append(number)
                else:
                    self.roots.append(number)
                stack.append(number)
            else:
                nodes[parent][4].append(i)
            for s in stack:
                nodes[s][5], nodes[s][6] = min(nodes[s][5], len(own)), max(nodes[s][6], len(own))
            previous = own
        self.nodes = nodes
        self.tokens = np.concatenate(segments) if segments else np.zeros(0, np.int64)

    def query(self, which: int, percent: int) -> list[int]:
        """Sets linked with set ``which``, itself left out."""
        own = self.ids[self.bounds[which]:self.bounds[which + 1]]
        size = len(own)
        inside = np.zeros(len(self.vocabulary) + 1, bool)
        inside[own] = True
        hits = np.concatenate([[0], np.cumsum(inside[self.tokens])])
        before = np.concatenate([[0], np.cumsum(inside)])  # own tokens up to a rank
        found, work = [], [(r, 0) for r in self.roots]
        while work:
            number, overlap = work.pop()
            start, end, at, children, members, low, high = self.nodes[number]
            overlap += int(hits[at + end - start] - hits[at])
            # 100 * o >= percent * (size + m - o)  <=>  (100 + percent) * o >= percent * (size + m)
            left = size - int(before[self.tokens[at + end - start - 1] + 1]) if end > start else size
            best = overlap + min(left, high - end)
            if (100 + percent) * best < percent * (size + low):
                continue
            found += [m for m in members if m != which and (100 + percent) * overlap >= percent * (size + self.sizes[m])]
            work += [(c, overlap) for c in children]
        return found


def _block(table: pa.Table, percent: int, taken: dict | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of one block as places of two of its rows, and which rows are in the centre's group.

    Of all links that are found those are kept that join two groups: fewer than rows.
    """
    data, offsets = text_column(table["text"].combine_chunks())
    token, bounds = shingle_sets(data, offsets)
    # Another text of a repeated id is not of the class; it takes no part.
    strange = _class_keys(token, bounds, taken) != table["class"].to_numpy()
    token, bounds = token[~np.repeat(strange, np.diff(bounds))], np.concatenate([[0], np.cumsum(np.diff(bounds) * ~strange)])
    trie = Trie(token, bounds)
    n = len(offsets) - 1
    role = table["role"].to_numpy()
    group = np.arange(n)
    links: list[tuple[int, int]] = []

    def join(i: int) -> None:
        for m in trie.query(i, percent):
            if group[m] != group[i]:
                links.append((i, m))
                group[group == group[m]] = group[i]

    # A set that has joined the centre's group need not be queried: one that is
    # outside of the group is, and would find it.
    first = np.flatnonzero((role == CENTRE) & ~strange)[:1]
    for i in [*first, *np.flatnonzero(~strange & ((role == ASKED) | ((role == MEMBER) & bool(len(first)))))]:
        if i in first or role[i] == ASKED or group[i] != group[first[0]]:
            join(i)
    linked = strange | (group == group[first[0]] if len(first) else False)
    return links, linked


def complete_groups(function: Callable[[pa.Table], pa.RecordBatch | None], *keys: str):
    """Hand each run of rows with equal ``keys``, which come sorted, to ``function`` whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for first, after in zip(edges, edges[1:], strict=False):
                now = tuple(c[first] for c in columns)
                if held and now != last:
                    out = function(pa.Table.from_batches(held))
                    held = []
                    if out is not None:
                        yield out
                held.append(batch.slice(first, after - first))
                last = now
        if held and (out := function(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _joiner(percent: int, taken: dict | None):
    def join(table: pa.Table) -> pa.RecordBatch | None:
        links, linked = _block(table, percent, taken)
        names = table["class"].to_numpy()
        lonely = np.flatnonzero(~linked & (table["role"].to_numpy() == MEMBER) & (table["parts"].to_numpy() > 1))
        u = [names[a] for a, _ in links] + [names[i] for i in lonely]
        v = [names[b] for _, b in links] + [table["centre"][0].as_py()] * len(lonely)
        if not u:
            return None
        kind = [0] * len(links) + [1] * len(lonely)
        return pa.RecordBatch.from_pydict({
            "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "unlinked": pa.array(kind, pa.int32()),
        })

    return complete_groups(join, "centre", "part")


def class_links(texts: DataFrame, classes: DataFrame, percent: int = PERCENT, order_tokens: int = ORDER_TOKENS, block_sets: int = BLOCK_SETS,
                taken: dict | None = None) -> DataFrame:
    """``(u, v)``: links between classes that connect every group of linked classes."""
    frequent = frequent_tokens(texts, order_tokens)
    members = materialize(block_members(prefix_tokens(texts, frequent, percent, taken)), "members")
    sizes = members.groupBy("centre").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("parts"))
    spread = members.join(sizes, "centre").withColumn("part", F.pmod(F.xxhash64("class", "centre"), F.col("parts")))
    centres = sizes.select(
        "centre", F.col("centre").alias("class"), "parts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("part")
    )
    dealt = spread.select("centre", "class", "parts", "part", F.lit(MEMBER).alias("role")).unionByName(
        centres.withColumn("role", F.lit(CENTRE))
    )
    # The text of one id stands for each class that is in a block.
    wanted = dealt.select("class").distinct().join(classes.groupBy("class").agg(F.min("doc_id").alias("doc_id")), "class")
    standing = materialize(texts.join(wanted, "doc_id").select("class", "text"), "texts")
    schema = "u bigint, v bigint, unlinked int"

    def joined(rows: DataFrame) -> DataFrame:
        blocks = rows.join(standing, "class").select("centre", "part", "parts", "role", "class", "text")
        return blocks.repartition("centre", "part").sortWithinPartitions("centre", "part", "role", "class").mapInArrow(_joiner(percent, taken), schema)

    first = materialize(joined(dealt), "links")
    # Only blocks of several parts have more to compare: their unlinked sets, with other parts.
    lonely = first.filter("unlinked = 1").select(F.col("u").alias("class"), F.col("v").alias("centre"), F.lit(True).alias("lonely"))
    sets = members.join(lonely.select("centre").distinct(), "centre", "left_semi").join(lonely, ["centre", "class"], "left")
    second = joined(tiles(sets.withColumn("lonely", F.coalesce("lonely", F.lit(False))), block_sets))
    return first.filter("unlinked = 0").select("u", "v").unionByName(second.select("u", "v")).filter("u != v").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, order_tokens: int = ORDER_TOKENS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the lowest ``doc_id`` that links reach."""
    texts = doc_texts(docs)
    classes, taken = set_classes(texts)
    some = classes.filter("n_shingles > 0")
    roots = connected_components(class_links(texts, some, percent, order_tokens, block_sets, taken))
    # Copies share a class and classes a root, so a class is one row on the way from
    # documents to groups, and both sides of a join are plain tables, whose hot keys are split.
    named = some.groupBy("class").agg(F.min("doc_id").alias("lowest"))
    rooted = materialize(
        named.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class")), "roots"
    )
    lowest = materialize(rooted.groupBy("root").agg(F.min("lowest").alias("component_id")), "lowest")
    groups = materialize(rooted.join(lowest, "root").select("class", "component_id"), "groups")
    grouped = some.join(groups, "class").select("doc_id", "n_shingles", "component_id")
    alone = classes.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = grouped.unionByName(alone)
    return out.withColumns({"component_id": F.when(F.col("component_id") != NO_ID, F.col("component_id")), "doc_id": public_id()})

"""A hidden Markov language model of words.

Latent states emit symbols. A symbol is one of the ``top_symbols`` most frequent
tokens, or one of the ``rare_symbols`` classes that all other tokens fall into by
hash; within a class a token has its smoothed share, so the model gives every
token a probability. Baum-Welch sums expected counts over all learning texts in
the tasks, and the driver, which only holds the states by symbols, sets the next
parameters. Learning takes texts in sequences of at most ``SEQUENCE`` tokens; a
text's likelihood is the scaled forward recursion over all its tokens at once,
exact for the model.

The vocabulary is counted whole. What it says about rare tokens is joined to the
texts by token: tokens of a text are summed per text first.

Defined cases: a null or empty text is its end token alone; without learning
texts N is 0, every token has probability 1 and scores are 0; rows that repeat
a ``doc_id`` each get their row; the words of a text are scored in one pass
however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.llm.hashing import Words, chunks, text_column
from peerscope.llm.texts import doc_texts, map_texts, most_frequent
from peerscope.session import materialize

STATES = 6
TOP_SYMBOLS = 1 << 14
#: So many of the most frequent tokens are settled in the scan, with their counts at hand.
SETTLED_TOKENS = 1 << 18
#: How many tokens' worth the unigram distribution weighs in each state's emissions.
PRIOR_TOKENS = 2000.0
#: A power of two.
RARE_SYMBOLS = 64
ROUNDS = 5
#: Learning cuts texts into sequences of at most so many tokens, and takes all of them.
SEQUENCE = 512
#: The end of a text; no word has this hash but by chance.
END = np.uint64(0x656E64)


def text_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes row after row, each row with its end, and the bounds of the rows."""
    words = Words(data, offsets, lower=True)
    n = len(offsets) - 1
    out = np.full(len(words.hashes) + n, END, np.uint64)
    out[np.arange(len(words.hashes)) + words.rows()] = words.hashes
    return out, words.bounds + np.arange(n + 1)


def vocabulary(texts: DataFrame) -> DataFrame:
    """``(token, n)`` over all texts, tokens summed in the tasks first."""
    def count(rows, data, offsets):
        token, counts = np.unique(text_tokens(data, offsets)[0], return_counts=True)
        return {"token": token.view(np.int64), "n": counts}

    return map_texts(texts, count, "token bigint, n bigint", 1 << 22).groupBy("token").agg(F.sum("n").alias("n"))


def _rare_class() -> Column:
    """The class of a rare token: the low bits of its hash."""
    return F.col("token").bitwiseAND(F.lit(RARE_SYMBOLS - 1)).cast("int")


@dataclass
class Model:
    """Parameters, and the symbols' tokens in ascending order of their hash."""

    tokens: np.ndarray
    counts: np.ndarray
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states, sums to 1 over symbols
    total: int
    distinct: int
    rare_total: np.ndarray
    rare_distinct: np.ndarray

    def symbols(self, token: np.ndarray) -> np.ndarray:
        rare = len(self.tokens) + (token % np.uint64(RARE_SYMBOLS)).astype(np.int64)
        if not len(self.tokens):
            return rare
        place = np.minimum(np.searchsorted(self.tokens, token), len(self.tokens) - 1)
        return np.where(self.tokens[place] == token, place, rare)


def initial(counted: DataFrame, states: int = STATES, top_symbols: int = TOP_SYMBOLS, seed: int = 11) -> Model:
    """Parameters around the unigram distribution, jittered so that states can part; states tend to stay."""
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, counts = most_frequent(counted, top_symbols)
    order = np.argsort(tokens)
    tokens, counts = tokens[order], counts[order].astype(np.int64)
    known = counted.sparkSession.createDataFrame(pa.table({"token": pa.array(tokens.view(np.int64))}))
    rare = counted.join(F.broadcast(known), "token", "left_anti").groupBy(_rare_class().alias("bucket")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v")
    ).collect()
    rare_total, rare_distinct = np.zeros(RARE_SYMBOLS, np.int64), np.zeros(RARE_SYMBOLS, np.int64)
    for r in rare:
        rare_total[r["bucket"]], rare_distinct[r["bucket"]] = r["n"], r["v"]
    random = np.random.default_rng(seed)
    mass = np.concatenate([counts, rare_total]) + 0.5
    emit = mass[:, None] * random.uniform(0.1, 1.9, (len(mass), states))
    move = random.uniform(0.5, 1.5, (states, states)) + 20 * states * np.eye(states)
    return Model(
        tokens, counts, np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0),
        int(sums["n"]), int(sums["v"]), rare_total, rare_distinct,
    )


def _steps(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows from the longest, their lengths, and how many are still running at each step."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    alive = len(length) - np.searchsorted(np.sort(length), np.arange(longest), side="right")
    return order, length, alive


def forward(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each row, all rows advanced together."""
    order, _, alive = _steps(bounds)
    first = bounds[:-1][order]
    out = np.zeros(len(order))
    alpha = None
    for step, running in enumerate(alive):
        emit = model.emit[symbols[first[:running] + step]]
        alpha = model.start * emit if step == 0 else (alpha[:running] @ model.move) * emit
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        out[:running] += np.log(scale)
    result = np.zeros(len(order))
    result[order] = out
    return result


def cut_sequences(bounds: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the rows cut into sequences of at most ``longest``, and which of them begin a row."""
    pieces = np.maximum(-(-np.diff(bounds) // longest), 1)
    row = np.repeat(np.arange(len(pieces)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.append(bounds[row] + number * longest, bounds[-1]), number == 0


def expected_counts(model: Model, symbols: np.ndarray, bounds: np.ndarray, fresh: np.ndarray | None = None):
    """Expected starts, moves and emissions of some rows (forward and backward pass).

    Rows that are not ``fresh`` go on from a row before; they begin in the
    states' long-run shares, and are not counted as starts.
    """
    order, length, alive = _steps(bounds)
    states = len(model.start)
    fresh = np.ones(len(order), bool) if fresh is None else fresh[order]
    begin = np.where(fresh[:, None], model.start, model.start @ np.linalg.matrix_power(model.move, 64))
    first = bounds[:-1][order]
    # Rows lie one after the other per step, so a pass reads contiguous memory.
    place = np.concatenate([[0], np.cumsum(alive)])
    alpha, scales = np.empty((len(symbols), states)), np.empty(len(symbols))
    at = np.empty(len(symbols), np.int64)
    for step, running in enumerate(alive):
        own = slice(place[step], place[step] + running)
        at[own] = symbols[first[:running] + step]
        emit = model.emit[at[own]]
        now = begin[:running] * emit if step == 0 else (alpha[place[step - 1]:place[step - 1] + running] @ model.move) * emit
        scales[own] = now.sum(axis=1)
        alpha[own] = now / scales[own][:, None]
    beta = np.ones((int(alive[0]) if len(alive) else 0, states))
    gamma = np.empty_like(alpha)
    moves = np.zeros((states, states))
    for step in range(len(alive) - 1, -1, -1):
        running = alive[step]
        own = slice(place[step], place[step] + running)
        gamma[own] = alpha[own] * beta[:running]
        if step:
            pull = model.emit[at[own]] * beta[:running] / scales[own][:, None]
            moves += alpha[place[step - 1]:place[step - 1] + running].T @ pull
            beta[:running] = pull @ model.move.T
    emissions = np.stack([np.bincount(at, weights=gamma[:, k], minlength=len(model.emit)) for k in range(states)], axis=1)
    starts = gamma[:int(alive[0])][fresh[:int(alive[0])]].sum(axis=0) if len(alive) else np.zeros(states)
    return starts, moves * model.move, emissions


def learn(texts: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Baum-Welch; each task sums its counts before they are shuffled, by row of the parameters."""
    states, size = len(model.start), len(model.emit)

    for _ in range(rounds):
        shipped = texts.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            model = shipped.value
            total = np.zeros((1 + states + size, states))
            for batch in batches:
                data, offsets = text_column(batch.column("text"))
                for a, b in chunks(offsets, 1 << 21):
                    token, bounds = text_tokens(data, offsets[a:b + 1])
                    bounds, fresh = cut_sequences(bounds, SEQUENCE)
                    starts, moves, emissions = expected_counts(model, model.symbols(token), bounds, fresh)
                    total[0] += starts
                    total[1:1 + states] += moves
                    total[1 + states:] += emissions
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_pydict({"row": some, **{f"s{k}": total[some, k] for k in range(states)}})

        names = [f"s{k}" for k in range(states)]
        schema = ", ".join(["row bigint", *[f"{n} double" for n in names]])
        summed = texts.mapInArrow(expect, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        total = np.zeros((1 + states + size, states))
        total[summed["row"].to_numpy()] = np.stack([summed[n].to_numpy() for n in names], axis=1)
        unigram = np.concatenate([model.counts, model.rare_total]) + 0.5
        emissions = total[1 + states:] + PRIOR_TOKENS * (unigram / unigram.sum())[:, None]
        model = Model(
            model.tokens, model.counts, (total[0] + 0.1) / (total[0] + 0.1).sum(),
            (total[1:1 + states] + 0.1) / (total[1:1 + states] + 0.1).sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0),
            model.total, model.distinct, model.rare_total, model.rare_distinct,
        )
    return model


def score(docs: DataFrame, counted: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every text.

    Frequent tokens are settled in the scan; of the others each text sends the
    distinct ones to the vocabulary.
    """
    tokens, counts = most_frequent(counted, SETTLED_TOKENS)
    order = np.argsort(tokens)
    shipped = docs.sparkSession.sparkContext.broadcast((model, tokens[order], counts[order]))
    texts = doc_texts(docs)

    def scan(rows, data, offsets):
        model, known, known_counts = shipped.value
        token, bounds = text_tokens(data, offsets)
        n = len(bounds) - 1
        symbols = model.symbols(token)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        frequent, base, share = np.zeros(len(token), bool), np.zeros(n), np.zeros(n)
        if len(known):
            place = np.minimum(np.searchsorted(known, token), len(known) - 1)
            frequent = known[place] == token
            own = known_counts[place[frequent]] + 0.5
            base = np.bincount(owner[frequent], weights=np.log10(own / (model.total + 0.5 * (model.distinct + 1))), minlength=n)
            # Tokens without a symbol of their own have their share of the class.
            kind = symbols[frequent] - len(model.tokens)
            size = (model.rare_total + 0.5 * (model.rare_distinct + 1))[np.maximum(kind, 0)]
            share = np.bincount(owner[frequent], weights=np.where(kind >= 0, np.log10(own / size), 0), minlength=n)
        rare = np.flatnonzero(~frequent)
        order = rare[np.lexsort((token[rare], owner[rare]))]
        new = np.ones(len(order), bool)
        new[1:] = (token[order][1:] != token[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        head = np.flatnonzero(new)
        times = np.diff(np.append(head, len(order)))
        likelihood = forward(model, symbols, bounds) / np.log(10) + share
        edges = np.searchsorted(owner[order[head]], np.arange(n + 1))
        values = pa.StructArray.from_arrays([pa.array(token[order[head]].view(np.int64)), pa.array(times)], names=["token", "times"])
        return {
            "doc_id": rows.column("doc_id"), "n_tokens": np.diff(bounds),
            "n_frequent": np.bincount(owner[frequent], minlength=n), "base": base, "likelihood": likelihood, "rare": pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values),
        }

    scanned = map_texts(
        texts, scan,
        "doc_id bigint, n_tokens bigint, n_frequent bigint, base double, likelihood double, rare array<struct<token:bigint,times:bigint>>",
        1 << 22,
    )
    # Rows get a number of their own, written with them, so that repeated ids stay apart.
    scanned = materialize(scanned.withColumn("number", F.monotonically_increasing_id()), "scanned")
    classes = docs.sparkSession.createDataFrame(
        [(k, int(n), int(v)) for k, (n, v) in enumerate(zip(model.rare_total, model.rare_distinct, strict=True))],
        "bucket int, class_total bigint, class_distinct bigint",
    )
    count = F.coalesce(F.col("n"), F.lit(0))
    base = F.log10((count + 0.5) / F.lit(model.total + 0.5 * (model.distinct + 1)))
    share = F.log10((count + 0.5) / (F.col("class_total") + 0.5 * (F.col("class_distinct") + 1)))
    rare = (
        scanned.select("number", F.inline("rare"))
        .join(counted, "token", "left")
        .withColumn("bucket", _rare_class())
        .join(F.broadcast(classes), "bucket")
        .groupBy("number").agg(
            F.sum(F.col("times") * base).alias("rare_base"), F.sum(F.col("times") * share).alias("rare_share"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    zero = F.lit(0.0)
    return scanned.drop("rare").join(rare, "number", "left").select(
        "doc_id", "n_tokens", (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("likelihood") + F.coalesce("rare_share", zero)).alias("score"),
    )


def fit_and_score(docs: DataFrame, learning: DataFrame, states: int = STATES, top_symbols: int = TOP_SYMBOLS, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the texts of ``learning`` and score those of ``docs``."""
    texts = doc_texts(learning)
    counted = materialize(vocabulary(texts), "vocabulary")
    return score(docs, counted, learn(texts, initial(counted, states, top_symbols), rounds))

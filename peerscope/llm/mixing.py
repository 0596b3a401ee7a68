"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of source, language and topic. The cells' token
weights are raked to the target of each dimension in turn; a weight never exceeds
its cell's tokens, so the ratio of the two is the chance of each of the cell's
documents, and a hash of the id decides. Rounds go on in blocks until no marginal
misses its target by more than ``TOLERANCE``, or for ``MAX_ROUNDS``.

A target that asks for more tokens than a value has is not feasible: the value
gives all it has, and the others of its dimension share the rest by their targets.
``marginals`` tells what was wanted, what was feasible and what is attained.

DataFrame functions throughout. Sums are combined in the tasks first, so a source
that holds a third of all rows sends one row per task and cell. Rounds are windows
over the cells, of which ``CELLS_PER_TASK`` share a task; a block of rounds is one
job. Cells join back to documents by their size.

``text_topic`` stands in for a topic of the caller's, which ``topic`` names.

Defined cases: a null source, language or topic is the value ``(none)``; a null
or empty text has no tokens and, in a cell without any, probability 0; a target
value that no document has is left out and the others share its part, a value
without a target is not drawn; rows that repeat a ``doc_id`` are all kept or all
dropped; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerscope.llm.texts import row_struct
from peerscope.session import materialize

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
#: Rounds between two looks at the marginals, the most rounds, and the largest error that is left.
ROUNDS, MAX_ROUNDS, TOLERANCE = 8, 128, 5e-3
CELLS_PER_TASK = 1 << 16
#: Share of all tokens to keep, and the power of a value's tokens that its target share follows.
KEEP = 0.5
POWERS = {"source": 0.0, "lang": 0.5, "topic": 0.75}
SEED = "mix"


def text_topic(text: Column) -> Column:
    """A topic by what the text holds."""
    whole = F.coalesce(text, F.lit(""))
    return (
        F.when(whole.contains("@"), "contact").when(F.lower(whole).contains("license"), "legal")
        .when(whole.contains(" | "), "table").otherwise("prose")
    )


def tagged(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` as a struct ``row``, with id, text, dimensions and tokens beside it."""
    values = {
        "source": docs["source"], "lang": docs["lang"], "topic": text_topic(docs["text"]) if topic is None else topic,
    }
    return docs.select(
        row_struct(docs), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"),
        *[F.coalesce(v.cast("string"), F.lit(NONE)).alias(k) for k, v in values.items()],
        F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
    )


def cell_tokens(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def tempered_targets(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """``(value, share)`` per dimension: tokens to a power, in any unit."""
    targets = {}
    for name, power in powers.items():
        sums = cells.groupBy(name).agg(F.sum("tokens").alias("n")).filter("n > 0")
        targets[name] = sums.select(name, F.pow(F.col("n").cast("double"), F.lit(power)).alias("share"))
    return targets


def feasible_targets(cells: DataFrame, name: str, shares: DataFrame, keep: float) -> DataFrame:
    """``(value, wanted, target)``: the share wanted of the draw, and tokens that the value can give.

    Targets are ``least(tokens, level * share)`` at the one level that meets the
    budget. The level rises from that of all values to that of those which still
    have tokens left, one aggregate a step.
    """
    sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("n"))
    own = materialize(sums.filter("n > 0").join(shares, name, "left").withColumn("share", F.coalesce("share", F.lit(0.0))), "targets")
    total, parts = own.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("share"), F.lit(0.0))).first()
    budget = keep * total
    level, before = budget / parts if parts else 0.0, -1.0
    while level > before:
        full = F.col("n") <= F.lit(level) * F.col("share")
        given, left = own.agg(F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("share"))), F.lit(0.0))).first()
        before, level = level, max(level, (budget - given) / left) if left else level
    return own.select(
        name, (F.col("share") / (parts or 1.0)).alias("wanted"), F.least("n", F.lit(level) * F.col("share")).alias("target")
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``cells`` with ``weight``, at most their tokens, and the largest ``error`` of their marginals against ``targets``."""
    start = cells.withColumn("weight", F.lit(keep) * F.col("tokens").cast("double"))
    for name, target in targets.items():
        start = start.join(target.select(name, F.col("target").alias(f"{name}_target")), name, "left")
    fitted = materialize(start.withColumn("error", F.lit(None).cast("double")).fillna(0.0, [f"{name}_target" for name in targets]), "weights")
    tasks = -(-max(fitted.count(), 1) // CELLS_PER_TASK)
    for _ in range(0, max_rounds, ROUNDS):
        fitted = fitted.coalesce(tasks)
        for _ in range(ROUNDS):
            for name in targets:
                now = F.sum("weight").over(Window.partitionBy(name))
                raked = F.when(now > 0, F.col("weight") * (F.col(f"{name}_target") / now)).otherwise(0.0)
                fitted = fitted.withColumn("weight", F.least(F.col("tokens").cast("double"), raked))
        misses = []
        for name in targets:
            target = F.col(f"{name}_target")
            misses.append(F.when(target > 0, F.abs(F.sum("weight").over(Window.partitionBy(name)) / target - 1)).otherwise(0.0))
        fitted = materialize(fitted.withColumn("error", F.greatest(F.lit(0.0), *misses)), "weights")
        if (fitted.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
    return fitted


def marginals(fitted: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``(dimension, value, wanted, feasible, attained)``: shares of the drawn tokens, expected."""
    total = fitted.agg(F.sum("weight")).first()[0] or 1.0
    out = None
    for name, target in targets.items():
        own = fitted.groupBy(name).agg(F.sum("weight").alias("weight")).join(target, name).select(
            F.lit(name).alias("dimension"), F.col(name).alias("value"), "wanted", (F.col("target") / total).alias("feasible"),
            (F.col("weight") / total).alias("attained"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def fit(docs: DataFrame, keep: float = KEEP, powers: dict[str, float] | None = None, shares: dict[str, DataFrame] | None = None,
        topic: Column | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The raked cells and the targets of each dimension; ``shares`` has ``(value, share)`` per dimension in place of tempered ones."""
    cells = materialize(cell_tokens(tagged(docs, topic)), "cells")
    given = shares or tempered_targets(cells, powers or POWERS)
    targets = {name: materialize(feasible_targets(cells, name, own, keep), "targets") for name, own in given.items()}
    return rake(cells, targets, keep), targets


def draw(docs: DataFrame, fitted: DataFrame, topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """``(row, doc_id, text, source, lang, topic, tokens, probability, kept)`` for every document."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    chances = materialize(fitted.select(*DIMENSIONS, ratio.alias("probability")), "chances")
    return tagged(docs, topic).join(chances, list(DIMENSIONS)).withColumn("kept", chance(F.col("doc_id"), seed) < F.col("probability"))


def mix(docs: DataFrame, keep: float = KEEP, powers: dict[str, float] | None = None, shares: dict[str, DataFrame] | None = None,
        topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """``fit`` and ``draw``: every document with its probability and whether it is kept."""
    return draw(docs, fit(docs, keep, powers, shares, topic)[0], topic, seed)

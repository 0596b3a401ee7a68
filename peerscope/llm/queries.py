"""One query per operator over the given tables, and its DuckDB twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.llm import collocations, compression_quality, conversation_repair, decontamination, hmm, language_id, lz_dedup, mixing, ngram_join, packing, quality_rules, suffix_dedup, toxicity
from peerscope.llm.texts import doc_texts, fold, public_id, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[build.__name__] = build
    return build


def with_fold(scored: DataFrame, parts: int, held: int) -> DataFrame:
    """``scored`` with the caller's ids and whether each row was kept from learning."""
    return scored.withColumn("held_out", fold(F.col("doc_id"), parts) == held).withColumn("doc_id", public_id())


def learning_rows(docs: DataFrame, parts: int, held: int) -> DataFrame:
    return docs.filter(fold(docs["doc_id"].cast("long"), parts) != held)


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents")).drop("spans")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled_bags(learning_rows(docs, 3, 1), labels, "toxic"))
    scored = with_fold(toxicity.score(docs, model), 3, 1)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    learned = language_id.prototypes(learning_rows(docs, 3, 1))
    return with_fold(language_id.identify(docs, learned), 3, 1).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = compression_quality.fit(learning_rows(docs, 5, 0), labels, "quality")
    scored = with_fold(compression_quality.score(docs, model), 5, 0)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.references(docs))


@query
def op8_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = with_fold(hmm.fit_and_score(docs, learning_rows(docs, 5, 1)), 5, 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op10_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    factored = lz_dedup.factor_documents(read_table(spark, sf_dir, "documents"))
    return factored.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read_table(spark, sf_dir, "documents"))
    return packing.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query
def op12_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return conversation_repair.digest(conversation_repair.repair(conversation_repair.damage(conversations)), conversations)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), most=2000)


#: Lower-cases A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _mixing_sql() -> str:
    """The raking written out, one step per dimension and round."""
    steps = [r"""
        d AS (
          SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
                 CASE WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(lower(coalesce(text, '')), 'license') THEN 'legal'
                      WHEN contains(coalesce(text, ''), ' | ') THEN 'table' ELSE 'prose' END AS topic,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
          FROM documents
        ), cells AS (
          SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL
        )""", f"budget AS (SELECT {mixing.KEEP} * sum(tokens) AS budget FROM cells)"]
    names = list(mixing.POWERS)
    for name, power in mixing.POWERS.items():
        # The level at which values give what they can and the others fill the budget.
        steps.append(f"""m_{name} AS (
          SELECT {name}, n, pow(n, {power}) AS share FROM (SELECT {name}, CAST(sum(tokens) AS DOUBLE) AS n FROM cells GROUP BY 1) WHERE n > 0
        ), q_{name} AS (
          SELECT n / share AS q, (budget - coalesce(sum(n) OVER (ORDER BY n / share, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(share) OVER (ORDER BY n / share, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM m_{name}, budget
        ), t_{name} AS MATERIALIZED (
          SELECT {name}, least(n, share * (SELECT arg_min(level, q) FROM q_{name} WHERE level <= q)) AS {name}_target FROM m_{name}
        )""")
    steps.append(f"""w0 AS MATERIALIZED (
          SELECT source, lang, topic, tokens, {", ".join(f"coalesce({n}_target, 0) AS {n}_target" for n in names)}, {mixing.KEEP} * CAST(tokens AS DOUBLE) AS weight
          FROM cells {" ".join(f"LEFT JOIN t_{n} USING ({n})" for n in names)}
        )""")
    own = f"source, lang, topic, tokens, {', '.join(f'{n}_target' for n in names)}"
    table = "(SELECT * FROM rounds WHERE NOT done)"
    for name in names:
        now = f"sum(weight) OVER (PARTITION BY {name})"
        table = f"(SELECT {own}, step, least(tokens, CASE WHEN {now} > 0 THEN weight * ({name}_target / {now}) ELSE 0 END) AS weight FROM {table})"
    error = ", ".join(f"CASE WHEN {n}_target > 0 THEN abs(sum(weight) OVER (PARTITION BY {n}) / {n}_target - 1) ELSE 0 END" for n in names)
    steps.append(f"""rounds AS (
          SELECT {own}, 0 AS step, weight, false AS done FROM w0
          UNION ALL
          SELECT {own}, step + 1, weight, step + 1 >= {mixing.MAX_ROUNDS} OR ((step + 1) % {mixing.ROUNDS} = 0 AND max(error) OVER () <= {mixing.TOLERANCE})
          FROM (SELECT *, greatest({error}) AS error FROM {table})
        )""")
    return f"""
        WITH RECURSIVE {", ".join(steps)}, chances AS (
          SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS p FROM rounds WHERE done
        )
        SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability,
               CAST('0x' || substr(md5('{mixing.SEED}' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept
        FROM d JOIN chances USING (source, lang, topic)
    """


ORACLES: dict[str, str] = {
    "op2_mixing": _mixing_sql(),
    "op9_decontamination": rf"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
          SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                 regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
          SELECT DISTINCT item, least(len(w), 13) AS l,
                 array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS t
          FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ), dw AS (
          SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS t
          FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
                FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)
        ), hit AS (
          SELECT doc_id, dw.l, i, item FROM dw JOIN bw ON dw.t = bw.t AND dw.l = bw.l
        ), words AS (
          SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY 1
        ), items AS (
          SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256,
               coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op13_collocations": rf"""
        WITH p AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), s AS (
          SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
        ), g AS (
          SELECT lang, k, list_slice(w, i, i + k - 1) AS g
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)
        ), f AS (
          SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL
        ), c AS MATERIALIZED (
          SELECT * FROM f WHERE k >= 2 AND a >= 10
        ), halves AS (
          SELECT lang, g, a, cut, list_slice(g, 1, cut) AS x, list_slice(g, cut + 1, k) AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
        ), cuts AS (
          SELECT h.lang, h.g, h.a, cut, fx.a AS l, fy.a AS r,
                 CAST((1000000::HUGEINT * h.a * h.a) // (fx.a::HUGEINT * fy.a) AS BIGINT) AS score
          FROM halves h JOIN f fx ON fx.lang = h.lang AND fx.g = h.x JOIN f fy ON fy.lang = h.lang AND fy.g = h.y
        ), least AS (
          SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
        ), inner_pairs AS (
          SELECT lang, unnest([list_slice(g, 1, 2), list_slice(g, 2, 3)]) AS g, a AS longer FROM c WHERE k = 3
        ), gone AS (
          SELECT DISTINCT c.lang, c.g FROM c JOIN inner_pairs t ON t.lang = c.lang AND t.g = c.g WHERE 100 * t.longer >= 50 * c.a
        ), ranked AS (
          SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
                 row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
          FROM least ANTI JOIN gone USING (lang, g)
        )
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM ranked JOIN (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1) USING (lang) WHERE rank <= 2000
    """,
    "op10_lz_dedup": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), g AS (
          SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS t
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
        ), late AS (
          SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM g) WHERE k > 1
        ), gone AS (
          SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late
        ), words AS (
          SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
        ), kept AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
          FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
}

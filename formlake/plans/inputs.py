"""Frames of the operators' input shapes, derived from the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions.arrays import each
from formlake.functions.text import split_words
from formlake.operators import augment
from formlake.plans.registry import table

CORRUPT_SEED = "36"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document with its words."""
    return table(spark, sf, "documents").select("doc_id", "lang", "source", split_words(F.col("text")).alias("words"))


def doc_key(seed: str = CORRUPT_SEED) -> Column:
    return F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))


def corrupted(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a query, a quarter of its words replaced from the word bank."""
    bank, size = augment.fixed_bank()
    words = augment.corrupt_from_bank(F.col("words"), doc_key(), bank, size)
    return docs(spark, sf).select(F.col("doc_id").alias("query_id"), words.alias("words"))


# ---- the same frames in SQL ------------------------------------------------------------

BANK_SQL = "[" + ",".join(f"'{w}'" for w in augment.WORD_BANK) + "]"


def hash_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


DOCS = r"""docs AS (
  SELECT doc_id, lang, source, regexp_extract_all(text, '[^ \t\r\n]+') AS words FROM documents)"""

WORDS = """words AS (
  SELECT doc_id, generate_subscripts(words, 1) - 1 AS i, unnest(words) AS w, len(words) AS n FROM docs)"""

TOKENS = """token_lists AS (
  SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM documents),
tokens AS (
  SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN ['empty'] ELSE t END) AS token FROM token_lists)"""

POSTINGS = """tf AS (SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf)::DOUBLE AS doc_len FROM tf GROUP BY ALL),
stats AS (SELECT count(*)::DOUBLE AS n, sum(doc_len) / count(*) AS mean_len FROM lens),
df AS (SELECT token, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
postings AS (
  SELECT doc_id, token, round(ln(1 + (n - df + 0.5) / (df + 0.5))
     * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / mean_len))) * 1000000)::BIGINT AS weight
  FROM tf JOIN lens USING (doc_id) JOIN df USING (token), stats)"""

CORRUPTED = f"""picked AS (
  SELECT doc_id, i, n, w,
    row_number() OVER (PARTITION BY doc_id ORDER BY md5('{CORRUPT_SEED}:' || doc_id || ':' || i)) AS r,
    {BANK_SQL}[{hash_sql(f"'{CORRUPT_SEED}:' || doc_id || ':' || i || ':word'")} % 10 + 1] AS new_word
  FROM words),
corrupted AS (
  SELECT doc_id AS query_id, i, n, (r <= least(n, greatest(1, round_even(n * 0.25, 0)))) AS replaced,
    CASE WHEN r <= least(n, greatest(1, round_even(n * 0.25, 0))) THEN new_word ELSE w END AS w
  FROM picked),
query_tokens AS (
  SELECT query_id, lower(unnest(regexp_extract_all(w, '[A-Za-z0-9]+'))) AS token FROM corrupted),
query_terms AS (
  SELECT query_id, token, count(*) AS tf FROM (
    SELECT * FROM query_tokens UNION ALL
    SELECT doc_id, 'empty' FROM documents WHERE doc_id NOT IN (SELECT query_id FROM query_tokens)) GROUP BY ALL)"""

RETRIEVAL = f"WITH {DOCS},\n{WORDS},\n{TOKENS},\n{POSTINGS},\n{CORRUPTED}"

SCORES = """hits AS (
  SELECT query_id, doc_id, sum(q.tf * p.weight)::BIGINT AS units
  FROM query_terms q JOIN postings p USING (token) GROUP BY ALL),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, coalesce(units, 0) AS units
  FROM documents q CROSS JOIN documents d
  LEFT JOIN hits h ON h.query_id = q.doc_id AND h.doc_id = d.doc_id)"""


# ---- pages: documents laid out in rows of eight words ------------------------------------


def page_boxes(words: Column) -> Column:
    def box(w: Column, i: Column) -> Column:
        x0 = (i % 8) * 120
        y0 = F.floor(i / 8).cast("int") * 40 + F.length(w) % 3
        return F.array(x0, y0, x0 + F.length(w) * 10, y0 + 20)

    return F.transform(words, box)


def page_labels(words: Column) -> Column:
    def label(w: Column, i: Column) -> Column:
        at = i % 8
        return (
            F.when((F.length(w) % 5 == 0) | at.isin(2, 6, 7), "O").when(at == 0, "B-KEY").when(at == 1, "I-KEY")
            .when(at == 3, "B-VAL").otherwise("I-VAL")
        )

    return F.transform(words, label)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document with words, pixel boxes, BIO labels and scores."""
    w = F.col("words")
    return table(spark, sf, "documents").select("doc_id", "source", split_words(F.col("text")).alias("words")).select(
        "doc_id", "source", "words", page_boxes(w).alias("boxes"), page_labels(w).alias("labels"),
        F.transform(w, lambda x: (50 + F.length(x) % 50) / 100).alias("scores"), F.size("words").alias("n_words"),
    )


def words_long(page_rows: DataFrame) -> DataFrame:
    """Word rows (doc_id, word_idx, n_words, text, label, score, x0, y0, x1, y1)."""
    zipped = F.arrays_zip("words", "boxes", "labels", "scores")
    rows = each(page_rows, ["doc_id", "n_words"], zipped, "z", "word_idx")
    at = [F.get("z.boxes", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("doc_id", "word_idx", "n_words", F.col("z.words").alias("text"), F.col("z.labels").alias("label"), F.col("z.scores").alias("score"), *at)


PAGE = f"""{DOCS},
{WORDS},
page AS (
  SELECT doc_id, i::INT AS i, n, w, length(w) AS len, (i % 8) * 120 AS x0, (i // 8) * 40 + length(w) % 3 AS y0,
    (i % 8) * 120 + length(w) * 10 AS x1, (i // 8) * 40 + length(w) % 3 + 20 AS y1, (50 + length(w) % 50) / 100 AS score,
    CASE WHEN length(w) % 5 = 0 OR i % 8 IN (2, 6, 7) THEN 'O' WHEN i % 8 = 0 THEN 'B-KEY' WHEN i % 8 = 1 THEN 'I-KEY'
      WHEN i % 8 = 3 THEN 'B-VAL' ELSE 'I-VAL' END AS label
  FROM words)"""


def spans_sql(source: str, out: str, label: str = "label") -> str:
    """Runs of one type; `starts_b` tells whether a B- label opened the run."""
    return f"""{out}_runs AS (
  SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT *, CASE WHEN typ <> 'O' AND ({label} LIKE 'B-%' OR coalesce(lag(typ) OVER (PARTITION BY doc_id ORDER BY i), 'O') <> typ) THEN 1 ELSE 0 END AS st
    FROM (SELECT *, CASE WHEN {label} = 'O' THEN 'O' ELSE substr({label}, 3) END AS typ FROM {source}))),
{out} AS (
  SELECT doc_id, (run - 1)::INT AS span_id, any_value(typ) AS type, min(i) AS first, max(i) AS last, string_agg(w, ' ' ORDER BY i) AS text,
    avg(score) AS score, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min({label}, i) LIKE 'B-%' AS starts_b
  FROM {out}_runs WHERE typ <> 'O' GROUP BY doc_id, run)"""


SPANS = f"{PAGE},\n{spans_sql('page', 'spans')}"
STRICT = f"""{SPANS},
strict AS (
  SELECT * REPLACE ((row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS span_id, round_even(score, 4) AS score)
  FROM spans WHERE starts_b)"""

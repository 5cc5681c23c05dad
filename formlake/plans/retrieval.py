"""Retrieval queries: every document is a template, and corrupted copies look for their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions import arrays
from formlake.functions.text import tokenize, vector_literal
from formlake.operators import blocks, ranking, retrieval
from formlake.plans import inputs
from formlake.plans.inputs import RETRIEVAL, SCORES
from formlake.plans.registry import query, table
from formlake.session import cut

GRID = retrieval.GRID
SHORTLISTS = (25, 50, 100)
ALPHAS = (0.9, 0.7, 0.5, 0.3)


def text_setup(spark: SparkSession, sf: str):
    """Query terms, postings and block count; terms and postings are written once and reused."""
    gallery = inputs.docs(spark, sf)
    n = blocks.block_count(retrieval.gallery_sizes(gallery))
    return cut(retrieval.term_arrays(inputs.corrupted(spark, sf), "query_id")), cut(retrieval.bm25_postings(gallery)), n


def self_truth(terms: DataFrame) -> DataFrame:
    return terms.select("query_id", F.col("query_id").alias("doc_id"))


@query(f"""WITH {inputs.TOKENS}
SELECT doc_id, count(*) AS token_count, count(DISTINCT token) AS distinct_tokens, min(token) AS first_token, max(token) AS last_token
FROM tokens GROUP BY ALL""")
def tokenized_documents(spark, sf):
    tokens = inputs.docs(spark, sf).select("doc_id", tokenize(F.col("words")).alias("t"))
    return tokens.select(
        "doc_id",
        F.size("t").cast("long").alias("token_count"),
        F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"),
        F.array_min("t").alias("first_token"),
        F.array_max("t").alias("last_token"),
    )


@query(f"WITH {inputs.TOKENS},\n{inputs.POSTINGS}\nSELECT * FROM postings")
def bm25_weights(spark, sf):
    return retrieval.bm25_postings(inputs.docs(spark, sf))


@query(f"""{RETRIEVAL},
{SCORES}
SELECT query_id, doc_id, units FROM scores WHERE query_id = doc_id""")
def bm25_pair_scores(spark, sf):
    terms, postings, _ = text_setup(spark, sf)
    return retrieval.score_pairs(self_truth(terms), terms, postings)


TOP = """top AS (
  SELECT query_id, doc_id, units, position FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS position FROM scores)
  WHERE position <= 100)"""


@query(f"{RETRIEVAL},\n{SCORES},\n{TOP}\nSELECT query_id, doc_id, units, position FROM top WHERE position <= 25")
def bm25_shortlist(spark, sf):
    terms, postings, n = text_setup(spark, sf)
    return retrieval.bm25_topk(terms, postings, 25, n, n)


RANKS = """ranks AS (
  SELECT s.query_id, s.query_id AS truth_id,
    1 + count_if(s.units > t.units) + count_if(s.units = t.units AND s.doc_id < t.doc_id) AS rank,
    1 + count_if(s.units > t.units) AS optimistic_rank,
    arg_min(s.doc_id, (-s.units, s.doc_id)) AS best_id, max(s.units)::DOUBLE AS best_score
  FROM scores s JOIN scores t ON t.query_id = s.query_id AND t.doc_id = s.query_id GROUP BY ALL)"""


@query(f"{RETRIEVAL},\n{SCORES},\n{RANKS}\nSELECT * FROM ranks")
def bm25_ranks(spark, sf):
    terms, postings, n = text_setup(spark, sf)
    return retrieval.bm25_ranks(terms, postings, self_truth(terms), n)


CLEAN = RETRIEVAL + """,
all_terms AS (
  SELECT 'corrupt' AS mode, * FROM query_terms UNION ALL SELECT 'clean', doc_id, token, tf FROM tf),
hits AS (
  SELECT mode, query_id, doc_id, sum(q.tf * p.weight)::BIGINT AS units
  FROM all_terms q JOIN postings p USING (token) GROUP BY ALL),
truth AS (
  SELECT m.mode, d.doc_id AS query_id, coalesce(h.units, 0) AS units
  FROM documents d CROSS JOIN (VALUES ('clean'), ('corrupt')) m(mode)
  LEFT JOIN hits h ON h.mode = m.mode AND h.query_id = d.doc_id AND h.doc_id = d.doc_id),
ranks AS (
  SELECT t.mode, t.query_id, 1 + count(*) FILTER (h.units > t.units) AS rank
  FROM truth t LEFT JOIN hits h USING (mode, query_id) GROUP BY ALL),
summaries AS (
  SELECT mode, count(*) AS query_count,
    round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 5)::INT), 6) AS recall_at_5,
    round(avg((rank <= 10)::INT), 6) AS recall_at_10, round(avg(1.0::DOUBLE / rank), 6) AS mrr,
    count_if(rank = 1) AS correct_top1
  FROM ranks GROUP BY ALL)"""


def both_summaries(spark, sf):
    """Clean and corrupted queries in one pass over the blocks, told apart by the sign of their id."""
    gallery = inputs.docs(spark, sf)
    n = blocks.block_count(retrieval.gallery_sizes(gallery))
    own = cut(retrieval.term_arrays(gallery))
    postings = cut(retrieval.weighted_terms(own))
    clean = own.withColumn("query_id", -1 - F.col("doc_id")).drop("doc_id")
    terms = cut(retrieval.term_arrays(inputs.corrupted(spark, sf), "query_id").unionByName(clean))
    is_clean = F.col("query_id") < 0
    truth = terms.select("query_id", F.when(is_clean, -1 - F.col("query_id")).otherwise(F.col("query_id")).alias("doc_id"))
    ranks = retrieval.bm25_ranks(terms, postings, truth, 2 * n)
    return ranking.summary(ranks.withColumn("mode", F.when(is_clean, "clean").otherwise("corrupt")), ["mode"], rank="optimistic_rank")


@query(f"{CLEAN}\nSELECT * FROM summaries")
def bm25_summary(spark, sf):
    return both_summaries(spark, sf)


@query(f"""{CLEAN}
SELECT round(c.recall_at_1 - b.recall_at_1, 6) AS recall_at_1_delta, round(c.recall_at_5 - b.recall_at_5, 6) AS recall_at_5_delta,
  round(c.recall_at_10 - b.recall_at_10, 6) AS recall_at_10_delta, round(c.mrr - b.mrr, 6) AS mrr_delta
FROM summaries b, summaries c WHERE b.mode = 'clean' AND c.mode = 'corrupt'""")
def corruption_contrast(spark, sf):
    metrics = ["recall_at_1", "recall_at_5", "recall_at_10", "mrr"]
    return ranking.contrast(both_summaries(spark, sf), "mode", "clean", "corrupt", metrics)


@query(f"""{RETRIEVAL},
labelled AS (SELECT DISTINCT doc_id FROM labels),
gallery AS (SELECT count(*) AS n FROM labelled),
hits AS (SELECT query_id, p.doc_id, sum(q.tf * p.weight)::BIGINT AS units
  FROM query_terms q JOIN postings p USING (token) SEMI JOIN labelled l ON l.doc_id = p.doc_id GROUP BY ALL),
ranks AS (
  SELECT l.doc_id AS query_id, 1 + count(*) FILTER (h.units > coalesce(t.units, 0)) AS rank
  FROM labelled l LEFT JOIN hits t ON t.query_id = l.doc_id AND t.doc_id = l.doc_id
  LEFT JOIN hits h ON h.query_id = l.doc_id GROUP BY ALL),
full_ranks AS (SELECT d.doc_id, rank, n FROM documents d LEFT JOIN ranks r ON r.query_id = d.doc_id, gallery)
SELECT p.policy, count(*) AS query_count, round(avg((coalesce(rank, n + 1) <= 10)::INT), 6) AS recall_at_10,
  round(avg(coalesce(1.0::DOUBLE / rank, CASE WHEN p.policy = 'after' THEN 1.0::DOUBLE / (n + 1) ELSE 0 END)), 6) AS mrr
FROM full_ranks, (VALUES ('after'), ('zero')) p(policy) GROUP BY ALL""")
def missing_truth_policies(spark, sf):
    """The gallery holds only labelled documents; the truth of the others is missing."""
    terms, postings, n = text_setup(spark, sf)
    labelled = table(spark, sf, "labels").select("doc_id").distinct()
    gallery = postings.join(labelled, "doc_id", "left_semi")
    found = self_truth(terms).join(labelled, "doc_id", "left_semi")
    present = terms.join(found.select("query_id"), "query_id", "left_semi")
    ranks = retrieval.bm25_ranks(present, gallery, found, n).select("query_id", "optimistic_rank")
    everything = terms.select("query_id").join(ranks, "query_id", "left").withColumn("n", labelled.agg(F.count("*")).scalar())
    parts = []
    for policy in ("after", "zero"):
        rank, reciprocal = ranking.missing_truth(F.col("optimistic_rank"), F.col("n"), policy)
        parts.append(everything.select(F.lit(policy).alias("policy"), rank.alias("rank"), reciprocal.alias("rr")))
    return ranking.summary(parts[0].unionByName(parts[1]), ["policy"], (10,), reciprocal=F.col("rr")).drop("correct_top1")


# ---- dense -----------------------------------------------------------------------------


def vectors(spark, sf, id_col="doc_id"):
    unit = retrieval.normalize(F.col("embedding"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias(id_col), unit.alias("vector"), F.col("label").cast("long").alias("label"))


def vector_blocks(frame: DataFrame) -> int:
    return blocks.block_count(frame.agg(F.count("*").alias("ids"), F.sum(F.size("vector")).alias("items")))


def label_gallery(spark, sf):
    """First vector per label is the label's template; the rest are queries."""
    items = vectors(spark, sf)
    first = items.groupBy("label").agg(F.min("doc_id").alias("doc_id"))
    gallery = items.join(first.select("doc_id"), "doc_id", "left_semi")
    queries = items.join(first.select("doc_id"), "doc_id", "left_anti").withColumnRenamed("doc_id", "query_id")
    truth = queries.join(first.withColumnRenamed("doc_id", "truth_id"), "label")
    return truth, gallery


VECTORS = """vectors AS (
  SELECT vec_id, label::BIGINT AS label, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS v
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"""
LABEL_GALLERY = VECTORS + """,
first AS (SELECT label, min(vec_id) AS vec_id FROM vectors GROUP BY ALL),
gallery AS (SELECT * FROM vectors SEMI JOIN first USING (vec_id)),
queries AS (SELECT v.*, f.vec_id AS truth_id FROM vectors v JOIN first f USING (label) WHERE v.vec_id <> f.vec_id),
scores AS (SELECT q.vec_id AS query_id, q.label AS truth, truth_id, g.vec_id AS doc_id, g.label,
  round(list_dot_product(q.v, g.v), 9) AS score FROM queries q CROSS JOIN gallery g),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM scores),
ranks AS (SELECT query_id, truth, position AS rank FROM top WHERE doc_id = truth_id)"""


@query(f"""WITH {VECTORS}
SELECT vec_id AS doc_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS head, round(list_dot_product(v, v), 6) AS length,
  length('[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']') AS literal_length
FROM vectors JOIN embeddings USING (vec_id)""")
def unit_vectors(spark, sf):
    unit = retrieval.normalize(F.col("embedding"))
    frame = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", unit.alias("vector"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return frame.select(
        "doc_id",
        F.round(total, 6).alias("total"),
        F.round(F.get("vector", F.lit(0)), 6).alias("head"),
        F.round(arrays.dot(F.col("vector"), F.col("vector")), 6).alias("length"),
        F.length(vector_literal(F.col("embedding"))).cast("long").alias("literal_length"),
    )


EIGHTS = "list_transform(range(8), lambda i: (embedding[i * 8 + 1 : i * 8 + 8])::DOUBLE[])"


@query(f"""WITH m AS (SELECT vec_id, list_transform(range(8), lambda j: list_avg(list_transform({EIGHTS}, lambda t: t[j + 1]))) AS mean FROM embeddings)
SELECT vec_id AS doc_id, 128 AS dims, round(mean[1] / sqrt(list_dot_product(mean, mean)), 6) AS head, round(list_sum(mean) / sqrt(list_dot_product(mean, mean)), 6) AS total FROM m""")
def pooled_vectors(spark, sf):
    """Mean of eight part vectors, padded to 128 and normalised."""
    fit = retrieval.pool_and_fit(parts_of(F.col("embedding")))
    frame = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), fit.alias("v"))
    return frame.select(
        "doc_id", F.size("v").alias("dims"), F.round(F.get("v", F.lit(0)), 6).alias("head"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


def parts_of(embedding):
    return F.transform(arrays.indexes(F.lit(8)), lambda i: F.transform(F.slice(embedding, i * 8 + 1, 8), lambda v: v.cast("double")))


@query(f"""WITH {VECTORS},
scores AS (SELECT q.vec_id AS query_id, g.vec_id AS doc_id, round(list_dot_product(q.v, g.v), 9) AS score FROM vectors q CROSS JOIN vectors g)
SELECT query_id, doc_id, round(score, 6) AS cosine, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM scores) WHERE position <= 10""")
def dense_topk(spark, sf):
    gallery = vectors(spark, sf)
    n = vector_blocks(gallery)
    top = retrieval.dense_topk(vectors(spark, sf, "query_id").drop("label"), gallery.drop("label"), 10, n, n)
    return top.select("query_id", "doc_id", F.round("score", 6).alias("cosine"), "position")


@query()
def dense_topk_approximate(spark, sf):
    """Top-k from hash buckets, and how much of the exact top-k it finds."""
    q, g = vectors(spark, sf, "query_id").drop("label"), vectors(spark, sf).drop("label")
    n = vector_blocks(g)
    exact = retrieval.dense_topk(q, g, 10, n, n).select("query_id", "doc_id", F.col("position").alias("exact_position"))
    near = retrieval.lsh_topk(q, g, 10, tables=16, bits=3).select("query_id", "doc_id", F.lit(1).alias("found"))
    return exact.join(near, ["query_id", "doc_id"], "left").agg(F.round(F.count("found") / F.count("*"), 6).alias("recall"))


@query(f"""WITH {VECTORS},
scores AS (SELECT q.vec_id AS query_id, g.vec_id AS doc_id, round(list_dot_product(q.v, g.v), 9) AS score FROM vectors q CROSS JOIN vectors g)
SELECT query_id, doc_id, round(score, 6) AS cosine, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM scores) WHERE position <= 10""")
def dense_topk_coded(spark, sf):
    """The exact top-k from a scan of 8-bit codes."""
    gallery = vectors(spark, sf).drop("label")
    n = vector_blocks(gallery)
    top = retrieval.coded_topk(vectors(spark, sf, "query_id").drop("label"), gallery, 10, n, n)
    return top.select("query_id", "doc_id", F.round("score", 6).alias("cosine"), "position")


MULTI = f"""parts AS (SELECT vec_id, {EIGHTS} AS p FROM embeddings)"""


@query(f"""WITH {MULTI},
scores AS (SELECT q.vec_id AS query_id, g.vec_id AS doc_id,
  round(list_sum(list_transform(q.p, lambda a: list_max(list_transform(g.p, lambda b: list_dot_product(a, b))))), 9) AS score
  FROM parts q CROSS JOIN parts g)
SELECT query_id, doc_id, round(score, 6) AS score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM scores) WHERE position <= 10""")
def multi_vector_topk(spark, sf):
    source = table(spark, sf, "embeddings")
    q = source.select(F.col("vec_id").alias("query_id"), parts_of(F.col("embedding")).alias("vectors"))
    g = source.select(F.col("vec_id").alias("doc_id"), parts_of(F.col("embedding")).alias("vectors"))
    n = blocks.block_count(g.agg(F.count("*").alias("ids"), F.sum(F.size("vectors") * 8).alias("items")), retrieval.SET_BLOCK)
    return retrieval.multi_vector_topk(q, g, 10, n, n).withColumn("score", F.round("score", 6))


def label_ranks(spark, sf):
    queries, gallery = label_gallery(spark, sf)
    return retrieval.dense_ranks(queries, gallery.drop("label"), vector_blocks(queries), vector_blocks(gallery)).join(
        queries.select("query_id", F.col("label").alias("truth")), "query_id"
    )


def label_top(spark, sf):
    """Ranked templates of every query."""
    queries, gallery = label_gallery(spark, sf)
    top = retrieval.dense_topk(
        queries.select("query_id", "vector"), gallery.select("doc_id", "vector"), 10, vector_blocks(queries), vector_blocks(gallery)
    )
    return top.join(gallery.select("doc_id", "label"), "doc_id")


SUMMARY = """count(*) AS query_count, round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 5)::INT), 6) AS recall_at_5,
  round(avg((rank <= 10)::INT), 6) AS recall_at_10"""


@query(f"WITH {LABEL_GALLERY}\nSELECT {SUMMARY}, round(avg(1.0::DOUBLE / rank), 6) AS mrr, count_if(rank = 1) AS correct_top1 FROM ranks")
def dense_summary(spark, sf):
    return ranking.summary(label_ranks(spark, sf))


@query(f"WITH {LABEL_GALLERY}\nSELECT truth, {SUMMARY}, round(avg(rank), 6) AS mean_rank FROM ranks GROUP BY ALL")
def per_template_summary(spark, sf):
    return ranking.per_template(label_ranks(spark, sf), "truth")


@query(f"WITH {LABEL_GALLERY}\nSELECT truth, round(avg((rank = 1)::INT), 6) AS top1_accuracy FROM ranks GROUP BY ALL")
def per_template_accuracy(spark, sf):
    return ranking.template_accuracy(label_ranks(spark, sf), "truth")


MARGINS = LABEL_GALLERY + """,
margins AS (SELECT query_id, max(score) FILTER (label = truth) AS positive_score, max(score) FILTER (label <> truth) AS negative_score
  FROM scores GROUP BY ALL)"""


def label_margins(spark, sf):
    queries, gallery = label_gallery(spark, sf)
    return retrieval.dense_margins(queries.drop("truth_id"), gallery, vector_blocks(queries), vector_blocks(gallery))


@query(f"WITH {MARGINS}\nSELECT query_id, round(positive_score, 6) AS positive_score, round(negative_score, 6) AS negative_score FROM margins")
def nearest_negatives(spark, sf):
    return label_margins(spark, sf).select("query_id", F.round("positive_score", 6).alias("positive_score"), F.round("negative_score", 6).alias("negative_score"))


@query(f"""WITH {MARGINS},
sides AS (SELECT 'positive' AS side, positive_score AS s FROM margins UNION ALL SELECT 'negative', negative_score FROM margins),
edges AS (SELECT side, min(s) AS low, max(s) AS high FROM sides GROUP BY ALL)
SELECT side, least(39, floor((s - low) / greatest((high - low) / 40, 1e-12)))::INT AS bin, count(*) AS n
FROM sides JOIN edges USING (side) GROUP BY ALL""")
def score_histogram(spark, sf):
    m = cut(label_margins(spark, sf))
    sides = [m.select(F.lit(s).alias("side"), F.col(f"{s}_score").alias("score")) for s in ("positive", "negative")]
    return ranking.histogram(sides[0].unionByName(sides[1]), "side", "score")


PIPED = """names AS (SELECT query_id, string_agg(label::VARCHAR, '|' ORDER BY position) AS names,
  string_agg(printf('%.9f', score), '|' ORDER BY position) AS scores FROM top WHERE position <= 5 GROUP BY ALL)"""


@query(f"WITH {LABEL_GALLERY},\n{PIPED}\nSELECT * FROM names")
def piped_top5(spark, sf):
    return ranking.top_names(label_top(spark, sf), 5, "label", 9)


@query(f"""WITH {LABEL_GALLERY},
{PIPED}
SELECT r.query_id, truth, rank, names, scores FROM (SELECT * FROM ranks WHERE rank > 1 ORDER BY query_id LIMIT 25) r JOIN names USING (query_id)""")
def first_failures(spark, sf):
    found = ranking.failures(label_ranks(spark, sf), label_top(spark, sf), "label", digits=9)
    return found.select("query_id", "truth", "rank", "names", "scores")


WIDE = ", ".join(
    f"max(label) FILTER (position = {i}) AS rank_{i}_template, round(max(score) FILTER (position = {i}), 6) AS rank_{i}_score" for i in range(1, 6)
)


@query(f"WITH {LABEL_GALLERY}\nSELECT query_id, {WIDE} FROM top GROUP BY ALL")
def wide_ranking(spark, sf):
    return ranking.wide_ranking(label_top(spark, sf).withColumn("score", F.round("score", 6)), "label")


@query("""WITH heads AS (SELECT l_partkey, min((lower(name), name)) AS first, count(*) AS n FROM (
  SELECT l_partkey, l_shipdate::DATE::VARCHAR || '-' || l_orderkey || '-' || l_linenumber AS name FROM lineitem) GROUP BY ALL HAVING count(*) >= 2)
SELECT l_partkey, name, CASE WHEN name = first[2] THEN 'original' ELSE 'query' END AS role
FROM (SELECT l_partkey, l_shipdate::DATE::VARCHAR || '-' || l_orderkey || '-' || l_linenumber AS name FROM lineitem) JOIN heads USING (l_partkey)""")
def template_roles(spark, sf):
    name = F.concat_ws("-", F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return ranking.roles(table(spark, sf, "lineitem").select("l_partkey", name.alias("name")), "l_partkey", "name")


# ---- hybrid, fusion ----------------------------------------------------------------------


def hashed_vectors(terms: DataFrame, id_col: str) -> DataFrame:
    """32 hashed term counts per document, normalised."""
    slot = F.conv(F.substring(F.md5("token"), 1, 2), 16, 10).cast("int") % 32
    counts = terms.groupBy(id_col, slot.alias("slot")).agg(F.sum("tf").alias("c"))
    cells = [F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("c"))), F.lit(0)).cast("double") for i in range(32)]
    return counts.groupBy(id_col).agg(F.array(*cells).alias("c")).select(id_col, retrieval.normalize(F.col("c")).alias("vector"))


def hybrid_setup(spark, sf):
    terms, postings, n = text_setup(spark, sf)
    gallery_terms = retrieval.term_counts(inputs.docs(spark, sf))
    query_terms = retrieval.term_rows(terms, "query_id")
    return terms, postings, cut(hashed_vectors(query_terms, "query_id")), cut(hashed_vectors(gallery_terms, "doc_id")), n


def hashed_sql(source: str, id_col: str) -> str:
    return f"""(SELECT {id_col}, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12)) AS v FROM (
    SELECT {id_col}, list(coalesce(c, 0)::DOUBLE ORDER BY slot) AS c FROM
      (SELECT {id_col}, slot, c FROM (SELECT DISTINCT {id_col} FROM {source}) CROSS JOIN range(32) s(slot)
       LEFT JOIN (SELECT {id_col}, ('0x' || substr(md5(token), 1, 2))::BIGINT % 32 AS slot, sum(tf) AS c FROM {source} GROUP BY ALL) USING ({id_col}, slot))
    GROUP BY ALL))"""


HYBRID = f"""{RETRIEVAL},
{SCORES},
qv AS {hashed_sql('query_terms', 'query_id')},
gv AS {hashed_sql('tf', 'doc_id')},
dense AS (SELECT query_id, doc_id, round(list_dot_product(qv.v, gv.v), 9) AS dense FROM qv CROSS JOIN gv)"""

HYBRID_CUTS = ", ".join(f"round(avg((rank <= {k})::INT), 6) AS recall_at_{k}" for k in ranking.HYBRID_CUTS)


@query(f"""{HYBRID},
{TOP},
cuts AS (SELECT unnest([25, 50, 100]) AS shortlist_size),
reranked AS (
  SELECT shortlist_size, query_id, doc_id, row_number() OVER (PARTITION BY shortlist_size, query_id ORDER BY dense DESC, doc_id) AS r
  FROM top JOIN dense USING (query_id, doc_id) JOIN cuts ON position <= shortlist_size),
final AS (
  SELECT c.shortlist_size, d.doc_id, coalesce(r, (SELECT count(*) FROM documents) + 1) AS rank, coalesce(1.0::DOUBLE / r, 0) AS rr
  FROM cuts c CROSS JOIN documents d LEFT JOIN reranked x ON x.shortlist_size = c.shortlist_size AND x.query_id = d.doc_id AND x.doc_id = d.doc_id)
SELECT shortlist_size::BIGINT AS shortlist_size, count(*) AS query_count, {HYBRID_CUTS}, round(avg(rr), 6) AS mrr, count_if(rank = 1) AS correct_top1
FROM final GROUP BY ALL""")
def hybrid_rerank(spark, sf):
    """BM25 shortlists of three sizes, reranked by cosine; one summary row per size."""
    terms, postings, qv, gv, n = hybrid_setup(spark, sf)
    longest = retrieval.bm25_topk(terms, postings, max(SHORTLISTS), n, n)
    sizes = F.explode(F.filter(F.array(*(F.lit(s).cast("long") for s in SHORTLISTS)), lambda s: F.col("position") <= s))
    scored = retrieval.rerank(longest.select("query_id", "doc_id", "position"), qv, gv).drop("rank").withColumn("shortlist_size", sizes)
    # the truth's place in each shortlist: how many of its rows beat the truth row
    truth = scored.filter(F.col("query_id") == F.col("doc_id")).select("query_id", "shortlist_size", F.col("dense").alias("bar"))
    beats = (F.col("dense") > F.col("bar")) | ((F.col("dense") == F.col("bar")) & (F.col("doc_id") < F.col("query_id")))
    found = scored.join(truth, ["query_id", "shortlist_size"]).groupBy("query_id", "shortlist_size").agg((F.count_if(beats) + 1).alias("r"))
    grid = terms.select("query_id").withColumn("shortlist_size", F.explode(F.array(*(F.lit(s).cast("long") for s in SHORTLISTS))))
    size = inputs.docs(spark, sf).agg(F.count("*")).scalar()
    rank, reciprocal = ranking.missing_truth(F.col("r"), size, "zero")
    ranks = grid.join(found, ["query_id", "shortlist_size"], "left").select("shortlist_size", rank.alias("rank"), reciprocal.alias("rr"))
    return ranking.summary(ranks, ["shortlist_size"], ranking.HYBRID_CUTS, reciprocal=F.col("rr"))


FUSED = f"""{HYBRID},
spans AS (SELECT query_id, min(units) AS s0, max(units) AS s1, min(dense) AS d0, max(dense) AS d1
  FROM scores JOIN dense USING (query_id, doc_id) GROUP BY ALL),
fused AS (
  SELECT alpha, query_id, doc_id, round(alpha * ((units - s0) / greatest(s1 - s0, 1e-12)) + (1 - alpha) * ((dense - d0) / greatest(d1 - d0, 1e-12)), 9) AS f
  FROM scores JOIN dense USING (query_id, doc_id) JOIN spans USING (query_id), (SELECT unnest([0.9, 0.7, 0.5, 0.3])::DOUBLE AS alpha)),
ranks AS (
  SELECT s.alpha, s.query_id, 1 + count_if(s.f > t.f) + count_if(s.f = t.f AND s.doc_id < t.doc_id) AS rank
  FROM fused s JOIN fused t ON t.alpha = s.alpha AND t.query_id = s.query_id AND t.doc_id = s.query_id GROUP BY ALL)"""


@query(f"""{FUSED}
SELECT alpha, count(*) AS query_count, {HYBRID_CUTS}, round(avg(1.0::DOUBLE / rank), 6) AS mrr, count_if(rank = 1) AS correct_top1 FROM ranks GROUP BY ALL""")
def score_fusion(spark, sf):
    """Min-max fusion of BM25 and cosine over the whole gallery; one summary row per weight."""
    terms, postings, qv, gv, n = hybrid_setup(spark, sf)
    ranks = retrieval.fusion_ranks(terms, postings, qv, gv, self_truth(terms), ALPHAS, n, n)
    return ranking.summary(ranks, ["alpha"], ranking.HYBRID_CUTS)


# ---- label vectors -------------------------------------------------------------------------


def classifier_responses(spark, sf):
    """One response per event: its type as an entity, its k as the page language."""
    k = F.get_json_object("props", "$.k").cast("int")
    top = table(spark, sf, "events").agg(F.max("value")).scalar()
    null = F.lit(None).cast("string")
    entity = F.struct(
        F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type")).alias("type"),
        F.when(F.col("event_type") == "view", F.lit("seen")).alias("mentionText"),
        F.struct(null.alias("text")).alias("normalizedValue"),
        (F.col("value") / top).alias("confidence"),
    )
    language = F.struct(F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), k % 4 + 1).alias("languageCode"), (k / 100).alias("confidence"))
    page = F.struct(F.array(language).alias("detectedLanguages"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.struct(F.array(entity).alias("entities"), F.array(page).alias("pages")).alias("response")
    )


LABELS = """top_value AS (SELECT max(value) AS m FROM events),
label_rows AS (
  SELECT user_id AS doc_id, CASE event_type WHEN 'view' THEN 'seen' ELSE event_type END AS label, value / m AS conf FROM events, top_value
  UNION ALL
  SELECT user_id, 'lang:' || ['en', 'de', 'fr', 'es'][(props->>'$.k')::INT % 4 + 1], (props->>'$.k')::INT / 100 FROM events),
label_vectors AS (SELECT doc_id, label, max(conf) AS conf FROM label_rows GROUP BY ALL)"""


@query(f"WITH {LABELS}\nSELECT doc_id, label, round(conf, 6) AS conf FROM label_vectors")
def label_vectors(spark, sf):
    return retrieval.label_vectors(classifier_responses(spark, sf)).withColumn("conf", F.round("conf", 6))


@query(f"""WITH {LABELS},
norms AS (SELECT doc_id, sqrt(sum(conf * conf)) AS norm FROM label_vectors GROUP BY ALL),
unit AS (SELECT doc_id, label, round(CASE WHEN norm > 0 THEN conf / norm ELSE 0 END * 10000000)::BIGINT AS w FROM label_vectors JOIN norms USING (doc_id)),
dots AS (SELECT q.doc_id AS query_id, g.doc_id, sum(q.w * g.w)::DOUBLE / 1e14 AS s FROM unit q JOIN unit g USING (label) GROUP BY ALL),
scores AS (SELECT q.doc_id AS query_id, g.doc_id, round(coalesce(s, 0), 9) AS score
  FROM norms q CROSS JOIN norms g LEFT JOIN dots d ON d.query_id = q.doc_id AND d.doc_id = g.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM scores) WHERE position <= 10""")
def label_cosine_topk(spark, sf):
    responses = classifier_responses(spark, sf)
    v, ids = cut(retrieval.label_vectors(responses)), responses.select("doc_id").distinct()
    n = blocks.block_count(v.agg(F.count_distinct("doc_id").alias("ids"), F.count("*").alias("items")))
    of = lambda df: df.withColumnRenamed("doc_id", "query_id")
    return retrieval.label_topk(of(v), v, of(ids), ids, 10, n, n).withColumn("score", F.round("score", 6))


@query(f"""WITH {LABELS}
SELECT doc_id, label, round(conf, 6) AS conf, position FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, label) AS position FROM label_vectors) WHERE position <= 5""")
def top_labels(spark, sf):
    return retrieval.top_labels(retrieval.label_vectors(classifier_responses(spark, sf))).withColumn("conf", F.round("conf", 6))

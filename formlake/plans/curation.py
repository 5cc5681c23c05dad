"""Curation queries: parts are templates, their line items filled-in images, documents OCR files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.operators import augment, curation
from formlake.plans import inputs
from formlake.plans.inputs import hash_sql
from formlake.plans.records import templates
from formlake.plans.registry import query, table

LETTERS = augment.LETTERS

# ---- joins ---------------------------------------------------------------------------------------


def region_inputs(spark, sf):
    """Metadata of the documents; German ones point to absent rows, some objects to absent ids."""
    source = templates(spark, sf)
    pairs = F.arrays_zip(F.col("objects.id").alias("id"), F.col("objects.area").alias("area"))
    wanted = F.filter(pairs, lambda o: o["id"].isNotNull() & (o["area"] > 3))
    shifted = F.transform(wanted, lambda o: F.struct(F.when(o["area"] > 7, o["id"] + 1_000_000).otherwise(o["id"]).alias("object_id"), o["area"].alias("area")))
    row = F.when(F.col("split") == "de", F.col("id") + 1_000_000).otherwise(F.col("id"))
    metadata = source.select(F.col("split").alias("source_parquet"), row.alias("row_id"), shifted.alias("qualifying_objects"))
    return metadata, source.withColumnRenamed("split", "source_parquet")


REGIONS = f"""{inputs.DOCS},
{inputs.WORDS},
wanted AS (SELECT doc_id, lang, i, length(w) AS len, lang <> 'de' AS row_found FROM words JOIN docs USING (doc_id)
  WHERE length(w) % 9 <> 0 AND length(w) % 11 <> 0 AND length(w) * 0.7::DOUBLE > 3),
regions AS (SELECT *, row_found AND len * 0.7::DOUBLE <= 7 AS written FROM wanted)"""


@query(f"""WITH {REGIONS}
SELECT lang AS source_parquet, row_found, count(*) AS objects, count_if(written)::BIGINT AS boxes,
  round(sum(CASE WHEN written AND len % 4 <> 0 THEN i * 10.0::DOUBLE END), 3) AS x FROM regions GROUP BY ALL""")
def region_boxes(spark, sf):
    found = curation.region_boxes(*region_inputs(spark, sf))
    return found.groupBy("source_parquet", "row_found").agg(
        F.count("*").alias("objects"), F.count("bbox").alias("boxes"), F.round(F.sum(F.get("bbox", F.lit(0))), 3).alias("x")
    )


@query(f"""WITH {REGIONS}
SELECT count_if(written)::BIGINT AS regions_written, count_if(row_found AND NOT written)::BIGINT AS missing_boxes, count(DISTINCT doc_id) FILTER (NOT row_found) AS failures FROM regions""")
def region_summary(spark, sf):
    return curation.region_summary(curation.region_boxes(*region_inputs(spark, sf)))


@query(f"""WITH {REGIONS}
SELECT DISTINCT lang AS source_parquet, doc_id + 1000000 AS row_id FROM regions WHERE NOT row_found ORDER BY ALL LIMIT 50""")
def region_failures(spark, sf):
    return curation.failure_preview(curation.region_boxes(*region_inputs(spark, sf)))


READY = """images AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL HAVING count(*) = 10),
ocr10 AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) = 10),
ready AS (SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND p_partkey IN (SELECT l_partkey FROM images) AND p_partkey IN (SELECT l_partkey FROM ocr10))"""


def ready_inputs(spark, sf):
    """Returned items are OCR files, accepted ones images; parts over size 10 have an original."""
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    originals = table(spark, sf, "part").filter("p_size > 10").select("p_partkey", "p_name")
    return items.filter("l_returnflag = 'A'"), items.filter("l_returnflag = 'R'"), originals


@query(f"WITH {READY}\nSELECT p_partkey, p_name FROM ready ORDER BY lower(p_name), p_name, p_partkey LIMIT 20")
def ready_templates(spark, sf):
    images, ocr, originals = ready_inputs(spark, sf)
    return curation.ready_templates(images, ocr, originals, "p_partkey", "p_name", first=20)


@query(f"""WITH {READY},
progress AS (SELECT CASE WHEN p_size <= 20 THEN 'train' WHEN p_size <= 35 THEN 'val' ELSE 'test' END AS split,
  p_partkey IN (SELECT p_partkey FROM ready) AS ready, p_partkey IN (SELECT l_partkey FROM images) AS processed FROM part)
SELECT split, count(*) AS templates, count_if(ready)::BIGINT AS ready, count_if(processed)::BIGINT AS processed, count_if(NOT processed)::BIGINT AS pending FROM progress GROUP BY ROLLUP (split)""")
def split_progress(spark, sf):
    images, ocr, originals = ready_inputs(spark, sf)
    ready = curation.ready_templates(images, ocr, originals, "p_partkey", "p_name").select("p_partkey", F.lit(True).alias("r"))
    done = images.groupBy("p_partkey").agg(F.count("*").alias("n")).filter("n = 10").select("p_partkey", F.lit(True).alias("d"))
    split = F.when(F.col("p_size") <= 20, "train").when(F.col("p_size") <= 35, "val").otherwise("test")
    parts = table(spark, sf, "part").select("p_partkey", split.alias("split")).join(ready, "p_partkey", "left").join(done, "p_partkey", "left")
    return curation.split_progress(parts.select("split", F.col("r").isNotNull().alias("ready"), F.col("d").isNotNull().alias("processed")))


@query("""WITH excluded AS (SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY lower(lang), doc_id) AS place FROM documents ANTI JOIN excluded USING (doc_id))
SELECT doc_id, place FROM ranked WHERE place > 20 AND place <= 70""")
def beyond_selection(spark, sf):
    """Documents in neither exclusion set, in name order, without the first 20, the next 50."""
    names = table(spark, sf, "documents").select("doc_id", "lang")
    excluded = [table(spark, sf, "labels"), table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))]
    return curation.select_beyond(names, excluded, "doc_id", [F.lower("lang"), F.col("doc_id")], 20, 50).select("doc_id", "place")


@query("""SELECT event_id, user_id AS doc_id FROM events WHERE user_id IN (SELECT doc_id FROM documents WHERE lang <> 'de') AND user_id IN (SELECT doc_id FROM labels)
  AND user_id IN (SELECT conv_id FROM conversations) AND event_id IN (SELECT event_id FROM events WHERE value > 20)""")
def usable_queries(spark, sf):
    docs, events = table(spark, sf, "documents"), table(spark, sf, "events")
    queries = events.select("event_id", F.col("user_id").alias("doc_id"))
    degraded = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return curation.load_queries(
        docs.select("doc_id"), docs.filter("lang <> 'de'"), table(spark, sf, "labels"), degraded, queries, events.filter("value > 20"), "doc_id", "event_id"
    ).select("event_id", "doc_id")


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'gts' WHEN v.vec_id IS NULL THEN 'ocr' END AS missing, count(*) AS n, sum(d.doc_id)::BIGINT AS ids
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN embeddings v ON v.vec_id = d.doc_id GROUP BY ALL""")
def triple_join(spark, sf):
    ocr = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    rows = curation.triple_join(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ocr, "doc_id")
    return rows.groupBy("missing").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


PATHS = """files AS (SELECT page_id, lower(regexp_extract(url, '//([^/]+)', 1)) AS stem, url AS path FROM pages),
index AS (SELECT stem, arg_min(path, (lower(path), path)) AS path FROM files GROUP BY ALL)"""


def page_files(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "//([^/]+)", 1)).alias("stem"), F.col("url").alias("path"))


@query(f"WITH {PATHS}\nSELECT * FROM index")
def first_by_stem(spark, sf):
    return curation.first_by_stem(page_files(spark, sf))


@query(f"""WITH {PATHS},
items AS (SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'lost' ELSE stem END AS stem, CASE WHEN page_id % 3 = 0 THEN path ELSE path || '.gone' END AS listed_path FROM files)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN listed_path ELSE i.path END AS path FROM items LEFT JOIN index i USING (stem)""")
def preferred_paths(spark, sf):
    """Listed paths, two thirds of them gone; a fifth of the stems has no index entry either."""
    files, n = page_files(spark, sf), F.col("page_id")
    items = files.select(
        "page_id", F.when(n % 5 == 4, "lost").otherwise(F.col("stem")).alias("stem"),
        F.when(n % 3 == 0, F.col("path")).otherwise(F.concat("path", F.lit(".gone"))).alias("listed_path"),
    )
    return curation.preferred_paths(items, files, curation.first_by_stem(files)).select("page_id", "path")


@query("""WITH everything AS (SELECT doc_id, true AS original FROM documents UNION ALL SELECT vec_id, false FROM embeddings)
SELECT original, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM everything GROUP BY ALL""")
def gallery_union(spark, sf):
    gallery = table(spark, sf, "documents").select("doc_id", F.lit(True).alias("original"))
    queries = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(False).alias("original"))
    return gallery.unionByName(queries).groupBy("original").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""SELECT lower(p_name) AS folded, p_name, p_partkey, row_number() OVER (ORDER BY lower(p_name), p_name, p_partkey) AS place FROM part""")
def name_order(spark, sf):
    """Stable case-insensitive order, numbered without a single-task window."""
    parts = table(spark, sf, "part").select("p_name", "p_partkey", F.lower("p_name").alias("folded"))
    return curation.global_rank(parts, [F.col("folded"), F.col("p_name"), F.col("p_partkey")], "place")


@query("""WITH ranked AS (SELECT doc_id, lang || '/' || doc_id AS path, row_number() OVER (ORDER BY lang, doc_id) AS place FROM documents)
SELECT (place - 1) // 100 AS bundle, count(*) AS page_count, arg_min(path, place) AS first_image, arg_max(path, place) AS last_image FROM ranked GROUP BY ALL""")
def page_bundles(spark, sf):
    items = table(spark, sf, "documents").select("doc_id", "lang", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"))
    return curation.bundles(items, [F.col("lang"), F.col("doc_id")], "path")


@query("""WITH kept AS (SELECT url, page_id FROM pages ORDER BY url, page_id LIMIT 30)
SELECT url, page_id AS doc_id, page_id IN (SELECT doc_id FROM labels) AS has_metadata FROM kept""")
def subset_with_metadata(spark, sf):
    items = table(spark, sf, "pages").select("url", F.col("page_id").alias("doc_id"))
    return curation.subset_with_metadata(items, table(spark, sf, "labels"), "doc_id", "url", 30)


@query("""SELECT p_partkey, f::INT AS fill_index FROM part CROSS JOIN range(8) t(f) ANTI JOIN (SELECT DISTINCT l_partkey AS p_partkey, l_linenumber AS f FROM lineitem) USING (p_partkey, f)""")
def missing_fills(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("fill_index"))
    return curation.missing_fills(table(spark, sf, "part"), done, "p_partkey", 8)


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def pending_documents(spark, sf):
    return curation.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


# ---- splits and samples ------------------------------------------------------------------------------


def ranked_sql(source: str, key: str, by: str = "", seed: int = 42) -> str:
    """Rows of `source` with their place in md5 order of seed, group and key."""
    parts = " || ':' || ".join(f"({c})::VARCHAR" for c in ([by] if by else []) + [key])
    over = f"PARTITION BY {by} " if by else ""
    return f"SELECT *, row_number() OVER ({over}ORDER BY md5('{seed}:' || {parts})) AS place, count(*) OVER ({over}) AS total FROM {source}"


@query(f"""SELECT p_partkey, CASE WHEN place <= 150 THEN 'train' WHEN place <= 170 THEN 'val' WHEN place <= 190 THEN 'test' END AS split
FROM ({ranked_sql('part', 'p_partkey')})""")
def fixed_splits(spark, sf):
    names = table(spark, sf, "part").select("p_partkey")
    return curation.fixed_splits(names, "p_partkey", {"train": 150, "val": 20, "test": 20})


@query(f"""WITH r AS ({ranked_sql('part', 'p_partkey')}),
s AS (SELECT DISTINCT total AS n FROM r),
shares AS (SELECT i, name, n * w // 100 AS base, (n * w) % 100 AS rest, n FROM s, (VALUES (1, 'train', 92), (2, 'val', 4), (3, 'test', 4)) x(i, name, w)),
sizes AS (SELECT i, name, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, i) <= n - sum(base) OVER () THEN 1 ELSE 0 END AS size FROM shares),
ends AS (SELECT name, sum(size) OVER (ORDER BY i) AS stop, sum(size) OVER (ORDER BY i) - size AS start FROM sizes)
SELECT p_partkey, name AS split FROM r JOIN ends ON place > start AND place <= stop""")
def weighted_splits(spark, sf):
    return curation.weighted_splits(table(spark, sf, "part").select("p_partkey"), "p_partkey", {"train": 92, "val": 4, "test": 4})


@query(f"""SELECT c_custkey, CASE WHEN place <= greatest(1, round_even(total * 0.8, 0)) THEN 'train' ELSE 'test' END AS split FROM ({ranked_sql('customer', 'c_custkey')})""")
def train_test(spark, sf):
    return curation.train_test(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query(f"""SELECT vec_id, label, CASE WHEN place <= least(greatest(1, round_even(total * 0.1, 0)), greatest(1, total - 1)) THEN 'val' ELSE 'train' END AS split
FROM ({ranked_sql('embeddings', 'vec_id', 'label')})""")
def class_holdout(spark, sf):
    return curation.class_holdout(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.1)


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey) LIMIT 285")
def seeded_sample(spark, sf):
    return curation.sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 285)


@query(f"""WITH members AS ({ranked_sql('embeddings', 'vec_id', 'label')}),
figures AS (SELECT count(*) AS total, count(DISTINCT label) AS classes FROM embeddings),
shape AS (SELECT *, least(4, classes) AS per_batch, ceil(total / 8)::BIGINT AS batches FROM figures),
rounds AS (SELECT *, classes // per_batch AS per_round, unnest(range(ceil(batches / (classes // per_batch))::BIGINT)) AS round FROM shape),
turns AS (SELECT r.*, label, n, row_number() OVER (PARTITION BY round ORDER BY md5('42:' || round || ':' || label)) - 1 AS turn
  FROM rounds r, (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL)),
slots AS (SELECT round * per_round + turn // per_batch AS batch, turn % per_batch AS slot, label, n, round, batches, unnest([0, 1]) AS i
  FROM turns WHERE turn < per_round * per_batch)
SELECT batch, slot::INT AS slot, i::INT AS i, s.label, vec_id FROM slots s JOIN members m ON m.label = s.label AND m.place = (round * 2 + i) % n + 1 WHERE batch < batches""")
def balanced_batches(spark, sf):
    return curation.balanced_batches(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 4, 2)


def images(spark, sf) -> DataFrame:
    """Line items as images of their part, named by order, line, supplier and price in cents."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    name = F.concat_ws("-", *(c.cast("string") for c in (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), cents)))
    return table(spark, sf, "lineitem").select("l_partkey", name.alias("image")).distinct()


IMAGES = "(SELECT DISTINCT l_partkey, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || round(l_extendedprice * 100)::BIGINT AS image FROM lineitem)"


@query(f"""SELECT l_partkey, image, CASE WHEN place <= 5 THEN 'mask25' WHEN place <= 7 THEN 'mask20_corrupt10' ELSE 'clean' END AS mode FROM ({ranked_sql(IMAGES, 'image', 'l_partkey')})""")
def fixed_modes(spark, sf):
    return curation.fixed_modes(images(spark, sf), "l_partkey", "image", {"mask25": 5, "mask20_corrupt10": 2})


@query(f"""SELECT l_partkey, image, CASE WHEN place <= floor(total * 0.5) THEN 'clean' WHEN place <= floor(total * 0.5) + floor(total * 0.3) THEN 'mask' ELSE 'corrupt' END AS mode
FROM ({ranked_sql(IMAGES, 'image', 'l_partkey')})""")
def shared_modes(spark, sf):
    return curation.shared_modes(images(spark, sf), "l_partkey", "image")


@query("""SELECT doc_id, 'augmented' AS subset, n_chars FROM (SELECT doc_id + 100000 AS doc_id, n_chars FROM documents) UNION ALL SELECT doc_id, lang, n_chars FROM documents""")
def augmented_copies(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("subset"), "n_chars")
    return curation.augmented_copies(docs, "doc_id")[0]


# ---- masking and corruption ------------------------------------------------------------------------------


def noise_sql(w: str, key: str) -> str:
    """One-character edit of `w`, as the hash of `key` and word position says."""

    def number(purpose: str) -> str:
        return hash_sql(f"{key} || ':{purpose}'")

    def one(purpose: str) -> str:
        return f"substr('{LETTERS}', {number(purpose)} % 26 + 1, 1)"

    at, gap, pair = f"({number('at')} % greatest(length({w}), 1))", f"({number('at')} % (length({w}) + 1))", f"({number('at')} % greatest(length({w}) - 1, 1))"
    old = f"substr({w}, {at} + 1, 1)"
    new = f"CASE WHEN {old} = upper({old}) AND {old} <> lower({old}) THEN upper({one('new')}) ELSE {one('new')} END"
    replaced = f"(substr({w}, 1, {at}) || {new} || substr({w}, {at} + 2))"
    return f"""CASE {number('op')} % 4 WHEN 0 THEN CASE WHEN {replaced} = {w} THEN {replaced} || {one('extra')} ELSE {replaced} END
      WHEN 1 THEN CASE WHEN length({w}) > 1 THEN substr({w}, 1, {at}) || substr({w}, {at} + 2) ELSE {w} || {one('new')} END
      WHEN 2 THEN substr({w}, 1, {gap}) || {one('new')} || substr({w}, {gap} + 1)
      ELSE CASE WHEN length({w}) > 1 THEN substr({w}, 1, {pair}) || substr({w}, {pair} + 2, 1) || substr({w}, {pair} + 1, 1) || substr({w}, {pair} + 3) ELSE {w} || {one('new')} END END"""


def masked_sql(mask: float, corrupt: float, noise: str, least: int) -> str:
    return f"""WITH {inputs.DOCS},
{inputs.WORDS},
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('36:' || doc_id || ':' || i)) AS place,
  least(n, greatest({least}, round_even(n * {mask}::DOUBLE, 0))) AS first, greatest({least if corrupt else 0}, round_even(n * {corrupt}::DOUBLE, 0)) AS extra FROM words),
edited AS (SELECT doc_id, i, place <= first AS masked, place > first AND place <= first + extra AS corrupted,
  CASE WHEN place <= first THEN '[MASK]' WHEN place <= first + extra THEN {noise} ELSE w END AS w FROM placed)
SELECT doc_id, md5(coalesce(string_agg(w, ' ' ORDER BY i), '')) AS words, coalesce(count_if(masked), 0)::INT AS n_masked, coalesce(count_if(corrupted), 0)::INT AS n_corrupted,
  coalesce(sum(i) FILTER (masked), 0)::BIGINT AS masked_at, coalesce(sum(i) FILTER (corrupted), 0)::BIGINT AS corrupted_at FROM documents LEFT JOIN edited USING (doc_id) GROUP BY ALL"""


WORD_KEY = "'36:' || doc_id || ':' || i"
BANK_HASH = hash_sql(WORD_KEY + " || ':word'")
BANK_NOISE = f"{inputs.BANK_SQL}[{BANK_HASH} % 10 + 1]"


def masked(spark, sf, mask: float, corrupt: float, noise: str, min_one: bool) -> DataFrame:
    docs = inputs.docs(spark, sf)
    edited = docs.select("doc_id", augment.mask_and_corrupt(F.col("words"), inputs.doc_key(), mask, corrupt, noise, min_one).alias("m"))

    def total(c: str):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, i: a + i)

    return edited.select(
        "doc_id", F.md5(F.array_join("m.words", " ")).alias("words"), F.size("m.masked").alias("n_masked"), F.size("m.corrupted").alias("n_corrupted"),
        total("m.masked").alias("masked_at"), total("m.corrupted").alias("corrupted_at"),
    )


@query(masked_sql(0.25, 0.0, "w", 1))
def words_masked(spark, sf):
    return masked(spark, sf, 0.25, 0.0, "letters", True)


@query(masked_sql(0.20, 0.10, noise_sql("w", WORD_KEY), 1))
def words_masked_and_corrupted(spark, sf):
    return masked(spark, sf, 0.20, 0.10, "letters", True)


@query(masked_sql(0.20, 0.10, BANK_NOISE, 0))
def words_masked_by_rate(spark, sf):
    """Without the minimum of one word; corrupted words come from the bank."""
    return masked(spark, sf, 0.20, 0.10, "bank", False)


CORRUPT_DOCS = f"WITH {inputs.DOCS},\n{inputs.WORDS},\n{inputs.CORRUPTED}"


@query(f"{CORRUPT_DOCS}\nSELECT doc_id AS query_id, md5(coalesce(string_agg(w, ' ' ORDER BY i), '')) AS words FROM documents LEFT JOIN corrupted ON query_id = doc_id GROUP BY ALL")
def words_corrupted(spark, sf):
    return inputs.corrupted(spark, sf).select("query_id", F.md5(F.array_join("words", " ")).alias("words"))


@query(f"""{CORRUPT_DOCS},
per AS (SELECT query_id, any_value(n) AS n, count_if(replaced) AS k FROM corrupted GROUP BY ALL)
SELECT (SELECT count(*) FROM documents) AS documents, sum(n)::BIGINT AS words, sum(k)::BIGINT AS corrupted, round(sum(k) / sum(n), 6) AS rate FROM per""")
def corruption_totals(spark, sf):
    bank, size = augment.fixed_bank()
    edited = inputs.docs(spark, sf).select(augment.corrupted_with_count(F.col("words"), inputs.doc_key(), bank, size).alias("c"))
    return curation.corruption_totals(edited.select(F.size("c.words").alias("n_words"), "c.n_corrupted"))


# ---- dictionaries, fill plans --------------------------------------------------------------------------------

DICTIONARY = """dictionary AS (SELECT word, count(*) AS count FROM (
  SELECT lower(trim(unnest(regexp_extract_all(text, '[A-Za-z'']+')), '''')) AS word FROM documents) WHERE length(word) BETWEEN 2 AND 12 GROUP BY ALL ORDER BY count DESC, word LIMIT 500),
placed AS (SELECT (row_number() OVER (ORDER BY count DESC, word) - 1)::INT AS position, word, count FROM dictionary),
bank AS (SELECT list(word ORDER BY position) AS bank FROM placed)"""


def words_500(spark, sf) -> DataFrame:
    return curation.dictionary(table(spark, sf, "documents"))


@query(f"WITH {DICTIONARY}\nSELECT * FROM placed")
def word_dictionary(spark, sf):
    return words_500(spark, sf)


FIELD = """fields AS (SELECT l_partkey AS p_partkey, l_orderkey || '-' || l_linenumber AS field_id, l_quantity * 20 AS width FROM lineitem),
sized AS (SELECT *, CASE WHEN width < 110 THEN 1 WHEN width < 180 THEN 2 WHEN width < 280 THEN 3 WHEN width < 420 THEN 4 WHEN width < 650 THEN 5 WHEN width < 900 THEN 6 ELSE 7 END AS budget FROM fields)"""


def fields(spark, sf) -> DataFrame:
    """Line items as form fields, as wide as 20 times their quantity."""
    items = table(spark, sf, "lineitem")
    field = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return items.select(F.col("l_partkey").alias("p_partkey"), field.alias("field_id"), (F.col("l_quantity") * 20).alias("width"))


PLAN_KEY = "'42:' || p_partkey || ':' || field_id || ':' || fill_index"


@query(f"""WITH {DICTIONARY},
{FIELD},
fills AS (SELECT p_partkey, field_id, width, fill_index::INT AS fill_index, {hash_sql(PLAN_KEY + " || ':n'")} % budget + 1 AS n FROM sized CROSS JOIN range(3) t(fill_index)),
picks AS (SELECT f.*, list_transform(range(1, n + 1), lambda j: bank[{hash_sql(PLAN_KEY + " || ':' || j")} % 500 + 1]) AS words FROM fills f, bank)
SELECT p_partkey, field_id, fill_index, width, array_to_string(words, ' ') AS text FROM picks""")
def fill_plan(spark, sf):
    bank = curation.dictionary_array(words_500(spark, sf))
    return curation.fill_plan(fields(spark, sf), bank, 500, 3, "p_partkey")


@query(f"""WITH {DICTIONARY},
docs AS (SELECT doc_id, n_chars % 120 AS width FROM documents),
tries AS (SELECT doc_id, width, j, bank[{hash_sql("doc_id || ':' || j")} % 500 + 1] AS w FROM docs, bank, (SELECT unnest(range(0, 121)) AS j) WHERE j <= width),
used AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY j) AS used FROM tries)
SELECT d.doc_id, CASE WHEN width > 0 THEN coalesce((SELECT string_agg(w || ' ', '' ORDER BY j) FROM used u WHERE u.doc_id = d.doc_id AND used <= u.width), '') END AS line FROM docs d""")
def line_fill(spark, sf):
    """Lines as wide as a document's length modulo 120."""
    bank = curation.dictionary_array(words_500(spark, sf))
    line = curation.fill_line((F.col("n_chars") % 120).cast("int"), F.col("bank"), 500, F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").withColumn("bank", bank).select("doc_id", line.alias("line"))


@query("""WITH h AS (SELECT p_partkey, p_size, greatest(16, least(p_size, 48)) * 0.8::DOUBLE AS char_height, p_retailprice AS width FROM part)
SELECT p_partkey, round(char_height, 6) AS char_height, floor(width / greatest(10, floor(char_height * 0.62)))::BIGINT AS chars, floor(p_size * 3 / floor(char_height * 1.2))::BIGINT AS lines,
  CASE WHEN width < 110 THEN 1 WHEN width < 180 THEN 2 WHEN width < 280 THEN 3 WHEN width < 420 THEN 4 WHEN width < 650 THEN 5 WHEN width < 900 THEN 6 ELSE 7 END AS budget FROM h""")
def field_capacity(spark, sf):
    """Fields of three heights around a part's size, as wide as its price."""
    size = F.col("p_size").cast("long")
    char = curation.good_height(F.array(size - 1, size, size + 1))
    chars, lines = curation.capacity(F.col("p_retailprice"), size * 3, F.col("char_height"))
    sized = table(spark, sf, "part").withColumn("char_height", char)
    return sized.select(
        "p_partkey", F.round("char_height", 6).alias("char_height"), chars.alias("chars"), lines.alias("lines"), curation.word_budget(F.col("p_retailprice")).alias("budget")
    )


@query(f"""WITH {inputs.DOCS}
SELECT count(*) AS images_seen, count_if(doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS processed, count_if(doc_id IN (SELECT doc_id FROM labels))::BIGINT AS reused,
  sum(len(words))::BIGINT AS total_words, round(sum(len(words)) / count(*), 4) AS average_words FROM docs""")
def cache_summary(spark, sf):
    return curation.cache_summary(cache_entries(spark, sf))


@query(f"""WITH {inputs.DOCS}
SELECT doc_id, array_to_string(words[1:12], ' ') AS words FROM docs ORDER BY doc_id LIMIT 10""")
def cache_examples(spark, sf):
    return curation.cache_examples(cache_entries(spark, sf), "doc_id").withColumn("words", F.array_join("words", " "))


def cache_entries(spark, sf) -> DataFrame:
    """Documents as cache entries; labelled ones were there before."""
    done = table(spark, sf, "labels").select("doc_id").distinct().withColumn("r", F.lit(True))
    return inputs.docs(spark, sf).join(done, "doc_id", "left").select("doc_id", "words", F.size("words").alias("n_words"), F.col("r").isNotNull().alias("reused"))

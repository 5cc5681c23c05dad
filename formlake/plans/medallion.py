"""Medallion queries: every document is an uploaded form, each of its lines a key/value pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.functions.text import iso_utc
from formlake.operators import gates, medallion
from formlake.plans import inputs
from formlake.plans.registry import query, table
from formlake.session import scratch
from formlake.sources import readers, store, writers


def lines(spark, sf) -> DataFrame:
    """Documents with an array of their lines as JSON pairs.

    The score is a number, numeric text, 'nan' or a word; keys are a line's first
    word, or a number, false or null; boxes have four, three or no corners.
    """
    n = F.length

    def pair(s, i):
        first = F.substring_index(s, " ", 1)
        rest = F.substring(s, F.length(first) + 2, F.length(s))
        quoted = F.get_json_object(F.to_json(F.struct(F.array(first).alias("a"))), "$.a")
        value = F.get_json_object(F.to_json(F.struct(F.array(rest).alias("a"))), "$.a")

        def bare(j):  # text of a one-element JSON array without its brackets
            return F.substring(j, F.lit(2), F.length(j) - 2)

        key = F.when(n(s) % 7 == 3, F.lit("0")).when(n(s) % 7 == 4, F.lit("false")).when(n(s) % 7 == 5, n(s).cast("string")).otherwise(bare(quoted))
        score = (
            F.when(n(s) % 5 == 0, (n(s) % 100 / 100).cast("string"))
            .when(n(s) % 5 == 1, F.lit('"nan"')).when(n(s) % 5 == 2, F.lit('"high"'))
            .otherwise(F.concat(F.lit('" '), (n(s) % 100 / 100).cast("string"), F.lit('"')))
        )
        key_box = F.concat(F.lit("[0,"), (i * 20).cast("string"), F.lit(",100,"), (i * 20 + 18).cast("string"), F.lit("]"))
        value_box = F.when(n(s) % 2 == 0, F.lit("null")).when(n(s) % 3 == 0, F.lit("[1,2,3]")).otherwise(F.lit('["4.5",null,6,7]'))
        return F.concat(
            F.lit('{"key":'), key, F.lit(',"value":'), bare(value), F.lit(',"score":'), score, F.lit(',"key_bbox":'), key_box,
            F.lit(',"value_bbox":'), value_box, F.lit("}"),
        )

    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", "source", "n_chars", F.transform(F.split("text", "\n"), pair).alias("pairs"))


def silver_objects(spark, sf) -> DataFrame:
    """(name, payload): French runs name themselves only inside `kvp`, German ones nowhere,
    Spanish ones keep their pairs outside `kvp`, and sources of odd length are cut short."""
    doc, lang = F.col("doc_id").cast("string"), F.col("lang")
    run = F.concat(F.lit("run "), doc)
    pairs = F.concat(F.lit("["), F.array_join("pairs", ","), F.lit("]"))
    envelope_run = F.when(lang == "fr", F.lit("")).when(lang != "de", run)
    kvp_run = F.when(lang != "de", run)
    none = F.lit(None).cast("string")
    head = F.to_json(F.struct(
        envelope_run.alias("run_id"), F.concat(F.lit(" "), lang, F.lit("/"), F.col("source")).alias("template_id"),
        F.concat(doc, F.lit(".png")).alias("source_file_name"), F.when(lang == "en", F.lit("2024-01-02")).otherwise(none).alias("created_at"),
        F.concat(F.lit("bronze/raw-images/x/"), doc, F.lit(".png")).alias("image_object"),
    ))
    kvp_head = F.to_json(F.struct(kvp_run.alias("run_id"), F.lit("2024-01-01").alias("created_at")))

    def open_(j):
        return F.substring(j, F.lit(1), F.length(j) - 1)

    inside = F.concat(open_(head), F.lit(',"kvp":'), open_(kvp_head), F.lit(',"key_values":'), pairs, F.lit("}}"))
    outside = F.concat(open_(head), F.lit(',"kvp":'), kvp_head, F.lit(',"key_values":'), pairs, F.lit("}"))
    payload = F.when(lang == "es", outside).otherwise(inside)
    broken = F.when(F.col("n_chars") % 13 == 5, F.substring(payload, F.lit(1), F.length(payload) - 3)).otherwise(payload)
    name = F.concat(F.lit("silver/kvp-json/"), lang, F.lit("/doc-"), doc, F.lit(".json"))
    return lines(spark, sf).select(name.alias("name"), broken.alias("payload"))


def silver(spark, sf) -> DataFrame:
    return medallion.parse_silver(silver_objects(spark, sf))


SILVER = """form_lines AS (
  SELECT doc_id, lang, source, n_chars, (generate_subscripts(l, 1) - 1)::INT AS i, unnest(l) AS s
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)),
runs AS (
  SELECT doc_id, lang, source, n_chars % 13 <> 5 AS valid, CASE lang WHEN 'de' THEN 'doc-' || doc_id ELSE 'run-' || doc_id END AS run_id,
    lang || '-' || regexp_replace(source, '[^A-Za-z0-9_.-]+', '-', 'g') AS template_id, doc_id || '.png' AS source_file_name,
    CASE lang WHEN 'en' THEN '2024-01-02' ELSE '2024-01-01' END AS created_at, 'silver/kvp-json/' || lang || '/doc-' || doc_id || '.json' AS silver_path
  FROM documents),
fields AS (
  SELECT r.*, i AS field_index,
    CASE length(s) % 7 WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN length(s)::VARCHAR ELSE string_split(s, ' ')[1] END AS field_key,
    substr(s, length(string_split(s, ' ')[1]) + 2) AS field_value,
    CASE WHEN length(s) % 5 IN (0, 3, 4) THEN (length(s) % 100) / 100 END AS confidence,
    0.0::DOUBLE AS key_bbox_x0, (i * 20)::DOUBLE AS key_bbox_y0, 100.0::DOUBLE AS key_bbox_x1, (i * 20 + 18)::DOUBLE AS key_bbox_y1,
    length(s) % 2 = 1 AND length(s) % 3 <> 0 AS boxed
  FROM runs r JOIN form_lines USING (doc_id) WHERE valid)"""


@query(f"""WITH {SILVER}
SELECT run_id, template_id, field_index, field_key, field_value, round(confidence, 6) AS confidence, source_file_name, silver_path, created_at,
  key_bbox_x0, key_bbox_y0, key_bbox_x1, key_bbox_y1, CASE WHEN boxed THEN 4.5::DOUBLE END AS value_bbox_x0, NULL::DOUBLE AS value_bbox_y0,
  CASE WHEN boxed THEN 6.0::DOUBLE END AS value_bbox_x1, CASE WHEN boxed THEN 7.0::DOUBLE END AS value_bbox_y1
FROM fields""")
def gold_fields(spark, sf):
    return medallion.gold_fields(silver(spark, sf)).drop("transformed_at").withColumn("confidence", F.round("confidence", 6))


RUNS = f"""{SILVER},
per AS (SELECT doc_id, count(*)::INT AS field_count, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM fields GROUP BY ALL)"""


@query(f"""WITH {RUNS}
SELECT run_id, template_id, source_file_name, silver_path, 'bronze/raw-images/x/' || source_file_name AS bronze_path,
  'gold/form-runs/' || template_id || '/' || run_id || '.json' AS gold_form_run_path, 'gold/extracted-fields/' || template_id || '/' || run_id || '.jsonl' AS gold_fields_path,
  'gold/manifests/' || template_id || '/' || run_id || '.json' AS gold_manifest_path, field_count, avg_confidence, min_confidence, max_confidence, created_at, 'gold_ready' AS status
FROM runs JOIN per USING (doc_id)""")
def gold_runs(spark, sf):
    return medallion.gold_runs(silver(spark, sf)).drop("transformed_at").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"WITH {SILVER}\nSELECT silver_path, 'doc-' || doc_id AS run_id, lang AS template_id FROM runs WHERE NOT valid")
def silver_quarantine(spark, sf):
    """Payloads that are no JSON; their ids come from the path."""
    return silver(spark, sf).filter(~F.col("valid")).select("silver_path", "run_id", "template_id")


@query(f"""WITH {RUNS}
SELECT count(*) AS form_runs, count(*) AS extracted_fields, count(*) AS manifests FROM runs WHERE valid""")
def gold_summary(spark, sf):
    runs = medallion.gold_runs(silver(spark, sf))
    names = runs.select(F.explode(F.array("gold_form_run_path", "gold_fields_path", "gold_manifest_path")).alias("name"))
    return medallion.gold_summary(names)


@query(f"""WITH {SILVER}
SELECT 'all' AS scope, count(*) AS n FROM runs UNION ALL SELECT 'template', count(*) FROM runs WHERE lang = 'fr'
UNION ALL SELECT 'run', count(*) FROM runs WHERE doc_id = 7 UNION ALL SELECT 'both', count(*) FROM runs WHERE lang = 'en' AND doc_id = 1""")
def transform_scope(spark, sf):
    objects = silver_objects(spark, sf).select("name")
    scopes = {"all": (None, None), "template": ("fr", None), "run": (None, "doc 7"), "both": ("en", "doc-1")}
    parts = [medallion.in_scope(objects, *s).agg(F.lit(k).alias("scope"), F.count("*").alias("n")) for k, s in scopes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH {RUNS},
stored AS (SELECT template_id, count(*) AS runs, sum(field_count)::BIGINT AS fields, round(avg(avg_confidence), 4) AS confidence FROM runs JOIN per USING (doc_id) GROUP BY ALL)
SELECT *, runs AS manifests FROM stored""")
def gold_store(spark, sf):
    """Writes the three gold sinks, some runs again without their fields and then whole, and reads them back."""
    root = scratch(spark, "gold")
    found, stamp = silver(spark, sf), F.lit("2024-01-03T00:00:00+00:00")
    writers.write_gold(found, root, stamp)
    some = found.filter("run_id LIKE '%7'")
    writers.write_gold(some.withColumn("pairs", F.slice("pairs", 1, 0)), root, stamp)
    writers.write_gold(some, root, stamp)
    runs, fields = store.read(spark, root, "form-runs"), store.read(spark, root, "extracted-fields")
    counts = fields.groupBy("template_id").agg(F.count("*").alias("fields"))
    rows = runs.groupBy("template_id").agg(F.count("*").alias("runs"), F.round(F.avg("avg_confidence"), 4).alias("confidence"))
    manifests = store.read(spark, root, "manifests").groupBy("template_id").agg(F.count("*").alias("manifests"))
    return rows.join(counts, "template_id").join(manifests, "template_id")


# ---- forms ------------------------------------------------------------------------------------


def tier_objects(spark, sf):
    """Bronze for all but German documents, twice for long ones; silver for documents over 300 characters."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    doc, path = F.col("doc_id").cast("string"), F.concat(F.col("lang"), F.lit("/run-"), F.col("doc_id").cast("string"))
    stamp = iso_utc(F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars")))
    kinds = F.when(F.col("n_chars") > 1000, F.array(F.lit(".jpg"), F.lit(".png"))).otherwise(F.array(F.lit(".png")))
    bronze = docs.filter("lang <> 'de'").withColumn("ext", F.explode(kinds)).select(
        F.concat(F.lit("bronze/raw-images/"), path, F.col("ext")).alias("name"),
        F.when(F.col("ext") == ".jpg", F.lit("2024-01-05")).otherwise(stamp).alias("last_modified"),
    )
    created = F.when(F.col("lang") == "en", F.concat(F.lit("2024-02-"), F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0")))
    payload = F.to_json(F.struct(F.concat(doc, F.lit(".png")).alias("source_file_name"), created.alias("created_at")))
    broken = F.when(F.col("lang") == "es", F.expr("substring(p, 2)")).otherwise(F.col("p"))
    silver_ = docs.filter("n_chars > 300").withColumn("p", payload).select(
        F.concat(F.lit("silver/kvp-json/"), path, F.lit(".json")).alias("name"), stamp.alias("last_modified"), broken.alias("payload")
    )
    return bronze, silver_


FORMS = """stamped AS (SELECT *, strftime(make_timestamp((1704067200 + n_chars) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp, lang || '/run-' || doc_id AS path FROM documents),
forms AS (
  SELECT lang AS template_id, 'run-' || doc_id AS run_id, CASE WHEN n_chars > 300 THEN 'processed' ELSE 'pending' END AS status,
    CASE WHEN lang <> 'de' THEN 'bronze/raw-images/' || path || '.png' END AS bronze_path, CASE WHEN n_chars > 300 THEN 'silver/kvp-json/' || path || '.json' END AS silver_path,
    CASE WHEN n_chars > 300 AND lang <> 'es' THEN doc_id || '.png' END AS source_file_name,
    CASE WHEN n_chars > 300 AND lang = 'en' THEN '2024-02-' || lpad((n_chars % 28 + 1)::VARCHAR, 2, '0') WHEN lang <> 'de' AND n_chars > 1000 THEN '2024-01-05' ELSE stamp END AS created_at
  FROM stamped WHERE lang <> 'de' OR n_chars > 300)"""


@query(f"WITH {FORMS}\nSELECT * FROM forms")
def form_listing(spark, sf):
    return medallion.list_forms(*tier_objects(spark, sf))


@query(f"""WITH {FORMS}
SELECT count(*) AS "all", count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'processed')::BIGINT AS processed FROM forms""")
def form_status_counts(spark, sf):
    return medallion.status_counts(medallion.list_forms(*tier_objects(spark, sf)))


@query(f"WITH {FORMS}\nSELECT template_id, run_id FROM forms WHERE status = 'pending'")
def pending_forms(spark, sf):
    return medallion.by_status(medallion.list_forms(*tier_objects(spark, sf)), "pending").select("template_id", "run_id")


PURGED = """objects AS (SELECT 'bronze/raw-images/' || lang || '/run-' || doc_id || '.png' AS name, doc_id FROM documents WHERE lang <> 'de')"""


@query(f"""WITH {PURGED}
SELECT 'doomed' AS part, count(*) AS n FROM objects WHERE contains(name, 'run-1') UNION ALL SELECT 'kept', count(*) FROM objects WHERE NOT contains(name, 'run-1')""")
def tagged_purge(spark, sf):
    objects = tier_objects(spark, sf)[0].filter(F.col("name").endswith(".png")).select("name")
    doomed = gates.tagged(objects, "run-1")
    left = gates.without(objects, doomed)
    return doomed.agg(F.lit("doomed").alias("part"), F.count("*").alias("n")).unionByName(left.agg(F.lit("kept").alias("part"), F.count("*").alias("n")))


@query("""WITH paths AS (SELECT ['bronze/raw-images/', 'silver/kvp-json/', 'silver/'][doc_id % 3 + 1] || lang || '/' || source || '/f.' || doc_id ||
    CASE WHEN n_chars % 2 = 0 THEN '.json' ELSE '.png' END AS name, doc_id, lang, n_chars FROM documents)
SELECT name, CASE doc_id % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'other' END AS kind,
  CASE WHEN doc_id % 3 = 0 THEN lang END AS bronze_template, CASE WHEN doc_id % 3 = 0 THEN 'f.' || doc_id END AS bronze_run,
  CASE WHEN doc_id % 3 = 1 AND n_chars % 2 = 0 THEN lang END AS silver_template, CASE WHEN doc_id % 3 = 1 AND n_chars % 2 = 0 THEN 'f.' || doc_id END AS silver_run FROM paths""")
def object_paths(spark, sf):
    prefix = F.element_at(F.array(*map(F.lit, ("bronze/raw-images/", "silver/kvp-json/", "silver/"))), (F.col("doc_id") % 3 + 1).cast("int"))
    ext = F.when(F.col("n_chars") % 2 == 0, ".json").otherwise(".png")
    name = F.concat(prefix, "lang", F.lit("/"), "source", F.lit("/f."), F.col("doc_id").cast("string"), ext)
    paths = table(spark, sf, "documents").select(name.alias("name"))
    b, s = (medallion.parse_path(F.col("name"), p) for p in (medallion.BRONZE, medallion.SILVER))
    return paths.select(
        "name", medallion.object_kind(F.col("name")).alias("kind"), b["template_id"].alias("bronze_template"), b["run_id"].alias("bronze_run"),
        s["template_id"].alias("silver_template"), s["run_id"].alias("silver_run"),
    )


# ---- ingest and listing ---------------------------------------------------------------------------


def uploads(spark, sf) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    kvp = F.to_json(F.struct(F.array(F.struct(F.lit("n").alias("key"), F.col("n_chars").cast("string").alias("value"))).alias("key_values")))
    return table(spark, sf, "documents").select(
        doc.alias("run_id"), F.col("lang").alias("template_id"), F.concat(doc, F.lit(".PNG")).alias("file_name"), F.lit("image/png").alias("content_type"),
        F.encode("text", "utf-8").alias("image"), kvp.alias("kvp"), F.lit("2024-01-01T00:00:00+00:00").alias("created_at"),
    )


@query("""SELECT doc_id::VARCHAR AS run_id, lang AS template_id, n_chars::VARCHAR AS value, strlen(text) AS bytes, 'bronze/raw-images/' || lang || '/' || doc_id || '.png' AS bronze_path FROM documents""")
def ingest_round_trip(spark, sf):
    """Ingested bronze and silver tables, read back and joined; half of the runs come twice in one call, the older one first or last."""
    root = scratch(spark, "ingest")
    rows = uploads(spark, sf)
    older = rows.filter("CAST(run_id AS LONG) % 2 = 0").withColumn("created_at", F.lit("2023-12-31T00:00:00+00:00")).withColumn("image", F.encode(F.lit("old"), "utf-8"))
    writers.ingest(rows.filter("length(image) % 2 = 0").unionByName(older).unionByName(rows.filter("length(image) % 2 <> 0")), root)
    bronze = store.read(spark, root, "bronze").select("run_id", F.octet_length("image").cast("long").alias("bytes"))
    stored = medallion.parse_silver(store.read(spark, root, "silver").select("name", "payload"))
    runs, parsed = stored.select("run_id", "bronze_path"), medallion.gold_fields(stored)
    return parsed.select("run_id", "template_id", F.col("field_value").alias("value")).join(bronze, "run_id").join(runs, "run_id")


@query("""SELECT 'silver/kvp-json/lang=' || lang AS folder, 'silver' AS kind, 1::BIGINT AS files, true AS filled FROM documents GROUP BY ALL""")
def object_listing(spark, sf):
    """Files of a stored tier, one for each language, and a file outside the prefix that isn't listed."""
    root = scratch(spark, "objects")
    docs = table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    docs.repartition("lang").write.partitionBy("lang").json(f"{root}/silver/kvp-json")
    docs.limit(1).write.json(f"{root}/bronze/raw-images")
    found = readers.list_objects(spark, root, "silver/").filter(F.col("name").endswith(".json"))
    folder = F.regexp_replace("name", "/[^/]*$", "")
    return found.groupBy(folder.alias("folder"), "kind").agg(F.count("*").alias("files"), F.bool_and(F.col("size") > 0).alias("filled"))


@query("""SELECT lang AS template, sum(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')))::BIGINT AS words, count(*) AS docs,
  count_if(regexp_matches(text, '[^ \\t\\r\\n]'))::BIGINT AS boxed FROM documents GROUP BY ALL""")
def ocr_files(spark, sf):
    """OCR payloads written as JSON, read back with the template taken from the path."""
    root = scratch(spark, "ocr")
    pages = inputs.docs(spark, sf)
    payload = pages.select(
        F.col("lang").alias("part"), F.struct(F.lit(10).alias("width"), F.lit(10).alias("height")).alias("image_size"), "words",
        F.transform("words", lambda w: F.array(*(F.lit(float(i)) for i in (0, 0, 1, 1)))).alias("boxes"), F.col("doc_id").cast("string").alias("image_path"),
    )
    payload.write.mode("overwrite").partitionBy("part").json(f"{root}/train")
    read = readers.read_ocr(spark, root, multi_line=False)
    counts = read.select(F.regexp_replace("template", "part=", "").alias("template"), F.size("words").alias("n"), F.get("boxes", F.lit(0)).alias("b"))
    return counts.groupBy("template").agg(F.sum("n").alias("words"), F.count("*").alias("docs"), F.count_if(F.get("b", F.lit(2)) == 1).alias("boxed"))

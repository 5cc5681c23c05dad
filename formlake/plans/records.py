"""Gates, scalar functions, events, jobs and keyed tables over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.functions import text
from formlake.functions.arrays import each
from formlake.operators import events, gates
from formlake.operators.curation import numbered_slugs
from formlake.operators.skew import global_rank
from formlake.plans import inputs
from formlake.plans.registry import query, table
from formlake.session import scratch
from formlake.sources import readers, writers

# ---- gates ------------------------------------------------------------------------------------

EXTENSIONS = (".png", ".JPG", ".pdf", "", ".Tiff")


@query("""WITH files AS (SELECT doc_id, CASE WHEN n_chars % 17 = 3 THEN NULL ELSE 'f' || doc_id || ['.png', '.JPG', '.pdf', '', '.Tiff'][n_chars % 5 + 1] END AS name,
  (n_chars - 30) * 2500 AS size, n_chars % 5 AS k, n_chars % 3 = 0 AS typed FROM documents)
SELECT CASE WHEN name IS NULL THEN 'Missing image file' WHEN size <= 0 THEN 'Uploaded image is empty'
  WHEN size > 52428800 THEN 'Uploaded image is too large. Maximum size is 50MB.'
  WHEN k IN (2, 3) AND NOT typed THEN 'Unsupported file type. Upload a PNG, JPG, JPEG, TIF, or TIFF image.' END AS reason, count(*) AS n, sum(doc_id)::BIGINT AS ids
FROM files GROUP BY ALL""")
def upload_gate(spark, sf):
    n = F.col("n_chars")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (n % 5 + 1).cast("int"))
    name = F.when(n % 17 != 3, F.concat(F.lit("f"), F.col("doc_id").cast("string"), ext))
    kind = F.when(n % 3 == 0, "image/png").otherwise("application/octet-stream")
    reason = gates.upload_reason(name, (n - 30) * 2500, kind)
    return table(spark, sf, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def templates(spark, sf) -> DataFrame:
    """Documents as source rows: each word is an object, with gaps in ids, areas and boxes."""
    n = F.length

    def item(w, i):
        return F.struct(
            F.when(n(w) % 9 != 0, i.cast("long")).alias("id"), F.when(n(w) % 11 != 0, n(w) * 0.7).alias("area"),
            F.when(n(w) % 4 == 0, F.array().cast("array<double>")).otherwise(F.array(i * 10.0, i * 5.0, n(w) * 9.0, n(w) + 12.0)).alias("bbox"),
        )

    objects = F.transform("words", item)
    rows = inputs.docs(spark, sf).withColumn("o", objects)
    nested = F.struct(*(F.col(f"o.{c}").alias(c) for c in ("id", "area", "bbox"))).alias("objects")
    return rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("split"), nested)


def zipped():
    return F.arrays_zip(F.col("objects.id").alias("id"), F.col("objects.area").alias("area"), F.col("objects.bbox").alias("bbox"))


OBJECTS = f"""{inputs.DOCS},
{inputs.WORDS},
objects AS (SELECT doc_id, i, length(w) AS len, n, length(w) % 9 <> 0 AND length(w) % 11 <> 0 AND length(w) * 0.7::DOUBLE > 3 AS ok FROM words)"""


def object_sums(rows: DataFrame) -> DataFrame:
    total = F.aggregate("qualifying_objects", F.lit(0.0), lambda a, o: a + o["area"])
    return rows.select("id", F.size("qualifying_objects").alias("object_count"), F.round(total, 3).alias("area"))


@query(f"WITH {OBJECTS}\nSELECT doc_id AS id, count(*)::INT AS object_count, round(sum(len * 0.7::DOUBLE), 3) AS area FROM objects WHERE ok GROUP BY ALL HAVING count(*) >= 3")
def qualifying_templates(spark, sf):
    """Reads ids and nested objects of a stored source table, then filters inside the rows."""
    path = scratch(spark, "source")
    templates(spark, sf).write.parquet(path)
    return object_sums(gates.keep_templates(readers.read_objects(spark, path), gates.qualifying(zipped())))


@query(f"WITH {OBJECTS}\nSELECT doc_id AS id, count(*)::INT AS object_count, round(sum(len * 0.7::DOUBLE), 3) AS area FROM objects WHERE ok AND len % 4 <> 0 GROUP BY ALL HAVING count(*) >= 3")
def fillable_templates(spark, sf):
    return object_sums(gates.keep_templates(templates(spark, sf), gates.fillable(zipped())))


def detected(spark, sf) -> DataFrame:
    """Documents with a detector's confidence, taken from the hash of the id."""
    confidence = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("int") / 255
    return table(spark, sf, "documents").select("doc_id", "text", "lang", confidence.alias("confidence"))


GATE = """detected AS (SELECT doc_id, text, lang, ('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::BIGINT / 255 AS confidence FROM documents),
records AS (SELECT doc_id, CASE WHEN length(text) >= 40 THEN lang END AS language, CASE WHEN length(text) >= 40 THEN confidence ELSE 0 END AS confidence,
  length(text) >= 40 AND lang = 'en' AND confidence >= 0.6 AS is_english, length(text)::INT AS ocr_text_length, substring(text, 1, 500) AS ocr_preview FROM detected)"""


@query(f"WITH {GATE}\nSELECT doc_id, language, round(confidence, 6) AS confidence, is_english, ocr_text_length, md5(ocr_preview) AS preview FROM records")
def language_records(spark, sf):
    records = gates.language_records(detected(spark, sf))
    return records.withColumn("confidence", F.round("confidence", 6)).withColumn("preview", F.md5("ocr_preview")).drop("ocr_preview")


@query(f"WITH {GATE}\nSELECT count(*) AS processed_files, count_if(is_english)::BIGINT AS english_files FROM records")
def language_counts(spark, sf):
    return gates.language_counts(gates.language_records(detected(spark, sf)))


@query("""SELECT n_chars % 4 AS kind, n_chars % 4 = 0 AS valid, count(*) AS n FROM documents GROUP BY ALL""")
def payload_validity(spark, sf):
    """Payloads that are complete, lack boxes, lack the image size, or are no JSON."""
    words = F.split("text", " ")
    boxes = F.transform(words, lambda w: F.array(F.lit(0.0), F.lit(0.0), F.length(w).cast("double"), F.lit(9.0)))
    size = F.struct(F.lit(10).alias("width"), F.lit(20).alias("height"))
    kind = F.col("n_chars") % 4
    json = F.to_json(F.struct(F.when(kind != 2, size).alias("image_size"), words.alias("words"), F.when(kind != 1, boxes).alias("boxes")))
    payload = F.when(kind == 3, F.substring(json, F.lit(1), F.length(json) - 5)).otherwise(json)
    return table(spark, sf, "documents").select(kind.alias("kind"), gates.valid_payload(payload).alias("valid")).groupBy("kind", "valid").agg(F.count("*").alias("n"))


@query(f"""WITH {inputs.DOCS}
SELECT doc_id, lang = 'de' AS mismatch, CASE WHEN lang = 'de' OR len(words) = 0 THEN 1 ELSE len(words) END::INT AS words,
  CASE WHEN lang = 'de' OR len(words) = 0 THEN '[EMPTY]' ELSE words[1] END AS first FROM docs""")
def mismatched_payloads(spark, sf):
    """German documents lost a box."""
    boxes = F.transform("words", lambda w: F.array(*map(F.lit, (0, 0, 1, 1))))
    short = F.when(F.col("lang") == "de", F.slice(F.concat(boxes, F.array(F.array(*map(F.lit, (0, 0, 1, 1))))), 1, F.size("words") + 1)).otherwise(boxes)
    rows = inputs.docs(spark, sf).withColumn("boxes", short)
    fixed = rows.withColumn("r", gates.repaired(F.col("words"), F.col("boxes")))
    return fixed.select(
        "doc_id", gates.mismatched(F.col("words"), F.col("boxes")).alias("mismatch"), F.size("r.words").alias("words"), F.get("r.words", F.lit(0)).alias("first")
    )


def review_rows(spark, sf) -> DataFrame:
    """Each line of a document as a reviewed row; lines of odd length were typed in by hand."""
    rows = each(table(spark, sf, "documents"), ["doc_id"], F.split("text", "\n"), "line", "row")
    n, null = F.length("line"), F.lit(None)
    key = F.when(n % 6 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.substring_index("line", " ", 1)))
    value = F.when(n % 6 == 0, F.when(n % 12 == 0, null.cast("string")).otherwise("typed")).otherwise(F.concat("line", F.lit(" ")))
    return rows.select(
        "doc_id", "row", key.alias("key"), value.alias("value"), F.when(n % 2 == 1, "custom").otherwise("ocr").alias("value_mode"),
        (n % 10 / 10).alias("score"), F.array(n, n).alias("key_bbox"), F.array(n).alias("value_bbox"),
    )


REVIEW = """lines AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS row, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
typed AS (SELECT doc_id, row, length(line) AS n, CASE WHEN length(line) % 6 = 0 THEN '' ELSE trim(string_split(line, ' ')[1], ' ') END AS key,
  CASE WHEN length(line) % 12 = 0 THEN '' WHEN length(line) % 6 = 0 THEN 'typed' ELSE trim(line, ' ') END AS value FROM lines),
review AS (SELECT doc_id, row, key, value, CASE WHEN n % 2 = 0 THEN (n % 10) / 10 END AS score, CASE WHEN n % 2 = 0 THEN n END AS corner,
  CASE WHEN n % 2 = 1 THEN 'custom' END AS source FROM typed WHERE key <> '' OR value <> '')"""


@query(f"WITH {REVIEW}\nSELECT doc_id, row, md5(key || '|' || value) AS pair, score, corner::INT AS corner, source FROM review")
def review_pairs(spark, sf):
    pairs = gates.review_pairs(review_rows(spark, sf))
    return pairs.select("doc_id", "row", F.md5(F.concat_ws("|", "key", "value")).alias("pair"), "score", F.get("key_bbox", F.lit(0)).alias("corner"), "source")


@query(f"""WITH {REVIEW},
first AS (SELECT doc_id, lower(key) AS folded, min(row) AS row, arg_min(key, row) AS key FROM review WHERE key <> '' GROUP BY ALL)
SELECT doc_id, row, key, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row) AS place FROM first) WHERE place <= 8""")
def key_suggestions(spark, sf):
    return gates.suggestions(gates.review_pairs(review_rows(spark, sf)), "doc_id", "key", "row").select("doc_id", "row", "key", "place")


@query("""WITH kept AS (SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 50)
SELECT p_name, l_partkey, count(*) AS queries FROM lineitem JOIN kept ON l_partkey = p_partkey GROUP BY ALL""")
def limited_templates(spark, sf):
    gallery = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    found, kept = gates.limit_templates(table(spark, sf, "lineitem"), gallery, "l_partkey", [F.lower("p_name"), F.col("l_partkey")], 50)
    return found.join(kept, "l_partkey").groupBy("p_name", "l_partkey").agg(F.count("*").alias("queries"))


# ---- scalar functions --------------------------------------------------------------------------

NUMBER = r"'^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$'"


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '-'), ''), 'unknown') AS key_part,
  regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS stem, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'template') AS slug,
  lower(regexp_extract(string_split(url, '/')[-1], '^.+\.([^.]+)$', 1)) AS suffix, lower(regexp_extract(url, '(\.[^.]*)$', 1)) AS extension,
  regexp_matches(url, '^[A-Za-z0-9_-]+$') AS safe, string_split(url, '-')[1] AS split_name,
  'en__' || page_id || '__' || regexp_replace(regexp_replace(string_split(url, '/')[-1], '^(.+)\.[^.]*$', '\1'), '[^\p{L}\p{N}_-]', '_', 'g') AS base_name FROM pages""")
def text_functions(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", text.clean_key_part(u, F.lit("unknown")).alias("key_part"), text.safe_stem(u).alias("stem"), text.slugify(u).alias("slug"),
        text.path_suffix(u).alias("suffix"), text.upload_extension(u).alias("extension"), text.is_safe_id(u).alias("safe"),
        text.split_of_file(u).alias("split_name"), text.base_name(F.lit("en"), F.col("page_id"), u).alias("base_name"),
    )


@query("""WITH slugs AS (SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(url, '//([^/]+)', 1), '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'template') AS slug FROM pages),
numbered AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS r FROM slugs)
SELECT page_id, CASE WHEN r = 1 THEN slug ELSE slug || '_' || r END AS name FROM numbered""")
def unique_slugs(spark, sf):
    """Repeated slugs get _2, _3, .. in page order."""
    host = F.regexp_extract("url", "//([^/]+)", 1)
    return numbered_slugs(table(spark, sf, "pages").select("page_id", text.slugify(host).alias("slug")), "slug", "page_id").select("page_id", "name")


@query(f"""WITH {inputs.DOCS},
{inputs.WORDS},
parsed AS (SELECT doc_id, CASE WHEN regexp_matches(w, {NUMBER}) THEN trim(w)::DOUBLE END AS v FROM words)
SELECT doc_id, count(*) AS words, count(v) AS numbers, min(v) AS low, max(v) AS high FROM parsed GROUP BY ALL""")
def number_parsing(spark, sf):
    rows = each(inputs.docs(spark, sf), ["doc_id"], F.col("words"), "w").withColumn("v", text.parse_number(F.col("w")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("words"), F.count("v").alias("numbers"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, ('0x' || substr(sha256('42:' || event_type || event_id), 1, 16))::UBIGINT::VARCHAR AS seed,
  greatest(0, least(100, floor(value / 100 * 100 + 0.5)))::INT AS percent, (props->>'$.k')::BIGINT AS k FROM events""")
def event_functions(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", text.iso_utc(F.col("ts"), instant=False).alias("iso"), text.stable_seed(F.concat("event_type", F.col("event_id").cast("string")), 42).alias("seed"),
        text.score_percent(F.col("value") / 100).alias("percent"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


@query("""SELECT doc_id, n_chars, CASE WHEN n_chars % 3 = 0 THEN 'jpg' WHEN n_chars % 3 = 1 THEN 'png' WHEN n_chars % 2 = 0 THEN 'webp' ELSE 'bin' END AS extension,
  CASE n_chars % 3 WHEN 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime FROM documents""")
def image_types(spark, sf):
    n = F.col("n_chars")
    name = F.when(n % 3 == 0, "a.b.JPG").otherwise("scan")
    kind = F.when(n % 3 == 1, "image/PNG").when(n % 2 == 0, "image/webp").otherwise("text/plain")
    return table(spark, sf, "documents").select("doc_id", "n_chars", text.image_extension(name, kind).alias("extension"), text.mime_type(name).alias("mime"))


@query("""SELECT doc_id, true AS valid, lang = 'en' AS tagged, n_chars FROM documents WHERE n_chars % 10 <> 0
UNION ALL SELECT doc_id, false, NULL, NULL FROM documents WHERE n_chars % 10 = 0""")
def json_envelopes(spark, sf):
    """Envelopes built and parsed again; one in ten is cut short and flagged."""
    n = F.col("n_chars")
    json = F.to_json(F.struct(n.alias("n"), (F.col("lang") == "en").alias("tagged"), F.col("text")))
    sent = table(spark, sf, "documents").select("doc_id", F.when(n % 10 == 0, F.substring(json, F.lit(1), F.length(json) - 2)).otherwise(json).alias("json"))
    schema = "n long, tagged boolean, text string, _corrupt_record string"
    parsed = sent.select("doc_id", F.from_json("json", schema, {"mode": "PERMISSIVE"}).alias("p"))
    good = F.col("p._corrupt_record").isNull()
    return parsed.select("doc_id", good.alias("valid"), F.when(good, F.col("p.tagged")).alias("tagged"), F.when(good, F.col("p.n")).alias("n_chars"))


# ---- events -------------------------------------------------------------------------------------


def metric_events(spark, sf) -> DataFrame:
    """views and clicks are queries, signups precompute runs, errors storage, purchases selections."""
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    timed = kind.isin("view", "click", "signup")
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("seq"), "ts",
        F.when(kind.isin("view", "click"), "query").when(kind == "signup", "precompute").when(kind == "error", "storage").otherwise("selection").alias("event_type"),
        F.when(kind != "purchase", k >= 10).alias("success"), F.when(timed, F.col("value") * 10).alias("latency_ms"),
        F.when(kind.isin("view", "click"), (k % 11).cast("long")).alias("match_count"),
        F.when(kind.isin("view", "click"), F.when(k % 7 == 0, F.array().cast("array<double>")).otherwise(F.array(k / 100, k / 200))).alias("top_scores"),
        F.when(kind == "purchase", 1 + k % 6).alias("selected_rank"),
    )


DASHBOARD = """e AS (SELECT *, (props->>'$.k')::INT AS k, CASE WHEN event_type IN ('view', 'click') THEN 'query' WHEN event_type = 'signup' THEN 'precompute'
  WHEN event_type = 'error' THEN 'storage' ELSE 'selection' END AS kind FROM events),
d AS (SELECT count_if(kind = 'query')::BIGINT AS total_queries, count_if(kind = 'query' AND k >= 10)::BIGINT AS successful_queries, count_if(kind = 'query' AND k < 10)::BIGINT AS failed_queries,
  floor(coalesce(avg(value * 10) FILTER (kind = 'query' AND k >= 10), 0) + 0.5)::BIGINT AS average_query_latency_ms,
  round(coalesce(avg(k % 11) FILTER (kind = 'query' AND k >= 10), 0), 1) AS average_returned_match_count,
  round(coalesce(avg(k / 100) FILTER (kind = 'query' AND k >= 10 AND k % 7 <> 0), 0), 4) AS average_top1_similarity_score,
  count_if(kind = 'selection' AND k % 6 = 0)::BIGINT AS top_1, count_if(kind = 'selection' AND k % 6 = 1)::BIGINT AS top_2, count_if(kind = 'selection' AND k % 6 = 2)::BIGINT AS top_3,
  count_if(kind = 'selection' AND k % 6 >= 3)::BIGINT AS top_4_plus, floor(coalesce(avg(value * 10) FILTER (kind = 'precompute' AND k >= 10), 0) + 0.5)::BIGINT AS average_precompute_latency_ms,
  count_if(kind = 'precompute' AND k < 10)::BIGINT AS failed_precompute_count, count_if(kind = 'precompute' AND k >= 10)::BIGINT AS successful_precompute_count,
  count_if(kind = 'storage' AND k >= 10)::BIGINT AS storage_success_count, count_if(kind = 'storage' AND k < 10)::BIGINT AS storage_failure_count, count_if(kind = 'storage')::BIGINT AS total_storage_events FROM e)"""


@query(f"WITH {DASHBOARD}\nSELECT * FROM d")
def dashboard_metrics(spark, sf):
    return events.dashboard(events.event_sums(metric_events(spark, sf)))


@query(f"""WITH {DASHBOARD},
r AS (SELECT unnest([('Top 1', top_1), ('Top 2', top_2), ('Top 3', top_3), ('Top 4+', top_4_plus)]) AS p, greatest(1, top_1, top_2, top_3, top_4_plus) AS m FROM d)
SELECT p[1] AS label, p[2] AS value, floor(p[2] / m * 100 + 0.5)::BIGINT AS width FROM r""")
def rank_shares(spark, sf):
    return events.rank_shares(events.event_sums(metric_events(spark, sf)))


@query("SELECT event_id AS seq, event_id::VARCHAR AS event_id FROM events ORDER BY ts DESC, events.event_id DESC LIMIT 12")
def recent_events(spark, sf):
    return events.recent(metric_events(spark, sf), ["ts", "seq"]).select("seq", "event_id")


# ---- jobs and keyed tables -------------------------------------------------------------------------


def job_changes(spark, sf) -> DataFrame:
    """Turns of a conversation as job changes: system and every fourth turn create, users run, replies end."""
    role, n = F.col("role"), F.length("text")
    action = (
        F.when((role == "system") | (F.col("turn") % 4 == 3), "create").when(role == "user", "running")
        .when(n % 3 == 0, "failed").otherwise("ready")
    )
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 600 + F.col("turn") * 60)
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), action.alias("action"), at.alias("at"))


JOBS = """changes AS (SELECT conv_id AS run_id, turn AS seq, CASE WHEN role = 'system' OR turn % 4 = 3 THEN 'create' WHEN role = 'user' THEN 'running'
  WHEN length(text) % 3 = 0 THEN 'failed' ELSE 'kvp_ready' END AS action, 1704067200 + conv_id * 600 + turn * 60 AS happened FROM conversations),
per AS (SELECT run_id, arg_max(action, seq) FILTER (action <> 'create') AS o, max(seq) FILTER (action <> 'create') AS o_seq, max(seq) FILTER (action = 'create') AS c_seq FROM changes GROUP BY ALL),
fresh AS (SELECT *, o IS NULL OR (o = 'failed' AND coalesce(c_seq > o_seq, false)) AS fresh FROM per),
jobs AS (SELECT run_id, CASE WHEN fresh THEN 'accepted' ELSE o END AS status, CASE WHEN fresh THEN 'pending' WHEN o = 'kvp_ready' THEN 'ready' ELSE o END AS kvp_status,
  1704067200 + run_id * 600 + CASE WHEN fresh THEN c_seq ELSE o_seq END * 60 AS updated, CASE WHEN NOT fresh AND o IN ('kvp_ready', 'failed') THEN 1704067200 + run_id * 600 + o_seq * 60 END AS finished FROM fresh)"""


def job_rows(jobs: DataFrame) -> DataFrame:
    return jobs.select("run_id", "status", "kvp_status", F.unix_seconds("updated_at").alias("updated"), F.unix_seconds("finished_at").alias("finished"))


@query(f"WITH {JOBS}\nSELECT * FROM jobs")
def job_states(spark, sf):
    return job_rows(events.latest_jobs(job_changes(spark, sf)))


@query(f"WITH {JOBS}\nSELECT * FROM jobs WHERE updated >= (SELECT max(happened) FROM changes) - 14400")
def live_jobs(spark, sf):
    changes = job_changes(spark, sf)
    return job_rows(events.live_jobs(events.latest_jobs(changes), changes.agg(F.max("at")).scalar()))


@query("""WITH requests AS (SELECT 'User ' || user_id AS name, CASE WHEN user_id % 10 = 3 THEN 'user' || user_id ELSE 'user' || user_id || '@example.com' END AS email, event_id FROM events)
SELECT name, email, max(event_id) AS requested_at FROM requests WHERE email LIKE '%@%' GROUP BY ALL""")
def access_requests(spark, sf):
    """Latest request per address; addresses come in mixed case, some without a domain."""
    u = F.col("user_id").cast("string")
    local = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit(" USER")).otherwise(F.lit("user")), u)
    email = F.when(F.col("user_id") % 10 == 3, local).otherwise(F.concat(local, F.lit("@Example.com ")))
    rows = table(spark, sf, "events").select(F.concat(F.lit("User "), u).alias("name"), email.alias("email"), F.col("event_id").alias("requested_at"))
    clean = events.access_requests(rows)
    early = F.col("requested_at") < rows.agg(F.avg("requested_at")).scalar()
    return events.upsert(clean.filter(early), clean.filter(~early), "email", "requested_at")


@query("""SELECT doc_id AS id, lang AS template_id, n_chars::VARCHAR AS word_count, row_number() OVER (ORDER BY doc_id DESC) AS place FROM documents ANTI JOIN labels USING (doc_id)""")
def template_listing(spark, sf):
    """Template rows newest first, with a value read from their JSON, after deleting the labelled ones."""
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("template_id"), F.to_json(F.struct(F.col("n_chars").alias("word_count"))).alias("ocr_json")
    )
    kept = events.delete_keys(rows, table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id")
    listed = global_rank(kept, [F.desc("id")], "place")
    return events.newest_first(listed.select("id", "template_id", F.get_json_object("ocr_json", "$.word_count").alias("word_count"), "place"), "id")


# ---- files ------------------------------------------------------------------------------------------


@query("""SELECT lang, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang <> 'fr' GROUP BY ALL UNION ALL
SELECT NULL, count(*), NULL FROM documents WHERE lang = 'fr'""")
def manifest_lines(spark, sf):
    """A JSON-lines manifest with broken French lines, kept as corrupt records."""
    path = scratch(spark, "manifest")
    json = F.to_json(F.struct("lang", "n_chars"))
    table(spark, sf, "documents").select(F.when(F.col("lang") == "fr", F.substring(json, 1, 9)).otherwise(json).alias("value")).write.text(path)
    read = readers.read_manifest(spark, path, "lang string, n_chars long, _corrupt_record string")
    good = F.col("_corrupt_record").isNull()
    return read.groupBy(F.when(good, F.col("lang")).alias("lang")).agg(F.count("*").alias("rows"), F.sum(F.when(good, F.col("n_chars"))).alias("chars"))


@query("""SELECT o_orderkey::INT AS epoch, o_totalprice AS loss, o_orderpriority AS note FROM orders""")
def history_file(spark, sf):
    path = scratch(spark, "history")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("loss"), F.col("o_orderpriority").alias("note"))
    rows.write.option("header", True).csv(path)
    return readers.read_history(spark, path)


@query(f"""WITH {inputs.DOCS},
counted AS (SELECT doc_id, lang, words, len(words) AS n FROM docs)
SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE n END::INT AS words, CASE WHEN lang <> 'de' AND n > 0 THEN words[1] END AS first FROM counted""")
def payload_layouts(spark, sf):
    """Words under `words`, under pages, under a form, or in an unknown layout."""
    word = F.transform("words", lambda w: F.struct(w.alias("text"), F.array(F.lit(1.0)).alias("bbox")))
    block = F.transform("words", lambda w: F.struct(w.alias("text"), F.array(F.lit(1.0)).alias("box")))
    spaced = F.concat(word, F.array(F.struct(F.lit("  ").alias("text"), F.array(F.lit(1.0)).alias("bbox"))))
    lang = F.col("lang")
    json = (
        F.when(lang == "en", F.to_json(F.struct(word.alias("words"))))
        .when(lang == "fr", F.to_json(F.struct(F.array(F.struct(spaced.alias("words"))).alias("pages"))))
        .when(lang == "es", F.to_json(F.struct(F.array(F.struct(block.alias("words"))).alias("form"))))
        .otherwise(F.to_json(F.struct(word.alias("tokens"))))
    )
    rows = inputs.docs(spark, sf).select("doc_id", readers.any_layout_words(json).alias("w"))
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), F.size("w")).alias("words"), F.get("w.text", F.lit(0)).alias("first"))


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'es') THEN 1 ELSE 10 END::INT AS words, CASE WHEN lang IN ('en', 'fr', 'es') THEN source || 'x' ELSE 'name' END AS first FROM documents""")
def word_banks(spark, sf):
    """A bank as list, as `words` and as keys; without letters it falls back to the fixed bank."""
    w, lang = F.concat("source", F.lit("x")), F.col("lang")
    json = (
        F.when(lang == "en", F.to_json(F.array(w, F.lit("--"))))
        .when(lang == "fr", F.to_json(F.struct(F.array(w, F.lit(" ")).alias("words"))))
        .when(lang == "es", F.to_json(F.create_map(w, F.lit(3))))
        .otherwise(F.lit('["..."]'))
    )
    rows = table(spark, sf, "documents").select("doc_id", readers.word_bank(json).alias("b"))
    return rows.select("doc_id", F.size("b").alias("words"), F.get("b", F.lit(0)).alias("first"))


@query("SELECT lang, count(*) AS rows, sum(n_chars)::BIGINT AS chars, max(n_chars)::BIGINT AS longest, (SELECT count(*) FROM documents) AS n FROM documents GROUP BY ALL")
def report_files(spark, sf):
    """Per-row and per-template CSV and a JSON summary, read back."""
    root = scratch(spark, "report")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    per = docs.groupBy("lang").agg(F.count("*").alias("rows"), F.max("n_chars").alias("longest"))
    writers.write_report(docs, per, docs.agg(F.count("*").alias("n")), root)
    rows = spark.read.schema("doc_id long, lang string, n_chars long").option("header", True).csv(f"{root}/rows")
    back = spark.read.schema("lang string, rows long, longest long").option("header", True).csv(f"{root}/templates")
    total = spark.read.schema("n long").json(f"{root}/summary").scalar()
    return rows.groupBy("lang").agg(F.sum("n_chars").alias("chars")).join(back, "lang").withColumn("n", total)


@query("SELECT label::BIGINT AS label, count(*) AS vectors, round(sum(list_sum(embedding::DOUBLE[])), 3) AS total FROM embeddings GROUP BY ALL")
def embedding_table(spark, sf):
    """Vectors stored in two runs; the second embeds only what the first left out."""
    path = scratch(spark, "embeddings")
    source = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    writers.append_missing(source.filter("label < 5"), path, "vec_id", lambda df: df)
    writers.append_missing(source, path, "vec_id", lambda df: df)
    return spark.read.parquet(path).groupBy("label").agg(
        F.count("*").alias("vectors"), F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))), 3).alias("total")
    )

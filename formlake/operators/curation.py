"""Dataset curation: joins of source files, splits, samples, dictionaries, fill plans."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions.arrays import bind, each, hash_number, hash_pick
from formlake.functions.text import dictionary_words, half_even
from formlake.operators.skew import first_rows, global_rank, group_rank, hash_rank, join_on_counted_key, lookup_on_counted_key

SPLITS = ("train", "val", "test")


def seeded(seed: int | str, *columns: str) -> Column:
    """Text whose md5 orders rows at random and reproducibly."""
    return F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))


def require(rows: DataFrame, counted: DataFrame, least: int, message: str) -> DataFrame:
    """`rows`, or an error when `counted` has fewer than `least` rows.

    The check is a filter on the one row of the count, which adds no row when it passes;
    so it also fails when no row is left.
    """
    n = counted.agg(F.count("*").alias("_n"))
    error = F.raise_error(F.lit(message)).cast("boolean")
    guard = n.filter(F.when(F.col("_n") >= least, F.lit(False)).otherwise(error))
    return rows.unionByName(guard.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)))


# ---- joins of source files -----------------------------------------------------------------------


def region_boxes(metadata: DataFrame, source: DataFrame) -> DataFrame:
    """Each qualifying object of the metadata with its box from the source rows.

    metadata: source_parquet, row_id, qualifying_objects (object_id, area).
    source: source_parquet, id, objects. `row_found` is false when the source row is
    missing, `bbox` null when only the object is.
    """
    wanted = each(metadata, ["source_parquet", "row_id"], F.col("qualifying_objects"), "q").select(
        "source_parquet", "row_id", F.col("q.object_id").alias("object_id"), F.coalesce("q.area", F.lit(0.0)).alias("area")
    )
    rows = source.select("source_parquet", F.col("id").alias("row_id"), "objects")
    pairs = F.arrays_zip(F.col("objects.id").alias("id"), F.col("objects.bbox").alias("bbox"))
    boxes = each(rows, ["source_parquet", "row_id"], pairs, "o").select(
        "source_parquet", "row_id", F.col("o.id").alias("object_id"), F.col("o.bbox").alias("bbox")
    ).filter(F.col("object_id").isNotNull() & F.col("bbox").isNotNull())
    present = rows.select("source_parquet", "row_id").distinct().withColumn("row_found", F.lit(True))
    return (
        wanted.join(boxes.hint("merge"), ["source_parquet", "row_id", "object_id"], "left")
        .join(present, ["source_parquet", "row_id"], "left")
        .withColumn("row_found", F.coalesce("row_found", F.lit(False)))
        .withColumn("bbox_format", F.lit("xywh"))
    )


def region_summary(regions: DataFrame) -> DataFrame:
    """Regions written, boxes missing, and metadata rows whose source row is missing."""
    found = F.col("row_found")
    failed = F.when(~found, F.struct("source_parquet", "row_id"))
    return regions.agg(
        F.count_if(found & F.col("bbox").isNotNull()).alias("regions_written"),
        F.count_if(found & F.col("bbox").isNull()).alias("missing_boxes"),
        F.count_distinct(failed).alias("failures"),
    )


def failure_preview(regions: DataFrame, limit: int = 50) -> DataFrame:
    return regions.filter(~F.col("row_found")).select("source_parquet", "row_id").distinct().orderBy("source_parquet", "row_id").limit(limit)


def ready_templates(images: DataFrame, ocr: DataFrame, originals: DataFrame, key: str, name: str, need: int = 10, first: int | None = None) -> DataFrame:
    """Templates with exactly `need` images, `need` OCR files and an original; the first by name."""

    def complete(files: DataFrame) -> DataFrame:
        return files.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == need).select(key)

    ready = originals.join(complete(images), key, "left_semi").join(complete(ocr), key, "left_semi")
    return ready if first is None else ready.orderBy(F.lower(F.col(name)), name, key).limit(first)


def select_beyond(names: DataFrame, excluded: list[DataFrame], key: str, order: list[Column], skip: int, take: int) -> DataFrame:
    """Names in no exclusion set, without the first `skip`, the next `take`; an error when too few."""
    union = excluded[0].select(key)
    for other in excluded[1:]:
        union = union.union(other.select(key))
    eligible = global_rank(names.join(union, key, "left_anti"), order, "place")
    window = eligible.filter((F.col("place") > skip) & (F.col("place") <= skip + take))
    return require(window, eligible, skip + take, "too few eligible names")


def load_queries(templates: DataFrame, originals: DataFrame, original_ocr: DataFrame, degraded: DataFrame, queries: DataFrame, query_ocr: DataFrame, key: str, query_key: str) -> DataFrame:
    """Queries with OCR of the templates that have an original, its OCR and degraded copies."""
    usable = templates
    for needed in (originals, original_ocr, degraded):
        usable = usable.join(needed.select(key), key, "left_semi")
    return queries.join(usable.select(key), key, "left_semi").join(query_ocr.select(query_key), query_key, "left_semi")


def triple_join(images: DataFrame, truths: DataFrame, ocr: DataFrame, stem: str) -> DataFrame:
    """All images with what they lack: `missing` is null for complete ones, else 'gts' or 'ocr'."""
    t = truths.select(stem).distinct().withColumn("has_gts", F.lit(True))
    o = ocr.select(stem).distinct().withColumn("has_ocr", F.lit(True))
    missing = F.when(F.col("has_gts").isNull(), "gts").when(F.col("has_ocr").isNull(), "ocr")
    return images.join(t, stem, "left").join(o, stem, "left").withColumn("missing", missing).drop("has_gts", "has_ocr")


def preferred_paths(items: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """Listed path when the file exists, else the index's path for the stem; null when neither.

    items: stem, listed_path. files: path. index: stem, path.
    """
    exists = files.select(F.col("path").alias("listed_path")).distinct().withColumn("exists", F.lit(True))
    lookup = index.select("stem", F.col("path").alias("indexed"))
    joined = lookup_on_counted_key(items.join(exists, "listed_path", "left"), lookup, "stem", "listed_path")
    return joined.withColumn("path", F.coalesce(F.when(F.col("exists"), F.col("listed_path")), "indexed")).drop("exists", "indexed")


def first_by_stem(paths: DataFrame) -> DataFrame:
    """First path per stem in case-insensitive order (columns stem, path)."""
    first = F.min(F.struct(F.lower("path").alias("l"), "path"))
    return paths.groupBy("stem").agg(first.alias("f")).select("stem", F.col("f.path").alias("path"))


def pending(items: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Items without an output yet."""
    return items.join(done.select(*keys), list(keys), "left_anti")


def missing_fills(templates: DataFrame, done: DataFrame, key: str, fills: int) -> DataFrame:
    """(template, fill_index) still to be made of 0 .. fills-1."""
    wanted = templates.select(key, F.explode(F.sequence(F.lit(0), F.lit(fills - 1))).alias("fill_index"))
    return pending(wanted, done, key, "fill_index")


def subset_with_metadata(items: DataFrame, metadata: DataFrame, key: str, path: str, n: int) -> DataFrame:
    """First n items by path, and whether each has metadata."""
    first = first_rows(items, [F.col(path), F.col(key)], n)
    return first.join(metadata.select(key).distinct().withColumn("m", F.lit(True)), key, "left").withColumn("has_metadata", F.col("m").isNotNull()).drop("m")


def numbered_slugs(slugs: DataFrame, slug: str, order: str) -> DataFrame:
    """Unique names: the first keeps its slug, later ones get _2, _3, .. in order."""
    ranked = group_rank(slugs, [slug], [F.col(order)], "place")
    name = F.when(F.col("place") == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("_"), F.col("place").cast("string")))
    return ranked.withColumn("name", name)


def bundles(items: DataFrame, order: list[Column], path: str, size: int = 100) -> DataFrame:
    """Fixed-size bundles in order: number of pages, first and last path."""
    ranked = global_rank(items, order, "place")
    bundle = F.floor((F.col("place") - 1) / size)
    return ranked.groupBy(bundle.alias("bundle")).agg(
        F.count("*").alias("page_count"), F.min_by(path, "place").alias("first_image"), F.max_by(path, "place").alias("last_image")
    )


# ---- splits and samples -------------------------------------------------------------------------


def fixed_splits(names: DataFrame, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """Random slices of given sizes; the rest has no split. An error when there are too few names."""
    ranked = hash_rank(names, seeded(seed, key), "place")
    label = F.lit(None).cast("string")
    for name, size in reversed(list(_ends(sizes).items())):
        label = F.when(F.col("place") <= size, name).otherwise(label)
    placed = ranked.withColumn("split", label).drop("place")
    return require(placed, names, sum(sizes.values()), "too few names for the splits")


def _ends(sizes: dict[str, int]) -> dict[str, int]:
    ends, total = {}, 0
    for name, size in sizes.items():
        total += size
        ends[name] = total
    return ends


def apportion(n: Column, weights: dict[str, int]) -> dict[str, Column]:
    """Whole numbers in proportion to the weights that add up to n: largest remainder first, then order."""
    total = sum(weights.values())
    names = [k for k, w in weights.items() if w > 0]
    base = {k: F.floor(n * weights[k] / total) for k in names}
    rest = {k: (n * weights[k]) % total for k in names}
    left = n - sum(base.values())
    out = {k: F.lit(0).cast("long") for k in weights}
    for i, k in enumerate(names):
        ahead = F.lit(0)
        for j, other in enumerate(names):
            if other != k:
                wins = (rest[other] >= rest[k]) if j < i else (rest[other] > rest[k])
                ahead = ahead + wins.cast("int")
        out[k] = (base[k] + (ahead < left).cast("long")).cast("long")
    return out


def weighted_splits(names: DataFrame, key: str, weights: dict[str, int], seed: int = 42) -> DataFrame:
    """Random splits whose sizes are apportioned over all names."""
    ranked = hash_rank(names, seeded(seed, key), "place").withColumn("n", names.agg(F.count("*")).scalar())
    sizes = apportion(F.col("n"), weights)
    end, ends = F.lit(0), []
    for name, size in sizes.items():
        end = end + size
        ends.append((name, end))
    label = F.lit(None).cast("string")
    for name, stop in reversed(ends):
        label = F.when(F.col("place") <= stop, name).otherwise(label)
    return ranked.withColumn("split", label).drop("place", "n")


def train_test(names: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Random train share, at least one name."""
    size = F.greatest(F.lit(1), half_even(names.agg(F.count("*")).scalar() * share))
    ranked = hash_rank(names, seeded(seed, key), "place")
    return ranked.withColumn("split", F.when(F.col("place") <= size, "train").otherwise("test")).drop("place")


def sized(rows: DataFrame, by: str, salt_by: str) -> DataFrame:
    """Rows with the size of their group in `group_size`."""
    return join_on_counted_key(rows, rows.groupBy(by).agg(F.count("*").alias("group_size")), by, "group_size", salt_by)


def class_holdout(examples: DataFrame, by: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Random share of each class held out: at least one, and all but one at most."""
    n = F.col("group_size")
    target = F.least(F.greatest(F.lit(1), half_even(n * fraction)), F.greatest(F.lit(1), n - 1))
    ranked = hash_rank(sized(examples, by, key), seeded(seed, by, key), "place", [by])
    return ranked.withColumn("split", F.when(F.col("place") <= target, "val").otherwise("train")).drop("place", "group_size")


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n random rows in key order."""
    return first_rows(rows, [F.md5(seeded(seed, key)), F.col(key)], n).orderBy(key)


def balanced_batches(examples: DataFrame, by: str, key: str, classes: int, samples: int, seed: int = 42) -> DataFrame:
    """Batches of `classes` distinct classes with `samples` members each; short classes repeat members.

    Every round deals all classes, in an order of their own hash of the round, over as
    many batches as they fill; a class's turn takes the next `samples` members in its
    hashed order. So class sets differ from round to round, all members come up before
    one comes again, and each slot is an equi-join: no class is gathered or crossed.
    """
    members = hash_rank(sized(examples, by, key), seeded(seed, by, key), "member", [by])
    sizes = examples.groupBy(by).agg(F.count("*").alias("group_size"))
    total, n_classes = examples.agg(F.count("*"), F.count_distinct(by)).first()
    per_batch = max(1, min(classes, n_classes))
    n_batches, per_round = ceil(total / max(1, classes * samples)), max(1, n_classes // per_batch)
    rounds = F.sequence(F.lit(0), F.lit(max(0, ceil(n_batches / per_round) - 1)))
    turns = hash_rank(sizes.withColumn("round", F.explode(rounds)), seeded(seed, "round", by), "turn", ["round"])
    at = F.col("turn") - 1
    batch = F.col("round") * per_round + F.floor(at / per_batch)
    slots = turns.filter((at < per_round * per_batch) & (batch < n_batches)).select(
        batch.cast("long").alias("batch"), (at % per_batch).cast("int").alias("slot"), by, "round", "group_size"
    )
    chosen = slots.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    picked = chosen.withColumn("member", (F.col("round") * samples + F.col("i")) % F.col("group_size") + 1)
    return picked.select("batch", "slot", "i", by, "member").join(members.select(by, "member", key), [by, "member"]).select("batch", "slot", "i", by, key)


def fixed_modes(images: DataFrame, by: str, key: str, counts: dict[str, int], rest: str = "clean", seed: int = 42) -> DataFrame:
    """Random mode per image of a template: `counts` images per mode, the others `rest`."""
    ranked = hash_rank(images, seeded(seed, by, key), "place", [by])
    label = F.lit(rest)
    for name, end in reversed(list(_ends(counts).items())):
        label = F.when(F.col("place") <= end, name).otherwise(label)
    return ranked.withColumn("mode", label).drop("place")


def shared_modes(images: DataFrame, by: str, key: str, clean: float = 0.5, mask: float = 0.3, seed: int = 42) -> DataFrame:
    """Random mode per image by shares of the template's images: floor, floor, rest."""
    n = F.col("group_size")
    ranked = hash_rank(sized(images, by, key), seeded(seed, by, key), "place", [by])
    first, second = F.floor(n * clean), F.floor(n * mask)
    mode = F.when(F.col("place") <= first, "clean").when(F.col("place") <= first + second, "mask").otherwise("corrupt")
    return ranked.withColumn("mode", mode).drop("place", "group_size")


def augmented_copies(docs: DataFrame, record_id: str = "record_id", shift: int = 100_000, subset: str = "augmented") -> tuple[DataFrame, DataFrame]:
    """Documents with one copy each under a shifted id, and the source-to-copy manifest."""
    copies = docs.withColumn(record_id, F.col(record_id) + shift).withColumn("subset", F.lit(subset))
    manifest = docs.select(F.col(record_id).alias("source_record_id"), (F.col(record_id) + shift).alias("record_id"))
    return docs.unionByName(copies), manifest


# ---- dictionaries and fill plans -------------------------------------------------------------------


def dictionary(texts: DataFrame, text: str = "text", size: int = 500) -> DataFrame:
    """Most frequent words (position, word, count), ties by word; an error when there are too few."""
    counts = each(texts, [], dictionary_words(F.col(text)), "word").groupBy("word").agg(F.count("*").alias("count"))
    top = counts.orderBy(F.desc("count"), "word").limit(size)
    rows = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "word"))).alias("rows"))  # `size` rows
    whole = F.when(F.size("rows") == size, F.col("rows")).otherwise(F.raise_error(F.lit("too few words for the dictionary")).cast(rows.schema["rows"].dataType))
    return rows.select(F.posexplode(whole).alias("position", "r")).select(
        "position", F.col("r.word").alias("word"), (-F.col("r.n")).alias("count")
    )


def dictionary_array(words: DataFrame) -> Column:
    """The dictionary as one array value; its length is the dictionary's fixed size."""
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "word"))), lambda r: r["word"])).scalar()


def word_budget(width: Column) -> Column:
    """Words that fit a field of this width."""
    budget = F.lit(7)
    # fixed values: width limits of 1 to 6 words
    for words, limit in reversed(list(enumerate((110, 180, 280, 420, 650, 900), start=1))):
        budget = F.when(width < limit, words).otherwise(budget)
    return budget


def good_height(heights: Column) -> Column:
    """Character height for fields of these heights: floored mean within 16..48, times 0.8."""
    total = F.aggregate(heights, F.lit(0).cast("long"), lambda acc, h: acc + h)
    return F.when(F.size(heights) == 0, F.lit(28.0)).otherwise(
        F.greatest(F.lit(16), F.least(F.floor(total / F.size(heights)), F.lit(48))) * 0.8
    )


def capacity(width: Column, height: Column, char_height: Column) -> tuple[Column, Column]:
    """(characters per line, lines) of a field."""
    across = F.greatest(F.lit(10), F.floor(char_height * 0.62))
    down = F.floor(char_height * 1.20)
    return F.floor(width / across), F.floor(height / down)


def fill_plan(fields: DataFrame, words: Column, n_words: int, fills: int, key: str, seed: int = 42) -> DataFrame:
    """Text per field and fill: 1 up to its budget of dictionary words, chosen by hash.

    fields: key, field_id, width.
    """
    rows = fields.withColumn("_bank", words).withColumn("fill_index", F.explode(F.sequence(F.lit(0), F.lit(fills - 1))))
    seed_text = seeded(seed, key, "field_id", "fill_index")

    def text(at: Column, bank: Column) -> Column:
        n = hash_number(F.concat(at, F.lit(":n"))) % word_budget(F.col("width")) + 1
        picks = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: hash_pick(bank, F.lit(n_words), F.concat(at, F.lit(":"), i.cast("string"))))
        return F.array_join(picks, " ")

    filled = bind(F.col("_bank"), lambda bank: bind(seed_text, lambda at: text(at, bank)))
    return rows.withColumn("text", filled).drop("_bank")


def fill_line(width: Column, words: Column, n_words: int, key: Column) -> Column:
    """Words chosen by hash, each followed by a blank, up to the first that no longer fits."""

    def line(bank: Column, at: Column) -> Column:
        tries = F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), width.cast("int"))),
            lambda i: hash_pick(bank, F.lit(n_words), F.concat(at, F.lit(":"), i.cast("string"))),
        )
        start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

        def step(acc: Column, w: Column) -> Column:
            fits = acc["open"] & (F.length(acc["text"]) + F.length(w) + 1 <= width)
            return F.struct(F.when(fits, F.concat(acc["text"], w, F.lit(" "))).otherwise(acc["text"]).alias("text"), fits.alias("open"))

        return F.aggregate(tries, start, step, lambda acc: acc["text"])

    return F.when(width > 0, bind(words, lambda bank: bind(key, lambda at: line(bank, at))))


# ---- progress ---------------------------------------------------------------------------------------


def cache_summary(entries: DataFrame) -> DataFrame:
    """Images seen, processed and reused, total and average words (columns reused, n_words)."""
    words = F.sum("n_words")
    return entries.agg(
        F.count("*").alias("images_seen"), F.count_if(~F.col("reused")).alias("processed"), F.count_if("reused").alias("reused"),
        words.alias("total_words"), F.round(words / F.greatest(F.count("*"), F.lit(1)), 4).alias("average_words"),
    )


def cache_examples(entries: DataFrame, key: str, n: int = 10, words: int = 12) -> DataFrame:
    return entries.orderBy(key).limit(n).select(key, F.slice("words", 1, words).alias("words"))


def split_progress(templates: DataFrame) -> DataFrame:
    """Ready, processed and pending templates per split and, with null split, in total."""
    return templates.rollup("split").agg(
        F.count("*").alias("templates"), F.count_if("ready").alias("ready"), F.count_if("processed").alias("processed"),
        F.count_if(~F.col("processed")).alias("pending"),
    )


def corruption_totals(docs: DataFrame) -> DataFrame:
    """Words and corrupted words over all documents, and their ratio."""
    return docs.agg(
        F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.sum("n_corrupted").alias("corrupted"),
        F.round(F.sum("n_corrupted") / F.greatest(F.sum("n_words"), F.lit(1)), 6).alias("rate"),
    )

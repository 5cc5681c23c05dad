"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents, in hash order, form one stream of words, cut into blocks of
equal length. The schedule gives each source an interval of the van der Corput grid as
long as its number of blocks; a grid point's bit-reversed number is its place in the
mix, so any stretch of the mix holds the sources in nearly their target shares. A
source's slots, ranked by place, take its blocks in turn, and its stream starts anew
when it is used up.

Null sources are a source of their own, last in order. Null and empty texts have no
words and are never taken. Rows that repeat a doc_id are separate documents; a null
doc_id is hashed as empty text. An empty table gives an empty mix.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import packed, prefix_sum, word_total
from formlake.operators.skew import global_rank, group_rank
from formlake.session import cut

BLOCK_WORDS = 1024
MOST_REPEATS = 3
CHUNK = 4096


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_no, source, source_size, target, words) from one row per document (source, size).

    Weights 1, 2, 3 repeat in code point order of the sources and share all words; a
    target above three times its source's size stops there and the rest is shared
    anew. The driver only sees sums.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(found, [F.col("source").asc_nulls_last()], "source_no")
    sources = cut(ranked.withColumn("weight", (F.col("source_no") - 1) % 3 + 1))
    words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (words / weights if words else 0.0), -1
    most = F.lit(MOST_REPEATS) * F.col("source_size")
    while True:
        above = F.col("weight") * F.lit(level) > most
        full, heavy, n = sources.agg(F.sum(F.when(above, most)), F.sum(F.when(above, F.col("weight"))), F.count_if(above)).first()
        if n == capped or not words:
            break
        capped, level = n, (words - (full or 0)) / (weights - (heavy or 0))
    target = F.when(above, most.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.select("source_no", "source", "source_size", target.alias("target"), F.floor(target).cast("long").alias("words"))


def slots(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(source_no, block, place): which source's which block stands at each place of the mix."""
    counted = targets.select("source_no", F.ceil(F.col("words") / block).cast("long").alias("blocks"))
    placed = cut(prefix_sum(counted, [], [F.col("source_no")], "blocks", "first"))
    total = placed.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, ceil(log2(max(2, total))))
    chunks = placed.filter("blocks > 0").select(
        "source_no", "first", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / CHUNK))).alias("chunk")
    ).repartition("source_no", "chunk")
    low = F.col("chunk") * CHUNK
    high = F.least(low + CHUNK, F.col("blocks")) - 1
    points = chunks.select("source_no", "first", F.explode(F.sequence(low, high)).alias("k")).withColumn("point", F.col("first") + F.col("k"))
    place = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    ranked = group_rank(points.select("source_no", place.alias("place")), ["source_no"], [F.col("place")], "rank")
    return ranked.select("source_no", (F.col("rank") - 1).cast("long").alias("block"), "place")


def streams(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Every document with its source's figures and `start`, the words before it in its source's stream.

    `docs` has doc_id, source, size and any key columns. The order is that of the md5
    of doc_id; hash ranges of a source, as many as its documents need, keep a hot
    source in many partitions.
    """
    of = targets.withColumnRenamed("source", "_source")
    placed = docs.join(of, docs["source"].eqNullSafe(of["_source"])).drop("_source")
    hashed = placed.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col("_h"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    return prefix_sum(hashed, ["source_no"], order, "size", "start").drop("_h")


def pieces(placed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Parts of documents in blocks: (source_no, start, block, pass, from, to), words of the document."""
    used = placed.filter((F.col("size") > 0) & (F.col("start") < F.col("words")))
    last = F.floor((F.col("words") - F.col("start") - 1) / F.col("source_size")).cast("long")
    rounds = F.sequence(F.lit(0).cast("long"), last)
    turns = used.select("*", F.explode(rounds).alias("pass"))
    turns = turns.withColumn("_a", F.col("pass") * F.col("source_size") + F.col("start"))
    turns = turns.withColumn("_z", F.least(F.col("_a") + F.col("size"), F.col("words")))
    number = lambda c: F.floor(c / block).cast("long")
    parts = turns.select("*", F.explode(F.sequence(number(F.col("_a")), number(F.col("_z") - 1))).alias("block"))
    begin, end = F.greatest(F.col("_a"), F.col("block") * block), F.least(F.col("_z"), (F.col("block") + 1) * block)
    return parts.withColumn("from", begin - F.col("_a")).withColumn("to", end - F.col("_a")).drop("_a", "_z")


def mix(placed: DataFrame, targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix: one row per part of a document, with `place`, its slot, and `from`, `to`, its words."""
    return pieces(placed, block).join(slots(targets, block), ["source_no", "block"])


def document_shares(docs: DataFrame, text: str = "text", block: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    sized = cut(docs.select("doc_id", "source", word_total(text).alias("size")))
    targets = cut(source_targets(sized))
    placed = cut(streams(sized, targets))
    taken = mix(placed, targets, block).groupBy("source_no", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    own = taken.withColumnRenamed("source_no", "_no").withColumnRenamed("start", "_start")
    same = (placed["source_no"] == own["_no"]) & (placed["start"] == own["_start"]) & (placed["size"] > 0)
    return placed.join(own, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The documents of the mix, with the columns of `docs`: a document once for each pass that takes
    words of it. Where the target ends inside a document, its text ends there too; n_chars follows."""
    rows = cut(packed(docs).select("_doc", F.monotonically_increasing_id().alias("_row"), word_total("_doc.text").alias("size")))
    sized = rows.select("_row", "_doc.doc_id", "_doc.source", "size")
    targets = cut(source_targets(sized))
    placed = cut(streams(sized, targets))
    turns = mix(placed, targets, block).groupBy("_row", "pass").agg(F.sum(F.col("to") - F.col("from")).alias("taken")).drop("pass")
    words = F.regexp_extract_all(F.col("_doc.text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), " ")
    whole = F.col("taken") >= F.col("size")
    new = {"text": F.when(whole, F.col("_doc.text")).otherwise(part)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("_doc.n_chars")).otherwise(F.length(part)).cast(dict(docs.dtypes)["n_chars"])
    return rows.join(turns, "_row").select(*(new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))

"""URL filters over time: every capture against the list entries in force when it was fetched.

A list is a log of dated entries (list, kind, pattern, action, listed_at). An entry holds
until the next one of its list, kind and pattern, so the log becomes validity intervals;
`remove` ends a rule without a new one. Kinds are `host` (the host itself), `domain` (the
host or any host below it) and `prefix` (host and leading path segments). A capture is
joined to the patterns it falls under, in the months its interval spans, and the entry
in force at its fetch time is kept (an as-of join); month keys bound what meets, and a
hot host is spread over months and, beyond, is a skewed join. The most specific pattern
decides: a longer prefix before a shorter one, any prefix before the host, the host before
its domains; `block` before `allow` when two lists agree in pattern.

Hosts and patterns are compared in lower case without a last dot; paths as they are.
URLs without a host, null URLs and captures without a time match nothing and are kept.
Entries without a pattern, action or date are void; of entries of one list, kind, pattern
and date the strongest holds (block, allow, remove). Captures that repeat are separate
rows. An empty list keeps all captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRENGTH = {"remove": 0, "allow": 1, "block": 2}
FAR = "9999-12-31"
RESULT = ("host", "kept", "rule_list", "rule_kind", "rule_pattern", "rule_action", "rule_listed_at")


def host_of(url: Column) -> Column:
    """Host in lower case without user, port or last dot; empty if there is none."""
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(found), r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, action, listed_at, ends_at): the rules and when they hold; `ends_at` is exclusive."""
    strength = F.element_at(F.create_map(*(F.lit(x) for pair in STRENGTH.items() for x in pair)), F.col("action"))
    fine = F.col("action").isin(*STRENGTH) & F.col("pattern").isNotNull() & F.col("listed_at").isNotNull()
    host, rest = F.split_part("pattern", F.lit("/"), F.lit(1)), F.regexp_extract("pattern", r"^[^/]*(/.*)$", 1)
    clean = F.concat(F.regexp_replace(F.lower(host), r"\.+$", ""), F.when(F.col("kind") == "prefix", F.regexp_replace(rest, "/+$", "")).otherwise(F.lit("")))
    log = entries.filter(fine).select("list", "kind", clean.alias("pattern"), "listed_at", F.struct(strength.alias("rank"), "action").alias("a"))
    log = log.groupBy("list", "kind", "pattern", "listed_at").agg(F.max("a").alias("a"))
    following = Window.partitionBy("list", "kind", "pattern").orderBy("listed_at")
    ends = F.coalesce(F.lead("listed_at").over(following), F.lit(FAR).cast("timestamp"))
    rules = log.withColumn("ends_at", ends).filter("a.action <> 'remove'")
    return rules.select("list", "kind", "pattern", "a.action", F.col("a.rank").alias("strength"), "listed_at", "ends_at")


def month(time: Column) -> Column:
    return F.year(time) * 12 + F.month(time) - 1


def keys(host: Column, path: Column, depth: int) -> Column:
    """Patterns that a capture falls under: (kind, pattern), prefixes to the given number of segments."""
    labels, segments = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    some = F.sequence(F.lit(1), F.size(labels))
    domains = F.transform(some, lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    deep = F.sequence(F.lit(0), F.least(F.size(segments), F.lit(depth)))
    prefixes = F.transform(
        deep, lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", F.array(host), F.slice(segments, 1, i)).alias("pattern"))
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host != "", F.concat(own, domains, prefixes))


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """`captures` (url string, fetched_at timestamp, further columns) with host, kept, and the deciding rule:
    list, kind, pattern, action, listed_at (null if none). A capture's own columns of these names come back as `capture_<name>`."""
    rules = intervals(entries)
    limits = rules.agg(F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)).alias("depth")).first()
    times = captures.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    carried = captures.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("row"))
    host, path = host_of(F.col("_doc.url")), path_of(F.col("_doc.url"))
    rows = carried.withColumn("host", host).withColumn("keys", keys(F.col("host"), path, limits["depth"] or 0))
    asked = rows.select("_doc", "row", "host", F.posexplode_outer("keys").alias("at_key", "key"))
    once = F.when(F.coalesce("at_key", F.lit(0)) == 0, F.col("_doc"))  # a capture travels with its first pattern alone
    asked = asked.select(once.alias("_doc"), "row", "host", "key.*", F.col("_doc.fetched_at").alias("at")).withColumn("month", month(F.col("at")))
    low, high = F.lit(times[0]).cast("timestamp"), F.lit(times[1]).cast("timestamp")
    months = F.sequence(month(F.greatest("listed_at", low)), month(F.least("ends_at", high)))
    active = rules.filter((F.col("listed_at") <= high) & (F.col("ends_at") > low)).withColumn("month", F.explode(months))
    met = asked.join(active, ["kind", "pattern", "month"], "left")
    holds = (F.col("listed_at") <= F.col("at")) & (F.col("at") < F.col("ends_at"))
    order = F.when(F.col("kind") == "prefix", 2).when(F.col("kind") == "host", 1).otherwise(0)
    rule = F.struct(order.alias("order"), F.length("pattern").alias("length"), "strength", "action", "kind", "pattern", "list", "listed_at")
    best = met.groupBy("row").agg(F.first("_doc", ignorenulls=True).alias("_doc"), F.first("host").alias("host"), F.max(F.when(holds, rule)).alias("rule"))
    kept = F.coalesce(F.col("rule.action") != "block", F.lit(True))
    return best.select(
        *(F.col(f"_doc.`{c}`").alias(f"capture_{c}" if c in RESULT else c) for c in captures.columns), "host", kept.alias("kept"),
        F.col("rule.list").alias("rule_list"), F.col("rule.kind").alias("rule_kind"), F.col("rule.pattern").alias("rule_pattern"),
        F.col("rule.action").alias("rule_action"), F.col("rule.listed_at").alias("rule_listed_at"),
    )

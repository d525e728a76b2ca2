"""URL filters by a sort-merge range join. Native: DataFrame functions only.

A host in reversed order, every label closed by a dot (``com.example.www.``), is its canonical key. All hosts under
``example.com`` share the prefix ``com.example.``, so a rule's host is an interval of the sorted keys, and two intervals
are nested or apart. A sweep over rules and urls in key order meets, for each url, the last rule interval that
began; that interval and those around it are the stack of active rules, from which the ended ones are popped. A
rule's path is an interval of the sorted paths of its host in the same way, swept a second time.

Long stacks do not arise: a host has at most as many nested rule hosts as labels. Within one rule host, the stack holds
path rules that are prefixes of each other. A hot host or path is split between ranges, since ranges are cut on
(key, path, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import last_marker

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``: a parent domain's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """Judge every url: columns ``id_col, host, path, rule, verdict``, one row per input row.

    ``rules`` has host, path, verdict; rows with a null or empty host, a null path or verdict are ignored, and of rules
    for the same host and path a block wins. A rule fits its host and all subdomains if the url's path starts with the
    rule's path; the longest rule (host and path together, then host) wins. Without a fitting rule, also for a
    null url or one without ``://``, the verdict is ``default`` and rule is null. Repeated rows and null ids are kept;
    other columns of ``pages`` are not read.
    """
    rules = rules.filter("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict",
    ).groupBy("rule_host", "rule_path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))
    urls = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))

    # first sweep: hosts. Every url takes the stack of rule hosts around it
    hosts = _with_stack(rules.select(host_key(F.col("rule_host")).alias("key")).distinct(), [], "key")
    events = hosts.select("key", F.lit("").alias("path"), F.lit(0).alias("is_url"), F.lit(None).cast("bigint").alias("id"),
                          F.lit(None).cast("string").alias("host"), "stack").unionByName(
        urls.select("key", "path", F.lit(1).alias("is_url"), "id", "host"), allowMissingColumns=True)
    order = [F.col("key"), F.col("is_url"), F.col("path"), F.col("id")]
    swept = last_marker(events, order, F.col("stack")).filter("is_url = 1")
    active = F.filter(F.coalesce("last_marker", F.array().cast("array<string>")), lambda k: F.startswith("key", k))
    swept = swept.select("id", "host", "path", F.explode_outer(active).alias("rule_key"), "key")

    # second sweep: paths within each active rule host
    named = rules.select(host_key(F.col("rule_host")).alias("rule_key"), "rule_path", F.struct(
        F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("size"), "verdict").alias("payload"))
    stacks = _with_stack(named, ["rule_key"], "rule_path", "payload")
    events = stacks.select("rule_key", F.col("rule_path").alias("path"), F.lit(0).alias("is_url"), "stack").unionByName(
        swept.select("rule_key", "path", F.lit(1).alias("is_url"), "id", "host", "key"), allowMissingColumns=True)
    order = [F.col("rule_key"), F.col("path"), F.col("is_url"), F.col("key"), F.col("id")]
    marker = F.when(F.col("is_url") == 0, F.struct("rule_key", "stack"))
    swept = last_marker(events, order, marker).filter("is_url = 1")
    fitting = F.filter("last_marker.stack", lambda r: F.startswith("path", r["prefix"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(
        F.length(r["payload"]["rule"]).alias("n"), r["payload"]["size"].alias("h"), r["payload"]["rule"].alias("rule"),
        r["payload"]["verdict"].alias("verdict"))))
    swept = swept.withColumn("best", F.when(F.col("last_marker.rule_key") == F.col("rule_key"), best))

    # a url met once per active rule host; equal rows are told apart by how often each combination came
    per_url = swept.groupBy("id", "host", "path", F.coalesce("rule_key", F.lit("")).alias("rule_key")).agg(
        F.max("best").alias("best"), F.count("*").alias("times"))
    per_url = per_url.groupBy("id", "host", "path").agg(F.max("best").alias("best"), F.max("times").alias("times"))
    copies = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return per_url.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"), copies.alias("_copy")).drop("_copy")


def _with_stack(rules: DataFrame, group: list[str], key: str, payload: str | None = None) -> DataFrame:
    """Rules with the stack of the rules around them, themselves included: every prefix of the key that is a rule.

    Prefixes of a host key end at a dot, those of a path at any character, so a rule asks for its own prefixes by
    an equi-join and the rules alone are expanded, never the urls.
    """
    if payload is None:
        # com.example.www. -> com., com.example., com.example.www.
        labels = F.split(F.expr(f"substring({key}, 1, length({key}) - 1)"), r"\.")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
            F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    else:
        prefixes = F.transform(F.sequence(F.lit(0), F.length(key)), lambda i: F.substring(F.col(key), F.lit(1), i))
    asked = rules.select(*group, key, F.explode(prefixes).alias("prefix"))
    known = rules.select(*group, F.col(key).alias("prefix"), *([payload] if payload else []))
    kept = F.struct("prefix", payload) if payload else F.col("prefix")
    return asked.join(known, [*group, "prefix"]).groupBy(*group, key).agg(F.array_sort(F.collect_list(kept)).alias("stack"))

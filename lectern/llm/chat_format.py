"""Chat formatting by quotation linking. Native: DataFrame functions only.

A message may quote earlier ones with ``>`` marks, nested to any level. Quoted passages are hashed after normalisation
and joined to the passages that messages of the same conversation wrote themselves; the earlier message that
supplies most of the quoted text is the one answered. Conversations come back in reply order, without quotes.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import last_marker, stored

MARKS = r"^(?:[ \t]*>)+"


def normalised(text: Column) -> Column:
    """Lower case, runs of characters other than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """Every line and every paragraph of every message with its quote level (0: the writer's own), as a hash.

    A paragraph is a run of lines of one level without blank lines; a paragraph of one line is that line, counted once.
    Columns ``mid, conv_id, turn, level, digest, size``. Lines become rows, which are brought together by message.
    """
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[ \t]", "")).alias("level"),
        normalised(F.regexp_replace(x, MARKS, "")).alias("body")))
    # number the paragraphs of a message: a blank line or another level starts a new one
    rows = messages.select("mid", "conv_id", "turn", F.posexplode(line).alias("pos", "line")).select(
        "mid", "conv_id", "turn", "pos", "line.level", "line.body")
    by_message = Window.partitionBy("mid").orderBy("pos")
    starts = F.coalesce((F.lag("level").over(by_message) != F.col("level")) | (F.lag("body").over(by_message) == ""), F.lit(True))
    rows = rows.withColumn("starts", starts.cast("int")).withColumn("paragraph", F.sum("starts").over(by_message)).filter("body <> ''")
    whole = rows.groupBy("mid", "conv_id", "turn", "level", "paragraph").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), " ").alias("body"),
        F.count("*").alias("n")).filter("n > 1")
    return rows.select("mid", "conv_id", "turn", "level", "body").unionByName(
        whole.select("mid", "conv_id", "turn", "level", "body")).select(
        "mid", "conv_id", "turn", "level", F.md5("body").alias("digest"), F.length("body").alias("size"))


def path_key(turn: str) -> Column:
    """A turn number as text of one length that sorts like the number, also below 0: the distance from the least 64-bit number."""
    return F.lpad((F.col(turn).cast("decimal(20,0)") + F.lit(Decimal(2 ** 63))).cast("string"), 20, "0")


def body(text: Column) -> Column:
    """A message without its quoted lines, trimmed of blank lines at both ends."""
    own = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(x.rlike(MARKS), F.lit(False)))
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def link_quotations(conversations: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, reply_to, n_quoted, n_linked, reply_path, body``.

    ``n_quoted`` counts distinct quoted lines and paragraphs, ``n_linked`` those found in an earlier turn of the
    conversation at level 0 (a quote inside a quote links to the one who wrote it). ``reply_to`` is the earlier turn that
    wrote most quoted characters of the lowest level with a link, the latest of equals; a message without such a link answers the nearest earlier turn
    (null for the first). ``reply_path`` sorts a conversation into reply order: a message that quotes comes right after
    the one it answers, followed by those that continue it. A null text is empty; rows with null conv_id or turn link with nothing
    and have a null path; repeated rows stay, each with the same result. Extra columns are not read.
    """
    clean = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.withColumn("mid", F.xxhash64("conv_id", "turn", "role", "text"))
    found = stored(passages(clean.filter("text LIKE '%>%'").dropDuplicates(["mid"])).filter("level > 0"), "quoted")
    quoted = found.groupBy("mid", "conv_id", "turn", "digest", "size").agg(F.min("level").alias("level"))
    asked = quoted.select("conv_id", "digest").distinct()
    # only conversations that quote are parsed for originals
    quoting = clean.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").dropDuplicates(["mid"])
    written = passages(quoting).filter("level = 0").join(asked, ["conv_id", "digest"], "left_semi").select(
        "conv_id", "digest", F.col("turn").alias("by")).distinct()
    hits = quoted.join(written, ["conv_id", "digest"]).filter("by < turn")
    # deeper levels are what the answered message quoted itself: the lowest level that is found decides
    target = hits.groupBy("mid", "level", "by").agg(F.sum("size").alias("size")).groupBy("mid").agg(
        F.max(F.struct((-F.col("level")).alias("above"), "size", "by"))["by"].alias("linked"))
    counts = quoted.groupBy("mid").agg(F.count("*").alias("n_quoted")).join(
        hits.groupBy("mid").agg(F.countDistinct("digest").alias("n_linked")), "mid", "left").join(target, "mid", "left")

    # turns of the conversation: which one came before, and which answer took another direction
    turns = clean.filter("conv_id IS NOT NULL AND turn IS NOT NULL").join(counts, "mid", "left").groupBy("conv_id", "turn").agg(
        F.max("linked").alias("linked"))
    order = [F.col("conv_id"), F.col("turn"), F.col("kind")]
    # each turn leaves a marker behind itself: a row that asks comes before it in the order
    both = turns.withColumn("kind", F.lit(0)).unionByName(turns.withColumn("kind", F.lit(1)))
    before = last_marker(both, order, F.when(F.col("kind") == 1, F.struct("conv_id", "turn"))).filter("kind = 0").select(
        "conv_id", "turn", "linked", F.when(F.col("last_marker.conv_id") == F.col("conv_id"), F.col("last_marker.turn")).alias("previous"))
    before = before.withColumn("turned", F.col("linked").isNotNull() & ~F.col("linked").eqNullSafe(F.col("previous")))
    # a segment is a turn that leads elsewhere and those that continue it; 'head' is null before the first such turn
    swept = last_marker(before, order[:2], F.when(F.col("turned"), F.struct("conv_id", "turn")))
    placed = stored(swept.select("conv_id", "turn", "linked", "previous", "turned", F.when(
        F.col("last_marker.conv_id") == F.col("conv_id"), F.col("last_marker.turn")).alias("head")), "turns")

    prefixes = _prefixes(placed)
    own = path_key("turn")
    paths = placed.join(prefixes, ["conv_id", "head"], "left").select(
        "conv_id", "turn", F.coalesce("linked", "previous").alias("reply_to"), F.concat_ws(".", "prefix", own).alias("reply_path"))
    return clean.join(counts.select("mid", "n_quoted", "n_linked"), "mid", "left").join(paths, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_path", body(F.col("text")).alias("body"))


def _prefixes(placed: DataFrame) -> DataFrame:
    """The path that each segment hangs under. Segments whose parent hangs nowhere come first, then those below them, one
    round per nesting level of quotations; without quotations there is no round."""
    heads = placed.filter("turned").select("conv_id", F.col("turn").alias("head"), "linked")
    parents = placed.select("conv_id", F.col("turn").alias("linked"), F.col("head").alias("parent"))
    links = stored(heads.join(parents, ["conv_id", "linked"]), "links")
    own = path_key("linked")
    frontier = stored(links.filter("parent IS NULL").select("conv_id", "head", own.alias("prefix")), "frontier")
    done = frontier
    while not frontier.isEmpty():
        above = frontier.select("conv_id", F.col("head").alias("parent"), F.col("prefix").alias("above"))
        frontier = stored(links.join(above, ["conv_id", "parent"]).select(
            "conv_id", "head", F.concat_ws(".", "above", own).alias("prefix")), "frontier")
        done = done.unionByName(frontier)
    return done

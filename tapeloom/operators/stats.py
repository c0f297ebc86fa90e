"""Reports of a collection: artists, formats, completeness, tokens, and how well extraction agrees with the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.source import detect
from ..functions.text import filled

UNKNOWN = "(unknown)"
MIC_LIKE = r"\b[a-z]{2,12}[ -]?(?:km|mk|cmc|ccm|mkh|tlm|c|u|h)?[ -]?\d{1,4}[a-z]?\b"


def artist_report(shows: DataFrame, files: DataFrame, top: int | None = None) -> DataFrame:
    """``artist, shows, tracks, first_date, last_date, formats``; formats: the three most frequent, `flac:12, mp3:3`.

    `shows(show, artist, date)`, `files(show, ext, n)`. Sums are taken per show before anything is joined, so a hot artist
    costs one row per show at most; the format lists have as many rows as formats.
    """
    s = shows.select("show", F.coalesce(filled(F.col("artist")), F.lit(UNKNOWN)).alias("artist"), filled(F.col("date")).alias("date"))
    f = files.groupBy("show", "ext").agg(F.sum("n").alias("n"))
    x = s.join(f, "show", "left").groupBy("artist", "ext").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("artist").orderBy(F.desc("n"), "ext")
    best = x.where("ext is not null").withColumn("r", F.row_number().over(w)).where("r <= 3")
    fmt = best.groupBy("artist").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "ext", "n"))), lambda e: F.concat(e["ext"], F.lit(":"), e["n"].cast("string"))), ", ").alias("formats"))
    n = x.groupBy("artist").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("tracks"))
    out = s.groupBy("artist").agg(F.count(F.lit(1)).alias("shows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    out = out.join(n, "artist", "left").join(fmt, "artist", "left").select("artist", "shows", "tracks", "first_date", "last_date", F.coalesce("formats", F.lit("")).alias("formats"))
    return out if top is None else out.orderBy(F.desc("shows"), "artist").limit(top)


def format_mix(files: DataFrame) -> DataFrame:
    """``ext, n, permille``: files by format and their share in whole thousandths."""
    x = files.groupBy("ext").agg(F.sum("n").cast("bigint").alias("n"))
    return x.withColumn("permille", F.floor(F.col("n") * 1000 / F.sum("n").over(Window.partitionBy())).cast("bigint"))  # one row per format


def health(shows: DataFrame) -> DataFrame:
    """One row: shows, without artist, without date, with low confidence, without setlist; distinct artists; mean confidence."""
    return shows.agg(
        F.count(F.lit(1)).alias("shows"), F.count_if(filled(F.col("artist")).isNull()).alias("no_artist"), F.count_if(filled(F.col("date")).isNull()).alias("no_date"),
        F.count_if(F.col("confidence") < 0.5).alias("low_confidence"), F.count_if(F.col("tracks") == 0).alias("no_setlist"), F.countDistinct(filled(F.col("artist"))).alias("artists"),
        F.floor(F.avg(F.round(F.col("confidence") * 100)) * 100).cast("bigint").alias("mean_confidence_bp"),
    )


def top_tokens(texts: DataFrame, col: str = "text", top: int = 50, pattern: str = r"[a-z]{4,}") -> DataFrame:
    """``token, n, docs``: the most frequent tokens; ties by the alphabet. Counted per document first."""
    t = texts.where(F.col(col).isNotNull()).select(F.explode(F.regexp_extract_all(F.lower(F.col(col)), F.lit(f"({pattern})"), F.lit(1))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(top)


def fold(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def agrees(a: Column, b: Column) -> Column:
    """Equal when folded, one within the other, or three quarters of the larger word set shared."""
    x, y = fold(a), fold(b)
    p, q = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    share = F.size(F.array_intersect(p, q)) * 4 >= F.greatest(F.size(p), F.size(q)) * 3
    return F.coalesce((x != "") & (y != "") & ((x == y) | x.contains(y) | y.contains(x) | share), F.lit(False))


def match_rates(found: DataFrame, truth: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``field, total, filled, matched``: of the records both have."""
    j = found.select(key, *[F.col(f).alias(f"f_{f}") for f in fields]).join(truth.select(key, *[F.col(f).alias(f"t_{f}") for f in fields]), key)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), filled(F.col(f"f_{f}")).isNotNull().alias("has"), agrees(F.col(f"f_{f}"), F.col(f"t_{f}")).alias("ok")) for f in fields])
    return j.select(F.inline(rows)).groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count_if("has").alias("filled"), F.count_if("ok").alias("matched"))


def issue_counts(shows: DataFrame, col: str = "issues") -> DataFrame:
    """``issue, n``: by the text before a colon."""
    return shows.select(F.explode(col).alias("i")).groupBy(F.substring_index("i", ":", 1).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


def top_values(rows: DataFrame, col: str, top: int = 30) -> DataFrame:
    """``value, n``: the most frequent filled values; ties by the alphabet."""
    return rows.select(filled(F.col(col)).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def missing_by_parent(shows: DataFrame, field: str = "artist", parent: str = "parent") -> DataFrame:
    """``parent, n``: how many shows of each directory lack the field."""
    return shows.where(filled(F.col(field)).isNull()).groupBy(parent).agg(F.count(F.lit(1)).alias("n"))


def mine_mics(texts: DataFrame, col: str = "body", top: int = 50) -> DataFrame:
    """``token, n, known``: what notes call microphones (a word, then a model number), and whether the table of microphones knows
    it: candidates for the table. The most frequent, ties by the alphabet."""
    t = texts.where(F.col(col).isNotNull()).select(F.explode(F.regexp_extract_all(F.lower(F.col(col)), F.lit(MIC_LIKE), F.lit(0))).alias("token"))
    n = t.select(F.regexp_replace(F.trim("token"), r"\s+", " ").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    known = F.size(detect(F.col("token"))["mics"]) > 0
    return n.orderBy(F.desc("n"), "token").limit(top).withColumn("known", known)


def source_kinds(texts: DataFrame, col: str = "body") -> DataFrame:
    """``kind, n``: texts by the kind of source that they tell; null for none."""
    return texts.where(F.col(col).isNotNull()).groupBy(detect(F.col(col))["kind"].alias("kind")).agg(F.count(F.lit(1)).alias("n"))

"""Notes as bytes to text, and the JSON tables a collection is kept in."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
#: Names of notes, and of text files that are none.
NOTES_NAME = r"(?i)info|notes?|readme|setlist"
NO_NOTES = r"(?i)(?:ffp|md5|sha1|checksum|spectral|spek)\.txt$"
TRACK = "struct<number:int,title:string,disc:int,disc_total:int>"
SHOW = f"folder string, artist string, date string, venue string, city string, region string, source struct<kind:string,mics:array<string>,taper:string>, tracks array<{TRACK}>, audio_files array<string>, issues array<string>"
ENTRY = "struct<scanned_at:string,fingerprint:string,folder_mtime:double,audio_signature:string,tagging:struct<mode:string,applied_at:string,applied:int,failed:int,skipped:int,copy_to:string>>"
#: Groups of RTF that hold no text.
RTF_TABLES = "fonttbl|colortbl|stylesheet|listtable|listoverridetable|rsidtbl|generator|info|filetbl|pict|themedata|datastore|latentstyles|xmlnstbl|revtbl|fldrslt|bkmkstart|bkmkend"


def plain_of_rtf(s: str) -> str:
    """Text of RTF: tables out, paragraph marks as line ends, escaped characters read, control words and braces out."""
    s = re.sub(rf"\{{\\(?:\*\\)?(?:{RTF_TABLES})\b[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}}", "", s)

    def one(m: re.Match) -> str:
        if m["line"]:
            return "\n"
        if m["uni"]:
            return chr(int(m["uni"]) % 65536)
        if m["hex"]:
            return bytes([int(m["hex"], 16)]).decode("cp1252", errors="replace")
        return ""

    s = re.sub(r"\\(?P<line>par|line|pard)\b\s?|\\u(?P<uni>-?\d+)\??|\\'(?P<hex>[0-9a-fA-F]{2})|\\[a-zA-Z]+-?\d*\s?|\\[^a-zA-Z]|[{}]", one, s)
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def decode(raw: bytes | None) -> str:
    """Text of a notes file: by byte order mark, else UTF-16 where every other byte is mostly zero, else UTF-8, else
    Windows-1252, else Latin-1; RTF is unwrapped. Null or no bytes give an empty text."""
    if not raw:
        return ""
    raw = bytes(raw)
    marks = ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8-sig"))
    codec = next((c for m, c in marks if raw.startswith(m)), None)
    if codec is None and len(raw) >= 4:
        head = raw[:1024]
        half, even, odd = len(head) // 2, head[0::2].count(0), head[1::2].count(0)
        codec = "utf-16-le" if odd > 0.3 * half and odd > even else "utf-16-be" if even > 0.3 * half and even > odd else None
    text = raw.decode(codec, errors="replace") if codec else None
    if text is None:
        for c in ("utf-8", "cp1252", "latin-1"):
            try:
                text = raw.decode(c)
                break
            except UnicodeDecodeError:
                continue
    return plain_of_rtf(text) if text.lstrip().startswith("{\\rtf") else text


def read_notes(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """``path, body`` of the files below `path`, decoded in Arrow batches. Larger ones than `most_bytes`, if given, aren't
    read: their body is null."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.pandas_udf(lambda s: pd.Series([decode(x) for x in s], dtype=object), "string")
    if most_bytes is None:
        return f.select("path", text("content").alias("body"))
    small, large = f.where(F.col("length") <= most_bytes), f.where(F.col("length") > most_bytes)
    return small.select("path", text("content").alias("body")).unionAll(large.select("path", F.lit(None).cast("string")))


def read_shows(spark: SparkSession, path: str) -> DataFrame:
    """Drafts: a JSON array of shows; unknown fields are ignored."""
    return spark.read.schema(SHOW).option("multiLine", "true").json(path)


def write_shows(shows: DataFrame, path: str) -> None:
    shows.write.mode("overwrite").json(path)


def _map_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """``folder, scanned_at, fingerprint, ...``: entries of a history file; another version or a broken file is empty."""
    h = _map_file(spark, path, f"schema int, entries map<string,{ENTRY}>").where(F.col("schema") == SCHEMA_VERSION)
    return h.select(F.explode("entries").alias("folder", "e")).select("folder", "e.*").where("fingerprint is not null")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``kind, name, cnt`` of a lexicon file; counts that are no number are dropped."""
    h = _map_file(spark, path, "schema int, artists map<string,string>, venues map<string,string>").where(F.col("schema") == SCHEMA_VERSION)
    both = h.select(F.explode(F.array(F.struct(F.lit("artist").alias("kind"), F.col("artists").alias("m")), F.struct(F.lit("venue").alias("kind"), F.col("venues").alias("m")))).alias("x"))
    return both.select("x.kind", F.explode("x.m").alias("name", "c")).select("kind", "name", F.col("c").try_cast("bigint").alias("cnt")).where("cnt is not null")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One record per identifier of a JSON-lines log, the first; broken lines and errors are dropped."""
    d = spark.read.schema("identifier string, creator string, date string, venue string, coverage string, source_field string, audio_count int, error string").json(path)
    d = d.where("identifier is not null and error is null").withColumn("at", F.monotonically_increasing_id())
    cols = [c for c in d.columns if c not in ("identifier", "error", "at")]
    return d.groupBy("identifier").agg(F.min_by(F.struct(*cols), "at").alias("x")).select("identifier", "x.*")


def best_notes(files: DataFrame, key: str = "identifier") -> DataFrame:
    """The notes file of each record: of its text files one named like notes first, then the largest, then by name. Checksum
    and spectrum files, and names that begin with an underscore, are none."""
    text = F.col("name").rlike(r"\.txt$") & ~F.col("name").startswith("_") & ~F.col("name").rlike(NO_NOTES)
    first = F.when(F.col("name").rlike(NOTES_NAME), 0).otherwise(1)
    return files.where(text).groupBy(key).agg(F.min_by("name", F.struct(first, -F.col("size"), "name")).alias("name"))

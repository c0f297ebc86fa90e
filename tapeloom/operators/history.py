"""Incremental runs: the last known state of each folder, what changed since, and the upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key by a total order: an aggregate with partial maxima, so a hot key is no single sort."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x")).select(key, "x.*")


def mode_matches(done: Column, failed: Column, mode: Column, done_to: Column | None = None, to: Column | None = None) -> Column:
    """Does an earlier run with no failures cover this mode: a dry run is covered by any real one, a copy by one to the same place."""
    same = F.lit(False) if to is None or done_to is None else F.coalesce(done_to == to, F.lit(False))
    ok = F.when(mode == "dry-run", done.isin("in-place", "copy-to")).when(mode == "in-place", done == "in-place").when(mode == "copy-to", (done == "copy-to") & same)
    return F.coalesce((failed == 0) & ok, F.lit(False))


def unchanged(now: DataFrame, known: DataFrame, key: str = "folder") -> DataFrame:
    """Rows of `now(key, mtime, fingerprint, signature)` that `known` has with the same mtime, fingerprint, or (where both
    have one) audio signature: ``key, reason``, the cheapest reason first."""
    k = known.select(key, F.col("mtime").alias("k_mtime"), F.col("fingerprint").alias("k_fp"), F.col("signature").alias("k_sig"))
    reason = F.when(F.col("mtime") == F.col("k_mtime"), "mtime").when(F.col("fingerprint") == F.col("k_fp"), "content").when(F.col("signature") == F.col("k_sig"), "audio")
    return now.join(k, key).select(key, reason.alias("reason")).where("reason is not null")


def skips(now: DataFrame, known: DataFrame, mode: str, to: str | None = None, rescan: bool = False, audio: bool = False, key: str = "folder") -> DataFrame:
    """``key, reason`` of the rows of `now(key, mtime, fingerprint, signature)` that this run may leave out.

    `known(key, mtime, fingerprint, signature, mode, failed, copy_to)`. An earlier run must cover the mode. Then an equal mtime is
    enough, or equal content, or (with `audio`) an equal audio signature. A rescan doesn't look at mtimes and leaves out only
    what has a signature on both sides. One equi-join; a folder that isn't known, or never was tagged, is not left out.
    """
    k = known.select(key, *[F.col(c).alias(f"k_{c}") for c in ("mtime", "fingerprint", "signature", "mode", "failed", "copy_to")])
    covered = mode_matches(F.col("k_mode"), F.col("k_failed"), F.lit(mode), F.col("k_copy_to"), None if to is None else F.lit(to))
    heard = F.col("signature").isNotNull() & F.col("k_signature").isNotNull()
    content = F.col("fingerprint") == F.col("k_fingerprint")
    same = F.when(content if not rescan else content & heard & F.lit(audio), "content").when((F.col("signature") == F.col("k_signature")) & F.lit(audio), "audio")
    reason = same if rescan else F.when(F.col("mtime") == F.col("k_mtime"), "mtime").otherwise(same)
    return now.join(k, key).where(covered).select(key, reason.alias("reason")).where("reason is not null")


def changed(now: DataFrame, known: DataFrame, key: str = "folder") -> DataFrame:
    """The rest: an anti-join before any content is read."""
    return now.join(unchanged(now, known, key), key, "left_anti")


def upsert(known: DataFrame, new: DataFrame, key: str = "folder", keep: tuple[str, ...] = ("signature",)) -> DataFrame:
    """New rows replace known ones; fields in `keep` stay where the new row has none. Both have one row per key."""
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in known.columns if c != key], F.lit(True).alias("_new"))
    j = known.join(n, key, "full_outer")
    pick = [F.when(F.col("_new"), F.coalesce(f"n_{c}", c) if c in keep else F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in known.columns if c != key]
    return j.select(key, *pick)

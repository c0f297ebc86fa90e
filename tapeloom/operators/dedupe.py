"""Duplicate folders by fingerprint: track i against track i, components, and which copy to keep."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_key, cut
from .graph import connected_components

SECONDS, SIMILAR, FRACTION = 7.0, 0.85, 0.8


def bit_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two arrays of unsigned 32-bit words over their common length; 0 without one."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    n = F.least(F.size(a), F.size(b))
    bits = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.cast("bigint").bitwiseXOR(y.cast("bigint")).bitwiseAND(mask))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.when(n > 0, 1 - bits / (n * 32.0)), F.lit(0.0))


def base64_similarity(a: Column, b: Column) -> Column:
    """The same over URL-safe base64 text, padded as needed, bytes over the common length; 0 for text that is none."""
    def raw(c: Column) -> Column:
        t = F.translate(c, "-_", "+/")
        return F.try_to_binary(F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4)))), F.lit("base64"))

    x, y = raw(a), raw(b)
    n = F.least(F.octet_length(x), F.octet_length(y))
    byte = lambda c, i: F.conv(F.hex(F.substring(c, i, 1)), 16, 10).cast("bigint")
    bits = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.bit_count(byte(x, i).bitwiseXOR(byte(y, i))))
    return F.coalesce(F.when(n > 0, 1 - bits / (n * 8.0)), F.lit(0.0))


def _packed(ds: Column, fps: Column) -> Column:
    """``n, ds, words, fps`` of a list: three whole numbers for each track where every track has six words (comparisons take the
    low 32 bits of a word), else the words as they are. Less than a half of what arrays of arrays take on disk."""
    word = lambda f, k: f[k].bitwiseAND(F.lit(0xFFFFFFFF))
    six = F.coalesce(F.forall(fps, lambda f: (F.size(f) == 6) & F.forall(f, lambda w: w.isNotNull())), F.lit(False))
    words = F.flatten(F.transform(fps, lambda f: F.array(*[word(f, 2 * k).bitwiseXOR(F.shiftleft(word(f, 2 * k + 1), 32)) for k in range(3)])))
    return F.struct(F.size(ds).alias("n"), ds.alias("ds"), F.when(six, words).alias("words"), F.when(~six, fps).alias("fps"))


def _unpacked(p: str) -> Column:
    """The words of each track, as an array of arrays, of a packed list."""
    word = lambda k: F.element_at(f"{p}.words", k)
    halves = lambda w: [w.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(w, 32)]
    rows = F.transform(F.sequence(F.lit(0), F.col(f"{p}.n") - 1), lambda i: F.array(*halves(word(3 * i + 1)), *halves(word(3 * i + 2)), *halves(word(3 * i + 3))))
    return F.when(F.col(f"{p}.words").isNull(), F.col(f"{p}.fps")).when(F.col(f"{p}.n") > 0, rows).otherwise(F.array().cast("array<array<bigint>>"))


#: Places of a block whose durations pairs meet by, and the largest of them told apart: they are exchanged as 32-bit numbers.
MOST_PLACES, MOST_SECONDS = 4, 1e6
#: Of which numbers of this size are this near.
ROUNDED = 3e-7
#: Pairs of rows that a task compares at a time.
STEP = 1 << 21


def _blocks(n: int, fraction: float) -> tuple[int, int]:
    """(places, number) of the blocks of lists of which the longer has `n` places: one more than places may differ."""
    spare = n - max(1, math.ceil(n * fraction))
    return min(n // (spare + 1), MOST_PLACES), spare + 1


def _asked(n: int, fraction: float) -> list[tuple[int, int]]:
    size, number = _blocks(n, fraction)
    return [(size, k) for k in range(number)]


def _indexed(n: int, fraction: float) -> list[tuple[int, int]]:
    """(places, block) of every longer list that one of `n` places may face, as far as its own places go."""
    out = set()
    for m in range(n, int(n / fraction) + 2):
        if math.ceil(m * fraction) <= n:
            out |= {(size, k) for size, k in _asked(m, fraction) if (k + 1) * size <= n}
    return sorted(out)


def _most_bits(similar: float) -> int:
    return max((k for k in range(193) if 1 - k / 192.0 >= similar), default=-1)


def _reach(seconds: float) -> tuple[float, float]:
    """(seconds between durations that meet, seconds of a cell), of which rounding takes no more than a third."""
    near = seconds * (1 + 1e-9)
    return near, max(2 * near, 1.0)


def _meet(df: pd.DataFrame, seconds: float, fraction: float, bits: int) -> Iterator[pd.DataFrame]:
    """Pairs of `rid` of the rows asked and indexed that share a block by durations, whose first tracks sound alike and whose
    lengths go together."""
    near, wide = _reach(seconds)
    cell = lambda d: np.floor(np.clip(d, -1e15, 1e15) / wide).astype(np.int64)
    mix = lambda h, c: (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(np.uint64)
    words = [f"w{k}" for k in range(2)]
    for size, part in df.groupby("size"):
        places = [f"d{k}" for k in range(1, size)]
        ask = part.asked.to_numpy()
        q, x = part[ask], part[~ask]
        qd, xd = (t[["d0", *places]].to_numpy(float) for t in (q, x))
        qw, xw = (t[words].to_numpy(np.int64) for t in (q, x))
        (qn, xn), (qr, xr), (qs, xs) = ((q[c].to_numpy(), x[c].to_numpy()) for c in ("n", "rid", "six"))
        first = lambda t: mix(mix(np.full(len(t), 1, np.uint64), t.block.to_numpy()), t.cell.to_numpy())
        xk, qk, row = first(x), first(q), np.arange(len(q))
        for k in range(1, size):
            xk = mix(xk, cell(xd[:, k]))
            far = near + ROUNDED * (np.abs(qd[row, k]) + near)
            lo, hi = cell(qd[row, k] - far), cell(qd[row, k] + far)
            reach = [np.nonzero(hi >= lo + o)[0] for o in range(3)]  # two cells, three by rounding
            qk, row = np.concatenate([mix(qk[r], lo[r] + o) for o, r in enumerate(reach)]), np.concatenate([row[r] for r in reach])
        order = np.argsort(xk, kind="stable")
        start, end = np.searchsorted(xk[order], qk, "left"), np.searchsorted(xk[order], qk, "right")
        some = end > start
        row, start, count = row[some], start[some], (end - start)[some]
        for at in range(0, int(count.sum()), STEP):
            ends = np.cumsum(count)
            p = np.arange(at, min(at + STEP, int(ends[-1])))
            i = np.searchsorted(ends, p, "right")
            i, j = row[i], order[start[i] + p - (ends - count)[i]]
            ok = (xn[j] <= qn[i]) & (xn[j] >= qn[i] * fraction) & ((xn[j] < qn[i]) | (xr[j] < qr[i]))
            i, j = i[ok], j[ok]
            ok = (np.abs(qd[i] - xd[j]) <= near + ROUNDED * (np.abs(qd[i]) + near)).all(1)
            i, j = i[ok], j[ok]
            ok = ~(qs[i] & xs[j]) | (np.bitwise_count((qw[i] ^ xw[j]).view(np.uint64)).sum(1, dtype=np.int64) <= bits)
            yield pd.DataFrame({"a": qr[i[ok]], "b": xr[j[ok]]}).drop_duplicates()


def candidates(r: DataFrame, seconds: float = SECONDS, similar: float = SIMILAR, fraction: float = FRACTION) -> DataFrame:
    """``a, b``: the pairs of lists to compare, of ``rid, n, ds array<double>, fps array<array<bigint>>``, or ``words`` besides.

    Of a longer list's n places few may differ, so of one more blocks of places than that one agrees whole: pairs meet by a block
    and its durations in cells, and only if its durations are near and its first tracks sound alike. Rows are exchanged by the
    block's first duration; the cells of the others are looked up within the task. Durations are rounded and a third of the sound
    is left out for that: what is met so is compared in full.
    """
    near, wide = _reach(seconds)
    if "words" not in r.columns:
        r = r.select("rid", _packed(F.col("ds"), F.col("fps")).alias("p")).select("rid", "p.*")
    kind = "array<struct<size:int,block:int>>"
    of = lambda f: F.pandas_udf(lambda s: s.map({n: [{"size": a, "block": b} for a, b in f(n, fraction)] for n in s.unique()}), kind)("n")
    parts = r.select("n").distinct().select("n", of(_asked).alias("ask"), of(_indexed).alias("index"))  # as many rows as there are lengths
    kept = r.join(F.broadcast(parts), "n")
    cell = lambda d: F.floor(F.greatest(F.least(d, F.lit(1e15)), F.lit(-1e15)) / F.lit(wide)).cast("bigint")
    short = lambda d: F.greatest(F.least(d, F.lit(MOST_SECONDS)), F.lit(-MOST_SECONDS)).cast("float")

    def rows(col: str, asked: bool) -> DataFrame:
        at = F.col("size") * F.col("block")
        x = kept.select("rid", "n", "ds", "words", "fps", F.inline(col)).select("rid", "n", "size", "block", F.slice("ds", at + 1, F.col("size")).alias("d"), F.slice("words", 3 * at + 1, F.lit(2)).alias("w"), F.element_at("fps", at + 1).alias("fp"))
        x = x.where(F.forall("d", lambda d: d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))))
        six = F.col("w").isNotNull() | F.coalesce((F.size("fp") == 6) & F.forall("fp", lambda w: w.isNotNull()), F.lit(False))
        word = lambda k: F.coalesce(F.try_element_at("fp", F.lit(k)), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))
        first = F.element_at("d", 1)
        where = F.explode(F.sequence(cell(first - near), cell(first + near))) if asked else cell(first)
        return x.select(
            F.lit(asked).alias("asked"), "rid", "n", "size", "block", where.alias("cell"), *[short(F.coalesce(F.try_element_at("d", F.lit(k + 1)), F.lit(0.0))).alias(f"d{k}") for k in range(MOST_PLACES)],
            six.alias("six"), *[F.coalesce(F.col("w")[k], word(2 * k + 1).bitwiseXOR(F.shiftleft(word(2 * k + 2), 32))).alias(f"w{k}") for k in range(2)],
        )

    bits = _most_bits(similar)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            yield from _meet(pd.concat(got, ignore_index=True), seconds, fraction, bits)

    put = by_key(rows("ask", True).unionAll(rows("index", False)), "size", "block", "cell")
    return put.mapInPandas(meet, "a bigint, b bigint").distinct()


def duplicate_pairs(recs: DataFrame, key: str = "sig", seconds: float = SECONDS, similar: float = SIMILAR, fraction: float = FRACTION) -> DataFrame:
    """``a, b, matched, longest`` (a < b) of the lists whose tracks agree place by place in at least `fraction` of the longer.

    `recs`: key and ``tracks array<struct<duration, fp>>``, one row per key.
    """
    return _pairs(recs.select(F.col(key).alias("key"), _heard("tracks").alias("p")), seconds, similar, fraction)


def _heard(tracks: str) -> Column:
    return _packed(F.transform(tracks, lambda t: t["duration"]), F.transform(tracks, lambda t: t["fp"]))


def _pairs(lists: DataFrame, seconds: float = SECONDS, similar: float = SIMILAR, fraction: float = FRACTION) -> DataFrame:
    """The same of ``key, p``, the packed list."""
    r = cut(lists.where("p.n > 0").select(F.monotonically_increasing_id().alias("rid"), "key", "p.*"))
    side = lambda k: r.select(F.col("rid").alias(k), F.struct("key", "n", "ds", "words", "fps").alias(f"{k}_"))
    x = candidates(r, seconds, similar, fraction).join(side("a"), "a").join(side("b"), "b")
    near = F.zip_with(F.arrays_zip(F.col("a_.ds").alias("ds"), _unpacked("a_").alias("fps")), F.arrays_zip(F.col("b_.ds").alias("ds"), _unpacked("b_").alias("fps")), lambda s, t: F.coalesce((F.abs(s["ds"] - t["ds"]) <= seconds) & (bit_similarity(s["fps"], t["fps"]) >= similar), F.lit(False)))
    x = x.withColumn("matched", F.size(F.filter(near, lambda m: m))).withColumn("longest", F.greatest("a_.n", "b_.n"))
    return x.where(F.col("matched") >= F.col("longest") * fraction).select(F.least("a_.key", "b_.key").alias("a"), F.greatest("a_.key", "b_.key").alias("b"), "matched", "longest")


def _lists(prints: DataFrame) -> DataFrame:
    """``key, p``: one packed list per signature, that of its first print."""
    return prints.where("audio_signature is not null").select(F.col("audio_signature").alias("key"), "print_id", F.when(F.col("tracks").isNotNull(), _heard("tracks")).alias("p")).groupBy("key").agg(F.min_by("p", "print_id").alias("p")).where("p is not null")


def representatives(prints: DataFrame) -> DataFrame:
    """``sig, tracks``: one track list per signature, of each track the duration and fingerprint."""
    heard = F.zip_with("p.ds", _unpacked("p"), lambda d, f: F.struct(d.alias("duration"), f.alias("fp")))
    return _lists(prints).select(F.col("key").alias("sig"), heard.alias("tracks"))


def clusters(prints: DataFrame) -> DataFrame:
    """``folder id, cluster``: every print of a signature, clustered by matching lists; the cluster is its least signature."""
    comp = connected_components(_pairs(_lists(prints)))
    p = prints.where("audio_signature is not null").select("print_id", F.col("audio_signature").alias("node"))
    return p.join(comp, "node", "left").select("print_id", F.col("node").alias("audio_signature"), F.coalesce("component", "node").alias("cluster"))


KEEP = {"largest": lambda: F.desc_nulls_last("bytes"), "most_tracks": lambda: F.desc_nulls_last("tracks"), "oldest": lambda: F.asc_nulls_last("mtime"), "newest": lambda: F.desc_nulls_last("mtime")}


def keepers(members: DataFrame, strategy: str = "largest", order: str = "print_id") -> DataFrame:
    """``cluster, <order>, keep``: the first by the strategy (ties by `order`) is kept, the rest of the cluster are drops.

    `members`: cluster, order, bytes, tracks, mtime. The best of a cluster is an aggregate, so a hot cluster is no single task.
    """
    if strategy not in KEEP:
        raise ValueError(f"unknown strategy: {strategy}")
    metric = {"largest": F.coalesce(F.col("bytes").cast("double"), F.lit(float("-inf"))), "most_tracks": F.coalesce(F.col("tracks").cast("double"), F.lit(float("-inf"))), "oldest": -F.coalesce(F.col("mtime").cast("double"), F.lit(float("inf"))), "newest": F.coalesce(F.col("mtime").cast("double"), F.lit(float("-inf")))}[strategy]
    best = members.groupBy("cluster").agg(F.max(F.struct(metric.alias("m"), (-F.col(order)).alias("o"))).alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return members.join(best, "cluster").select("cluster", order, (F.col(order) == -F.col("b.o")).alias("keep"))


def content_fingerprint(files: DataFrame, infos: DataFrame, folder: str = "folder") -> DataFrame:
    """``folder, fingerprint``: SHA-1 over the folder's name, a part `a:path|size` for each audio file by path, and `i:name|size`
    for the first info file (the largest, then by name), each part after a zero byte. The order of rows does not matter.

    `files(folder, path, size)`: paths within the folder; a null size counts as -1. `infos(folder, name, size)` may be empty.
    """
    size = F.coalesce(F.col("size").cast("bigint"), F.lit(-1))
    x = files.where("path is not null").groupBy(folder).agg(F.sort_array(F.collect_list(F.struct("path", size.alias("size")))).alias("l"))
    i = infos.where("name is not null").groupBy(folder).agg(F.min_by(F.struct("name", size.alias("size")), F.struct(-size, "name")).alias("i"))
    part = lambda kind, name, n: F.concat(F.lit(f"\0{kind}:"), name, F.lit("|"), n.cast("string"))
    audio = F.array_join(F.transform("l", lambda f: part("a", f["path"], f["size"])), "")
    body = F.concat(F.element_at(F.split(folder, "/"), -1), audio, F.coalesce(part("i", F.col("i.name"), F.col("i.size")), F.lit("")))
    return x.join(i, folder, "left").select(folder, F.sha1(body).alias("fingerprint"))


def audio_signature(prints: DataFrame) -> DataFrame:
    """``print_id, signature``: SHA-1 over `name|fingerprint` and a zero byte of each track by its file name, ties in the order
    given; null without tracks. A fingerprint's words are written with commas between them."""
    named = F.transform("tracks", lambda x, i: F.struct(F.element_at(F.split(x["path"], "/"), -1).alias("name"), i.alias("i"), F.array_join(F.transform(x["fp"], lambda w: w.cast("string")), ",").alias("fp")))
    t = F.transform(F.array_sort(named), lambda x: F.concat(x["name"], F.lit("|"), x["fp"], F.lit("\0")))
    return prints.select("print_id", F.when(F.size("tracks") > 0, F.sha1(F.array_join(t, ""))).alias("signature"))


def totals(prints: DataFrame) -> DataFrame:
    """``print_id, tracks, duration_ms``: number of tracks and whole milliseconds of their durations."""
    ms = F.aggregate("tracks", F.lit(0).cast("bigint"), lambda s, t: s + F.coalesce(F.round(t["duration"] * 1000).cast("bigint"), F.lit(0)))
    return prints.select("print_id", F.greatest(F.size("tracks"), F.lit(0)).alias("n_tracks"), F.coalesce(ms, F.lit(0)).alias("duration_ms"))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, mtime, size) the cache doesn't hold: those to fingerprint."""
    return wanted.join(cache, ["path", "mtime", "size"], "left_anti")

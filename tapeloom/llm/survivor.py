"""Best representative of each duplicate group (problem 2): token-level consensus, or a precedence.

:func:`consensus_values` is the vote: a group's distinct values are tokenised, aligned progressively into one profile of
columns, every column takes the token with the greatest sum of weights (trust and completeness of all records that say so),
and the existing value closest to that consensus survives.

p2_found has another rule: completeness, then trust, then recency, then the lowest id, whatever the other records say. No
vote of columns can give it: weights that make the first record outvote all others make the consensus that record, and the
alignment decides nothing. :func:`preferred_values` therefore takes the maximum by that precedence, one native aggregate.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

#: Most distinct values, or profiles, that one task row holds; the result does not depend on it.
CHUNK = 256
#: Extensions with a size-per-second of their own; the rest share one.
FORMATS = ("flac", "mp3", "ogg", "wav", "shn", "ape", "m4a", "aif", "aiff", "opus", "wv")
#: Fillers that hold no content.
FILLERS = ("?", "-", "--", "---", "n/a", "na", "none", "null", "unknown", "unk", "anon", "anon.", "anonymous", "various", "tba", "tbd", "private")
#: A total stands if it is within these bounds of what tracks and format imply. Partial and mis-scaled totals lie far outside.
SIZE_TOLERANCE, DURATION_SLACK_S, DURATION_SLACK = 0.2, 2.0, 0.002


def is_real(c: Column) -> Column:
    """True where a text holds content: not null, blank or a filler."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.coalesce((t != "") & ~t.isin(*FILLERS), F.lit(False))


def usable_values(prints: DataFrame, concerts: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per usable value: ``audio_signature, field_name, print_id, value, precedence columns``.

    Null, NaN, zero and negative totals, totals out of scale and partial totals are not usable. A record without
    tracks cannot be checked against them: its positive totals stand. A null signature names no group.
    """
    p = prints.where("audio_signature is not null").select(
        "print_id", "concert_id", "audio_signature", "origin", "scanned_at", F.col("total_size").cast("double").alias("size"), F.col("total_duration").cast("double").alias("dur"),
        F.aggregate(F.coalesce(F.col("tracks.duration"), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))).alias("heard"),
        F.lower(F.regexp_extract(F.coalesce(F.try_element_at(F.col("tracks.path"), F.lit(1)), F.lit("")), r"\.([A-Za-z0-9]+)$", 1)).alias("ext"),
    )
    p = p.withColumn("ext", F.when(F.col("ext").isin(*FORMATS), F.col("ext")).otherwise("other"))
    rate = F.when((F.col("size") > 0) & (F.col("heard") > 0), F.col("size") / F.col("heard"))
    usual = p.groupBy("ext").agg(F.percentile_approx(rate, 0.5, 1000).alias("usual"))  # at most len(FORMATS)+1 rows
    p = p.join(F.broadcast(usual), "ext", "left")
    near = F.coalesce(F.abs(F.col("size") / (F.col("heard") * F.col("usual")) - 1) <= SIZE_TOLERANCE, F.lit(False))
    size_ok = (F.col("size") > 0) & ~F.isnan("size") & ((F.col("heard") <= 0) | near)
    off = F.abs(F.col("dur") - F.col("heard")) <= F.greatest(F.lit(DURATION_SLACK_S), F.col("heard") * DURATION_SLACK)
    dur_ok = (F.col("dur") > 0) & ~F.isnan("dur") & ((F.col("heard") <= 0) | off)
    src = concerts.where("source is not null").select("concert_id", F.col("source.kind").alias("kind"), F.filter(F.coalesce("source.mics", F.array().cast("array<string>")), is_real).alias("mics"), F.col("source.taper").alias("taper"))
    p = p.join(src, "concert_id", "left")
    full = is_real(F.col("kind")).cast("int") + F.coalesce((F.size("mics") > 0).cast("int"), F.lit(0)) + is_real(F.col("taper")).cast("int")
    source = F.concat_ws(
        " ", F.when(is_real(F.col("kind")), F.concat(F.lit("kind:"), F.lower("kind"))), F.transform("mics", lambda m: F.concat(F.lit("mic:"), F.lower(m))), F.when(is_real(F.col("taper")), F.concat(F.lit("taper:"), F.lower("taper"))),
    )
    whole = lambda c: F.format_string("%.3f", c)
    fields = F.array(
        F.struct(F.lit("total_size").alias("field_name"), F.coalesce(size_ok, F.lit(False)).alias("ok"), F.lit(1).alias("full"), whole(F.col("size")).alias("value")),
        F.struct(F.lit("total_duration").alias("field_name"), F.coalesce(dur_ok, F.lit(False)).alias("ok"), F.lit(1).alias("full"), whole(F.col("dur")).alias("value")),
        F.struct(F.lit("source").alias("field_name"), (full > 0).alias("ok"), full.alias("full"), source.alias("value")),
    )
    long = p.select("audio_signature", "print_id", "origin", "scanned_at", F.inline(fields))
    t = trust.groupBy("origin", "field_name").agg(F.max("trust").alias("trust"))
    long = long.join(broadcast_if_small(t), ["origin", "field_name"], "left")
    return long.select("audio_signature", "field_name", "print_id", "ok", "value", "full", F.coalesce("trust", F.lit(-1)).cast("int").alias("trust"), F.coalesce(F.unix_micros(F.col("scanned_at").cast("timestamp")), F.lit(-(1 << 62))).alias("seen"))


def tokens_of(value: str) -> list[str]:
    """Numbers give one token per digit with its place; text gives its words."""
    try:
        float(value)
    except ValueError:
        return value.split()
    head, _, tail = value.partition(".")
    return [f"{len(head) - i}:{c}" for i, c in enumerate(head)] + [f"-{i}:{c}" for i, c in enumerate(tail, 1)]


def align(profile: list[dict], other: list[dict]) -> list[tuple[int, int]]:
    """Global alignment of two profiles; a column scores 2 with a shared token, -1 without, a gap -1."""
    n, m = len(profile), len(other)
    if n == m and all(not a.keys().isdisjoint(b) for a, b in zip(profile, other)):
        return [(i, i) for i in range(n)]
    row = [-j for j in range(m + 1)]
    back = []
    for i in range(1, n + 1):
        a, new, at = profile[i - 1], [-i], [2]
        for j in range(1, m + 1):
            d = row[j - 1] + (2 if not a.keys().isdisjoint(other[j - 1]) else -1)
            u, v = row[j] - 1, new[j - 1] - 1
            best = max(d, u, v)
            new.append(best)
            at.append(0 if best == d else 2 if best == u else 1)
        row = new
        back.append(at)
    i, j, out = n, m, []
    while i or j:
        k = 1 if not i else 2 if not j else back[i - 1][j]
        if k == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif k == 1:
            j -= 1
            out.append((-1, j))
        else:
            i -= 1
            out.append((i, -1))
    return out[::-1]


Profile = tuple[list[dict[str, float]], float]  # columns of {token: votes}, "" a gap; and the weight of all that went in


def profile_of(value: str, weight: float) -> Profile:
    return [{t: weight} for t in tokens_of(value)], weight


def merge(x: Profile, y: Profile) -> Profile:
    """Two profiles aligned and added up; a column that one of them lacks gets that one's weight as votes for a gap."""
    (a, wa), (b, wb) = x, y
    cols = []
    for i, j in align(a, b):
        p, q = a[i] if i >= 0 else {"": wa}, b[j] if j >= 0 else {"": wb}
        cols.append({t: p.get(t, 0.0) + q.get(t, 0.0) for t in p.keys() | q.keys()})
    return cols, wa + wb


def consensus(profile: Profile) -> list[str]:
    best = [min((-w, t == "", t) for t, w in c.items())[2] for c in profile[0]]  # a tie is no gap
    return [t for t in best if t]


def guided(items: list[tuple[int, Any]], bit: int, read: Callable[[Any], Profile]) -> Profile:
    """The items' profiles merged along the binary tree of their keys' bits, from `bit` down. The tree is fixed by the keys, so
    any of its branches may be merged elsewhere first."""
    if len(items) == 1:
        return read(items[0][1])
    if bit < 0:  # equal keys
        out = None
        for _, x in sorted(items, key=lambda i: str(i[1])):
            out = read(x) if out is None else merge(out, read(x))
        return out
    left, right = [i for i in items if not i[0] >> bit & 1], [i for i in items if i[0] >> bit & 1]
    if not left or not right:
        return guided(left or right, bit - 1, read)
    return merge(guided(left, bit - 1, read), guided(right, bit - 1, read))


def distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


KEY = ["audio_signature", "field_name"]


def _rank() -> Column:
    """Completeness, trust, recency, lowest id: greater is better."""
    return F.struct("full", "trust", "seen", (-F.col("print_id")).alias("id"))


def preferred_values(values: DataFrame) -> DataFrame:
    """The value of highest precedence of each ``(audio_signature, field_name)`` of :func:`usable_values` (rows with ``ok``).

    Partial maxima are taken before the shuffle, so a hot group is one row per task."""
    return values.where("ok").groupBy(KEY).agg(F.max_by(F.struct("print_id", "value"), _rank()).alias("v")).select(*KEY, "v.*")


def _pack(p: Profile) -> str:
    return json.dumps(p)


def _unpack(p: str) -> Profile:
    cols, w = json.loads(p)
    return cols, w


def consensus_values(values: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The existing value closest to the vote of each ``(audio_signature, field_name)`` of :func:`usable_values` (rows with
    ``ok``); of equally close ones the one of highest precedence.

    Records that say the same are added up before anything is collected. The distinct values of a group merge along a tree
    given by their hashes: a group of more than about `chunk` of them is cut at a depth of that tree, its branches are merged
    in rows of their own, and their profiles (not their winners) go on upwards, so `chunk` does not change the result.
    """
    weight = (F.greatest("trust", F.lit(0)) + 1) * F.col("full")
    v = cut(values.where("ok").groupBy(*KEY, "value").agg(F.sum(weight.cast("double")).alias("w"), F.max(_rank()).alias("best")).withColumn("h", F.xxhash64("value")))
    n = v.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n")).first()[0] or 0
    depth = F.when(F.col("n") > chunk, F.ceil(F.log2(F.col("n") / chunk)).cast("int") + 1).otherwise(0)
    deep, step = (math.ceil(math.log2(most / chunk)) + 1 if most > chunk else 0), max(1, int(math.log2(chunk)))

    @F.pandas_udf("string")
    def grow(parts: pd.Series, depths: pd.Series) -> pd.Series:
        return pd.Series([_pack(guided([(m["h"] & 0xFFFFFFFFFFFFFFFF, (m["value"], m["w"])) for m in g], 63 - d, lambda x: profile_of(*x))) for g, d in zip(parts, depths)])

    @F.pandas_udf("string")
    def join(parts: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([_pack(guided([(m["branch"], m["p"]) for m in g], k - 1, _unpack)) for g, k in zip(parts, levels)])

    branch = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(h, 64 - depth)"))
    p = v.join(broadcast_if_small(n), KEY).withColumn("depth", depth).withColumn("branch", branch.cast("bigint"))
    p = p.groupBy(*KEY, "depth", "branch").agg(F.collect_list(F.struct("h", "value", "w")).alias("m")).select(*KEY, "depth", "branch", grow("m", "depth").alias("p"))
    while deep > 0:
        p = cut(p)
        up = F.least(F.col("depth"), F.lit(step))
        higher = p.where("depth > 0").select(*KEY, (F.col("depth") - up).alias("to"), F.expr(f"shiftright(branch, least(depth, {step}))").alias("at"), up.alias("levels"), F.struct(F.expr(f"branch & (shiftleft(1L, least(depth, {step})) - 1)").alias("branch"), "p").alias("m"))
        higher = higher.groupBy(*KEY, "to", "at", "levels").agg(F.collect_list("m").alias("m"))
        p = p.where("depth = 0").unionAll(higher.select(*KEY, F.col("to").alias("depth"), F.col("at").alias("branch"), join("m", "levels").alias("p")))
        deep -= step

    voted = F.pandas_udf(lambda ps: ps.map(lambda p: consensus(_unpack(p))), "array<string>")

    @F.pandas_udf("int")
    def off(vs: pd.Series, want: pd.Series) -> pd.Series:
        return pd.Series([0 if (t := tokens_of(x)) == list(w) else distance(t, list(w)) for x, w in zip(vs, want)], dtype="int32")

    want = cut(p.select(*KEY, voted("p").alias("want")))
    near = v.join(broadcast_if_small(want), KEY).select(*KEY, "value", "best", off("value", "want").alias("off"))
    won = near.groupBy(KEY).agg(F.max_by(F.struct((-F.col("best.id")).alias("print_id"), "value"), F.struct(-F.col("off"), "best")).alias("v"))
    return won.select(*KEY, "v.*")


def survivors(prints: DataFrame, concerts: DataFrame, trust: DataFrame, vote: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``audio_signature, field_name, print_id, value`` for each signature with two or more records, by precedence or by vote.

    No usable value gives no row. Empty tables give no rows; other columns of the inputs are ignored.
    """
    several = prints.where("audio_signature is not null").groupBy("audio_signature").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("audio_signature")
    v = usable_values(prints, concerts, trust).join(several, "audio_signature", "left_semi")
    won = consensus_values(v, chunk) if vote else preferred_values(v)
    return won.select(*KEY, "print_id", "value")

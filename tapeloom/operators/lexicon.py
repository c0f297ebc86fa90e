"""Lexicons learned from a collection: building, merging, and matching names exactly, by similarity, by containment."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.artists import ancestor_probes
from ..functions.text import TRIBUTE, filled, is_junk_name, normalize_name
from ..session import broadcast_if_small, cut, spread

RATIO, SHORTEST, MIN_COUNT = 0.88, 5, 2
#: Letters up to which a key's segments are looked up by place.
POSITIONED = 40


def build(names: DataFrame, name: str = "name", cnt: Column | None = None) -> DataFrame:
    """``key, name, cnt``: names folded by key; the spelling with the highest count, then the longest, then the last stands."""
    c = F.coalesce(cnt if cnt is not None else F.lit(1), F.lit(0)).cast("bigint")
    x = names.select(filled(F.col(name)).alias("name"), c.alias("n")).where("name is not null")
    x = x.groupBy("name").agg(F.sum("n").alias("n")).withColumn("key", normalize_name(F.col("name"))).where("key != ''")
    return x.groupBy("key").agg(F.max_by("name", F.struct("n", F.length("name"), "name")).alias("name"), F.sum("n").alias("cnt"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """``name, cnt``: the higher count of each exact spelling, most frequent first; idempotent."""
    o, n = old.groupBy("name").agg(F.max("cnt").alias("a")), new.groupBy("name").agg(F.max("cnt").alias("b"))
    return o.join(n, "name", "full_outer").select("name", F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).cast("bigint").alias("cnt")).orderBy(F.desc("cnt"), F.lower("name"), "name")


def harvest(names: DataFrame, existing: DataFrame, floor: int = MIN_COUNT) -> DataFrame:
    """``name, cnt, is_new``: names counted in a listing, junk left out, counts at least `floor` and never below the known."""
    got = build(names.where(~is_junk_name(F.col("name"))))
    known = existing.groupBy(normalize_name(F.col("name")).alias("key")).agg(F.max("cnt").alias("known"))
    return got.join(known, "key", "left").select("name", F.greatest("cnt", F.coalesce("known", F.lit(0)), F.lit(floor)).cast("bigint").alias("cnt"), F.col("known").isNull().alias("is_new"))


def _segments(n: int) -> list[tuple[int, int]]:
    k = int((1 - RATIO) * (n + n * (2 - RATIO) / RATIO)) + 1
    base, more = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = base + (i < more)
        if size:
            out.append((at, size))
        at += size
    return out


@lru_cache(None)
def _indels(n: int, m: int) -> int:
    """Most letters that are left out or put in between texts of n and m letters whose ratio reaches RATIO."""
    return n + m - 2 * next(k for k in range(n + m + 1) if 2.0 * k / (n + m) >= RATIO)


@lru_cache(None)
def _cuts(n: int, d: int) -> list[tuple[int, int]]:
    """(start, length) of d + 1 segments of n letters: d insertions and deletions leave one whole."""
    base, more = divmod(n, d + 1)
    return [(i * base + min(i, more), base + (i < more)) for i in range(d + 1)]


@lru_cache(None)
def _faced(n: int) -> list[int]:
    """The numbers of insertions and deletions that any partner of n letters may take."""
    return sorted({_indels(n, m) for m in range(1, 2 * n + 2) if abs(m - n) <= _indels(n, m) < n})


@lru_cache(None)
def _looked_up(m: int, lengths: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """(prefix, start, length) of the pieces of m letters under which a key may stand. A segment is shifted by what is put in or
    left out before it."""
    out = set()
    for n in lengths:
        d, gap = _indels(n, m), m - n
        if abs(gap) > d or d >= n:
            continue
        if n > POSITIONED:
            out |= {("~", i, s) for s in {s for _, s in _segments(n)} for i in range(m - s + 1)}
            continue
        for i, (p, s) in enumerate(_cuts(n, d)):
            out |= {(f"{n}.{d}.{i}.", at, s) for at in range(max(0, p - (d - gap) // 2), min(m - s, p + (d + gap) // 2) + 1)}
    return sorted(out)


def _index_keys(k: str) -> list[str]:
    n = len(k)
    if n > POSITIONED:
        return sorted({f"~{k[a : a + s]}" for a, s in _segments(n)})
    return [f"{n}.{d}.{i}.{k[p : p + s]}" for d in _faced(n) for i, (p, s) in enumerate(_cuts(n, d))]


def _letters(k: str) -> int:
    out = 0
    for c in k:
        bit = 1 << ord(c) % 31
        out |= bit << 31 if out & bit else bit
    return out


def _near(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs whose ratio can reach RATIO: insertions and deletions leave one of the key's segments whole in the name, near its
    place. Longer keys than POSITIONED have too many places and are looked up by their pieces anywhere."""
    lengths = tuple(sorted(r[0] for r in keys.select(F.length("key")).distinct().collect()))  # no more than the longest key has letters
    # with the pieces, the letters that stand once and twice: an insertion or deletion changes one of them
    keyed = lambda of: F.pandas_udf(lambda s: pd.DataFrame({"keys": s.map(of), "bits": s.map(_letters)}), "keys array<string>, bits bigint")("key")
    asked = lambda k: sorted({f"{x}{k[a : a + n]}" for x, a, n in _looked_up(len(k), lengths)})
    a = keys.select("key", "name", "cnt", keyed(_index_keys).alias("x")).select("key", "name", "cnt", F.col("x.bits").alias("a_bits"), F.explode("x.keys").alias("seg"))
    b = spread(names.select("key")).select(F.col("key").alias("want"), keyed(asked).alias("x")).select("want", F.col("x.bits").alias("b_bits"), F.explode("x.keys").alias("seg"))
    la, lb = F.length("key"), F.length("want")
    room = F.floor((1 - RATIO) * (la + lb) + F.lit(1e-6)).cast("int")
    lost = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    near = (2 * lost("a_bits", "b_bits") <= room - lb + la) & (2 * lost("b_bits", "a_bits") <= room + lb - la) & (F.call_function("levenshtein", F.col("key"), F.col("want"), room) >= 0)
    return b.join(a, "seg").where((2 * F.least(la, lb) >= RATIO * (la + lb)) & near).select("want", "key", "name", "cnt").distinct()


def match(names: DataFrame, lexicon: DataFrame, min_count: int = MIN_COUNT, fuzzy: bool = True) -> DataFrame:
    """``name, match, how`` for each distinct `name`: exact key, else the best ratio of at least RATIO, else the longest
    contained key between word breaks (not in names of tributes). `lexicon(key, name, cnt)` as of :func:`build`."""
    q = cut(names.select("name").where("name is not null").distinct().withColumn("key", normalize_name(F.col("name"))).where("key != ''"))
    lexicon = cut(lexicon.select("key", "name", "cnt"))
    lex = lexicon.select("key", F.col("name").alias("match"), "cnt")
    exact = q.join(lex.where(F.col("cnt") >= min_count), "key").select("name", "key", "match", F.lit("exact").alias("how"))
    rest = q.join(exact.select("name"), "name", "left_anti")
    out = exact.select("name", "match", "how")
    if fuzzy:
        ratio = F.pandas_udf(lambda a, b: pd.Series([m.ratio() if m.quick_ratio() >= RATIO else 0.0 for m in (difflib.SequenceMatcher(None, y, x) for x, y in zip(a, b))], dtype=float), "double")
        long = rest.where(F.length("key") >= SHORTEST)
        pairs = _near(lexicon.select("key", "name", "cnt"), long.select("key").distinct()).withColumn("r", ratio("key", "want")).where(F.col("r") >= RATIO)
        best = pairs.groupBy("want").agg(F.max_by(F.struct("name", "cnt"), F.struct("r", "key")).alias("b")).where(F.col("b.cnt") >= min_count)
        near = long.join(best, long["key"] == best["want"]).select(long["name"], F.col("b.name").alias("match"), F.lit("fuzzy").alias("how"))
        out = out.unionAll(near)
        rest = rest.join(near.select("name"), "name", "left_anti")
    ws = F.split("key", " ")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.size(ws)), lambda i: F.transform(F.sequence(i, F.size(ws)), lambda j: F.array_join(F.slice(ws, i, j - i + 1), " "))))
    held = rest.where(~F.col("key").rlike(TRIBUTE)).select("name", F.col("key").alias("whole"), F.explode(F.array_distinct(grams)).alias("key")).where((F.length("key") >= SHORTEST) & (F.length("key") < F.length("whole")))
    hit = held.join(lex.where(F.col("cnt") >= min_count), "key").groupBy("name").agg(F.max_by("match", F.struct(F.length("key"), "cnt", "key")).alias("match"))
    return out.unionAll(hit.select("name", "match", F.lit("contained").alias("how")))


def from_ancestors(paths: DataFrame, lexicon: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``folder, artist``: the nearest directory above that the lexicon knows, of each distinct `folder` that has one.

    Directories that organise a library end the walk; of those, the ones for various artists name them. Years and dates are
    passed by. All spellings to try are matched at once, as distinct names."""
    up = paths.select("folder").where("folder is not null").distinct().select("folder", ancestor_probes(F.col("folder")).alias("up"))
    end = F.try_element_at(F.filter("up", lambda x: x["stop"]), F.lit(1))
    up = cut(up.select("folder", end["depth"].alias("end"), end["various"].alias("various"), F.filter("up", lambda x: ~x["stop"] & (x["depth"] < F.coalesce(end["depth"], F.lit(1 << 30)))).alias("up")))
    tries = up.select("folder", F.inline(F.flatten(F.transform("up", lambda x: F.transform(x["candidates"], lambda c, i: F.struct(x["depth"].alias("depth"), i.alias("pos"), c.alias("name")))))))
    known = cut(match(tries.select("name"), lexicon, min_count))
    best = tries.join(broadcast_if_small(known.select("name", "match")), "name").groupBy("folder").agg(F.min_by("match", F.struct("depth", "pos")).alias("artist"))
    return up.select("folder", "various").join(best, "folder", "left").select("folder", F.coalesce("artist", F.when(F.col("various"), "Various Artists")).alias("artist")).where("artist is not null")


def prefix_dictionary(rows: DataFrame, least: int = 2, purity: float = 0.8) -> DataFrame:
    """``prefix, artist``: a library's own abbreviations, those of :func:`prefix_purity`; folders join it on their prefix."""
    return prefix_purity(rows, least, purity).select("prefix", F.col("creator").alias("artist"))


def prefix_purity(rows: DataFrame, least: int = 2, purity: float = 0.8, deny: tuple[str, ...] = ("cd", "disc", "track", "set", "d", "t")) -> DataFrame:
    """``prefix, creator, count, total, purity, creators``: abbreviations that stand for one creator nearly always."""
    x = rows.where(F.length("prefix").between(2, 12) & ~F.col("prefix").isin(*deny) & F.col("creator").isNotNull()).groupBy("prefix", "creator").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("prefix")
    x = x.withColumns({"total": F.sum("count").over(w), "creators": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy(F.desc("count"), "creator"))})
    return x.where("r = 1").withColumn("purity", F.round(F.col("count") / F.col("total"), 4)).where((F.col("count") >= least) & (F.col("count") >= F.col("total") * purity)).select("prefix", "creator", "count", "total", "purity", "creators")


def lookup(names: DataFrame, lexicon: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``name, match`` by exact key only."""
    k = names.withColumn("key", normalize_name(F.col("name")))
    return k.join(broadcast_if_small(lexicon.where(F.col("cnt") >= min_count).select("key", F.col("name").alias("match"))), "key", "left").drop("key")

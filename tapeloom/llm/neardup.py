"""Near-duplicate track lists (problem 3): vantage-point trees over fingerprints, exact pairs.

Two tracks are counterparts if at most 28 of their 192 bits differ (and durations lie within 7 s). Whole fingerprints of
unrelated tracks are all about 96 bits apart, where no ball of 28 bits can be told from its neighbours. The 192 bits are
therefore cut into 15 bands: of 28 differing bits at most one falls into some band, so a query needs a ball of one bit in
each band, and there triangle bounds prune nearly everything. Every band has a vantage-point tree that splits its
fingerprint parts by Hamming distance down to leaves of a few values; a node is entered only where the ball may reach it,
and boundary-overlapping leaves are all queried. As a band has no more than 2^13 values, the tree is compiled once to two
tables (value to leaf, value to leaves its ball overlaps) that the tasks look up. Pairs met are compared in full.

Where a task holds many rows, a ball of one bit in 13 meets too many of them. There 10 bands of 19 or 20 bits are taken, with
balls of two bits. Such a tree has the leaves of a tree over the band's first half, under each of which a tree over the other
half goes on with the radius that is left; both are compiled, down to single values, by distance.

Tasks hold a cell of durations (14 s; a query visits the two it may reach), cut into blocks where it is crowded. Durations
only place rows; which pairs are compared within a cell the trees decide.

Queries are a prefix of each list: counterparts must number at least 0.6 of the longer list, so of any
``n - ceil(0.6 n) + 1`` tracks of a list one must have a counterpart. The tracks that sound least like a sample's common
ones are taken, which keeps sounds shared by many recordings out of the candidate search; among equals the longest, as
there are fewest others of their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

BITS, WORDS = 192, 6
#: Counterparts: at least 0.85 of 192 bits equal, durations within 7 s; at least 0.6 of the longer list.
MAX_BITS, MAX_SECONDS = 28, 7.0
SHARE_NUM, SHARE_DEN = 3, 5
#: Bands as (first bit, bits), and the radius of a query's ball in one: 15 bands of two differing bits would be 30 > 28.
BANDS = tuple((13 * k, 13) for k in range(12)) + tuple((156 + 12 * k, 12) for k in range(3))
RADIUS = MAX_BITS // len(BANDS)
#: The same for wide bands, of which each half has a tree; taken for this many rows and more.
WIDE = tuple((20 * k, 20) for k in range(2)) + tuple((40 + 19 * k, 19) for k in range(8))
WIDE_RADIUS = MAX_BITS // len(WIDE)
WIDE_ROWS = 40_000
#: Values of a band that a leaf may hold.
LEAF = 2
#: Tracks sampled to tell common sounds (a bounded fit that only orders the prefix).
SAMPLE = 512
#: Queries that one task holds, and half the index rows; a cell beyond is cut into blocks that all meet, each row once for every block
#: that it meets: these are large, so that rows exchanged don't grow with the square of the input before memory makes them.
BLOCK = 200_000
CELL_SECONDS = 2 * MAX_SECONDS
EPS = 1e-6


def need(n: int) -> int:
    """Least counterparts for a longest list of n tracks: ceil(0.6 n) in whole numbers."""
    return -(-SHARE_NUM * n // SHARE_DEN)


def pack(words: np.ndarray) -> np.ndarray:
    """(n, 6) 32-bit words to (n, 3) 64-bit ones."""
    w = words.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    return w[:, 0::2] | (w[:, 1::2] << np.uint64(32))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def fit_tree(bits: int, leaf: int = LEAF, seed: int = 7) -> tuple[list[tuple[int, int, int, int]], list[np.ndarray]]:
    """A vantage-point tree over all values of `bits` bits: nodes ``(vantage, radius, inner, outer)`` and the values of each
    leaf; a negative child is leaf ``-child-1``. A value goes inside if its Hamming distance is at most the radius."""
    rng, nodes, leaves = np.random.default_rng(seed), [], []

    def grow(values: np.ndarray) -> int:
        if len(values) <= max(1, leaf):
            leaves.append(values)
            return -len(leaves)
        best = None
        for v in rng.choice(values, 2, replace=False):  # the vantage whose boundary the fewest balls cross
            d = np.bitwise_count(values ^ v)
            for mu in {int(np.median(d)), int(np.median(d)) - 1}:
                inner = d <= mu
                if 0 < inner.sum() < len(values):
                    cost = float(((d > mu - RADIUS) & (d <= mu + RADIUS)).mean()) + abs(float(inner.mean()) - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, int(v), mu, inner)
        _, v, mu, inner = best
        at = len(nodes)
        nodes.append(None)
        a, b = grow(values[inner]), grow(values[~inner])
        nodes[at] = (v, mu, a, b)
        return at

    grow(np.arange(1 << bits, dtype=np.uint16))
    return nodes, leaves


def visits(nodes: list[tuple[int, int, int, int]], values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, leaf) for every leaf that the balls around `values` may reach by the triangle bounds, and distances computed."""
    rows, leaves, stack, asked = [], [], [(0 if nodes else -1, np.arange(len(values)))], 0
    while stack:
        at, r = stack.pop()
        if not len(r):
            continue
        if at < 0:
            rows.append(r)
            leaves.append(np.full(len(r), -at - 1))
            continue
        v, mu, a, b = nodes[at]
        d = np.bitwise_count(values[r] ^ np.uint16(v)).astype(np.int64)
        asked += len(r)
        stack += [(a, r[d - radius <= mu]), (b, r[d + radius > mu])]
    return np.concatenate(rows), np.concatenate(leaves), asked


@lru_cache(4)
def compiled(bits: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of a band as tables: leaf of each value, and the leaves its ball overlaps (from, list)."""
    nodes, leaves = fit_tree(bits, leaf)
    every = np.arange(1 << bits, dtype=np.uint16)
    home = np.empty(len(every), np.int64)
    for k, vs in enumerate(leaves):
        home[vs] = k
    row, reach, _ = visits(nodes, every, RADIUS)
    held = np.stack([np.resize(vs, leaf) for vs in leaves])  # a leaf's own values settle what the bounds leave open
    near = (np.bitwise_count(held[reach] ^ every[row][:, None]) <= RADIUS).any(1)
    row, reach = row[near], reach[near]
    order = np.lexsort((reach, row))
    return home, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(every)))]), reach[order]


def band(f: np.ndarray, first: int, bits: int) -> np.ndarray:
    """Bits `first` to `first + bits` of each fingerprint, as one number."""
    k, at = divmod(first, 64)
    out = f[:, k] >> np.uint64(at)
    if at + bits > 64:
        out = out | (f[:, k + 1] << np.uint64(64 - at))
    return (out & np.uint64((1 << bits) - 1)).astype(np.int64)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... of all i, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


@lru_cache(4)
def rings(bits: int, radius: int = WIDE_RADIUS) -> tuple[np.ndarray, list[np.ndarray]]:
    """A tree of single values as tables: leaf of each value, and for each distance up to `radius` the leaves so far from it."""
    nodes, leaves = fit_tree(bits, 1)
    held, every = np.concatenate(leaves), np.arange(1 << bits, dtype=np.uint16)
    home = np.empty(len(every), np.int64)
    home[held] = np.arange(len(held))
    row, reach, _ = visits(nodes, every, radius)
    far = np.bitwise_count(held[reach] ^ every[row])
    order = np.lexsort((reach, row))
    row, reach, far = row[order], reach[order], far[order]
    return home, [reach[far == k].reshape(len(every), -1) for k in range(radius + 1)]


def _compare(p: np.ndarray, x: np.ndarray, qd: np.ndarray, qw: list[np.ndarray], xd: np.ndarray, xw: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that are counterparts; two words settle nearly all."""
    w = np.bitwise_count(qw[0].take(p) ^ xw[0].take(x))
    for k in (1, 2):
        ok = np.nonzero(w <= MAX_BITS)[0]
        p, x = p[ok], x[ok]
        w = w[ok] + np.bitwise_count(qw[k][p] ^ xw[k][x])
    ok = np.nonzero((w <= MAX_BITS) & (np.abs(qd[p] - xd[x]) <= MAX_SECONDS + EPS))[0]
    return p[ok], x[ok]


def search(qd: np.ndarray, qf: np.ndarray, xd: np.ndarray, xf: np.ndarray, tables: dict[int, tuple], step: int = 1 << 16, wide: int = WIDE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Exact counterpart pairs (query row, index row): each band's tree says which rows a query meets; a pair once."""
    got_q, got_x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    words = lambda f: [np.ascontiguousarray(f[:, k]) for k in range(3)]
    qw = words(qf)

    def meet(q: np.ndarray, lo: np.ndarray, size: np.ndarray, xo: np.ndarray, xt: np.ndarray, xw: list[np.ndarray]) -> None:
        """Compares each query of `q` with `size` rows of the index in its order, from `lo`; about `step` pairs at a time."""
        ends = np.cumsum(size)
        cuts = np.searchsorted(ends, np.arange(step, (ends[-1] if len(ends) else 0) + step, step), "right")
        for a, b in zip([0, *cuts[:-1]], cuts):
            b = max(b, a + 1) if b < len(size) else b
            p, x = _compare(np.repeat(q[a:b], size[a:b]), ranges(lo[a:b], size[a:b]), qd, qw, xt, xw)
            got_q.append(p)
            got_x.append(xo[x])

    for first, bits in WIDE if len(xd) >= wide and len(qd) else BANDS:
        if len(xd) >= wide:
            (high, outer), (low, inner), half = rings(bits - 10), rings(10), (1 << 10) - 1
            v = band(xf, first, bits)
            leaf = (high[v >> 10] << 10) + low[v & half]
            count = np.bincount(leaf, minlength=1 << bits)
        else:
            home, at, reach = tables[bits]
            leaf = home[band(xf, first, bits)]
            count = np.bincount(leaf, minlength=home.max() + 1)
        xo = np.argsort(leaf, kind="stable")
        xt, xw = xd[xo], words(xf[xo])
        start = np.concatenate([[0], np.cumsum(count)])
        qv = band(qf, first, bits)
        if len(xd) < wide:
            n = at[qv + 1] - at[qv]
            lv = reach[ranges(at[qv], n)]
            keep = count[lv] > 0
            meet(np.repeat(np.arange(len(qv)), n)[keep], start[lv[keep]], count[lv[keep]], xo, xt, xw)
            continue
        there, once, lo = count > 0, (count - 1).astype(np.int32), start.astype(np.int32)
        near = [np.concatenate(inner[: k + 1], 1) for k in range(WIDE_RADIUS, -1, -1)]  # leaves within what is left of the radius
        some = max(1, step // 128)
        for a in range(0, len(qv), some):
            v = qv[a : a + some]
            for out, left in zip(outer, near):
                lv = ((out << 10)[v >> 10][:, :, None] + left[v & half][:, None, :]).ravel()
                at = np.flatnonzero(there.take(lv))
                lv, q = lv.take(at), at // (out.shape[1] * left.shape[1]) + a
                at = lo.take(lv)
                p, x = _compare(q, at, qd, qw, xt, xw)
                got_q.append(p)
                got_x.append(xo[x])
                more = np.flatnonzero(once.take(lv))
                meet(q[more], at[more] + 1, once.take(lv[more]), xo, xt, xw)
    both = np.unique(np.concatenate(got_q) * max(1, len(xd)) + np.concatenate(got_x))
    return both // max(1, len(xd)), both % max(1, len(xd))


def matches(ad: np.ndarray, af: np.ndarray, bd: np.ndarray, bf: np.ndarray, want: int) -> bool:
    """Do at least `want` counterparts exist one to one? Augmenting paths over the few possible pairs."""
    ok = (np.bitwise_count(af[:, None, :] ^ bf[None, :, :]).sum(-1) <= MAX_BITS) & (np.abs(ad[:, None] - bd[None, :]) <= MAX_SECONDS + EPS)
    if min(int(ok.any(0).sum()), int(ok.any(1).sum())) < want:
        return False
    adj, mate = [np.nonzero(r)[0].tolist() for r in ok], {}

    def place(i: int) -> bool:
        """One augmenting path from i, without recursion."""
        seen, stack, came = set(), [(i, iter(adj[i]))], {}
        while stack:
            u, it = stack[-1]
            for j in it:
                if j in seen:
                    continue
                seen.add(j)
                came[j] = u
                if j not in mate:
                    while True:
                        u = came[j]
                        before = next((k for k, m in mate.items() if m == u), None)
                        mate[j] = u
                        if before is None:
                            return True
                        if u == i:
                            return True
                        del mate[before]
                        mate[j] = u
                        j = before
                stack.append((mate[j], iter(adj[mate[j]])))
                break
            else:
                stack.pop()
        return False

    got = sum(place(i) for i in range(len(adj)))
    return got >= want


def lists(prints: DataFrame) -> DataFrame:
    """``sig, n, ds, fps``: one row per signature; of each track three whole numbers in `fps`. Tracks without a duration or six
    words keep their place in n only."""
    p = prints.where("audio_signature is not null").select(F.col("audio_signature").alias("sig"), "print_id", F.coalesce("tracks", F.array()).alias("t"))
    p = p.select("sig", "print_id", F.size("t").alias("n"), F.filter(F.transform("t", lambda x: F.struct(x["duration"].alias("d"), x["fp"].alias("f"))), lambda x: x["d"].isNotNull() & ~F.isnan(x["d"]) & (F.size(x["f"]) == WORDS) & ~F.exists(x["f"], lambda w: w.isNull())).alias("t"))
    half = lambda f, k: f[k].bitwiseAND(F.lit(0xFFFFFFFF))
    fps = F.flatten(F.transform("t.f", lambda f: F.array(*[half(f, 2 * k).bitwiseXOR(F.shiftleft(half(f, 2 * k + 1), 32)) for k in range(WORDS // 2)])))
    one = p.select("sig", "print_id", F.struct("n", F.col("t.d").alias("ds"), fps.alias("fps")).alias("x")).groupBy("sig").agg(F.min_by("x", "print_id").alias("x"))
    return one.where("x.n > 0").select("sig", "x.*")


def unpacked(fps: np.ndarray) -> np.ndarray:
    """The (n, 3) 64-bit words of a row of `lists`."""
    return np.ascontiguousarray(fps, dtype=np.int64).view(np.uint64).reshape(-1, WORDS // 2)


def likeness(f: np.ndarray, common: np.ndarray, step: int = 64) -> np.ndarray:
    """How many of `common` each fingerprint sounds like. Only an order depends on it, so a first word that
    differs by more than its share is taken to tell."""
    out = np.zeros(len(f), np.int64)
    first, there = np.ascontiguousarray(f[:, 0]), np.ascontiguousarray(common[:, 0])
    for i in range(0, len(f), step):
        a, b = np.nonzero(np.bitwise_count(first[i : i + step, None] ^ there) <= MAX_BITS - 4)
        if len(a):
            np.add.at(out, i + a[hamming(f[i + a], common[b]) <= 2 * MAX_BITS], 1)
    return out


def found_pairs(prints: DataFrame, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``signature_a, signature_b`` (a < b) of the recordings whose lists match; each pair once.

    Null signatures, empty lists and unreadable tracks match nothing; copies of one signature count once.
    """
    spark = prints.sparkSession
    recs = cut(lists(prints).withColumn("rid", F.monotonically_increasing_id()))
    total = recs.agg(F.sum(F.size("ds"))).first()[0] or 0
    # bounded sample: the rows of lowest hash of all tracks
    flat = recs.select("sig", F.posexplode("ds").alias("pos", "d"), "fps").select(F.slice("fps", F.col("pos") * (WORDS // 2) + 1, WORDS // 2).alias("f"), F.xxhash64("sig", "pos").alias("h"))
    share = min(1.0, 4.0 * sample / max(1, total))  # thin out by hash before the sort
    got = [r.f for r in flat.where(F.pmod("h", F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy("h").limit(sample).collect()]
    shared = spark.sparkContext.broadcast(({b: compiled(b) for _, b in BANDS}, unpacked(np.array(got, dtype=np.int64))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, common = shared.value
        for df in batches:
            if not len(df):
                continue
            size = df.ds.map(len).to_numpy()
            owner = np.repeat(np.arange(len(df)), size)
            d = np.concatenate(df.ds.to_numpy()).astype(float) if size.sum() else np.zeros(0)
            f = unpacked(np.concatenate(df.fps.to_numpy())) if size.sum() else np.zeros((0, 3), np.uint64)
            # how many of the sample's sounds are like this track
            like = likeness(f, common)
            n = df.n.to_numpy()
            start = np.cumsum(size) - size
            order = np.lexsort((-d, like, owner))
            rank = np.empty(len(d), int)
            rank[order] = np.arange(len(d)) - start[owner[order]]
            # unreadable tracks have no counterpart, so they may fill the prefix first
            first = np.array([k - need(k) + 1 for k in n]) - (n - size)
            query = np.nonzero(rank < first[owner])[0]
            cell = lambda x: np.floor(np.clip(x, -1e15, 1e15) / CELL_SECONDS).astype(np.int64)
            lo, hi = cell(d[query] - MAX_SECONDS - EPS), cell(d[query] + MAX_SECONDS + EPS)
            far = [query[hi >= lo + k] for k in range(3)]  # a ball of 14 s overlaps two cells, three by rounding
            r = np.concatenate([np.arange(len(d)), *far])
            yield pd.DataFrame({
                "cell": np.concatenate([cell(d), *[lo[hi >= lo + k] + k for k in range(3)]]), "is_query": np.arange(len(r)) >= len(d),
                "rid": df.rid.to_numpy()[owner[r]], "n": n[owner[r]].astype(np.int32), "d": d[r], **{f"w{k}": f[r, k].view(np.int64) for k in range(3)},
            })

    placed = recs.select("rid", "n", "ds", "fps").mapInPandas(place, "cell bigint, is_query boolean, rid bigint, n int, d double, w0 bigint, w1 bigint, w2 bigint")
    # a cell beyond the block size is cut: index rows into parts, queries into slices, and each slice meets each part; queries are
    # no more than the tracks of the cell and those beside it, and a third of these as a rule
    sizes = recs.select(F.explode("ds").alias("d")).select(F.floor(F.greatest(F.least("d", F.lit(1e15)), F.lit(-1e15)) / F.lit(CELL_SECONDS)).cast("bigint").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(F.inline(F.array(*[F.struct((F.col("c") + k).alias("cell"), (F.col("n") if not k else F.lit(0)).alias("own"), F.col("n").alias("near")) for k in (-1, 0, 1)])))
    sizes = cut(sizes.groupBy("cell").agg(F.ceil(F.sum("own") / (2 * block)).cast("int").alias("parts"), F.ceil(F.sum("near") / (3 * block)).cast("int").alias("slices")).where("parts > 0"))
    put = placed.join(broadcast_if_small(sizes), "cell")
    own = lambda n: F.pmod(F.xxhash64("rid", "d", "w0"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    put = put.withColumn("part", F.explode(F.when(F.col("is_query"), every("parts")).otherwise(F.array(own("parts")))))
    put = put.withColumn("slice", F.explode(F.when(F.col("is_query"), F.array(own("slices"))).otherwise(every("slices"))))

    def pairs(df: pd.DataFrame) -> pd.DataFrame:
        ask = df.is_query.to_numpy()
        q, x = df[ask], df[~ask]
        if not len(q) or not len(x):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        words = lambda t: np.ascontiguousarray(t[["w0", "w1", "w2"]].to_numpy(np.int64)).view(np.uint64)
        i, j = search(q.d.to_numpy(), words(q), x.d.to_numpy(), words(x), shared.value[0])
        a, b, n, m = q.rid.to_numpy()[i], x.rid.to_numpy()[j], q.n.to_numpy()[i].astype(np.int64), x.n.to_numpy()[j].astype(np.int64)
        # one list's prefix is enough to find a pair
        keep = (a < b) & (np.minimum(n, m) * SHARE_DEN >= SHARE_NUM * np.maximum(n, m))
        return pd.DataFrame({"a": a[keep], "b": b[keep]}).drop_duplicates()

    put = put.select("cell", "part", "slice", "is_query", "rid", "n", "d", "w0", "w1", "w2")
    cand = put.groupBy("cell", "part", "slice").applyInPandas(pairs, "a bigint, b bigint").distinct()
    side = lambda k: recs.select(F.col("rid").alias(k), F.struct("sig", "n", "ds", "fps").alias(f"{k}_l"))
    cand = cand.join(side("a"), "a").join(side("b"), "b")

    @F.pandas_udf("boolean")
    def same(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for n, ds, fps, m, es, gps in zip(a["n"], a["ds"], a["fps"], b["n"], b["ds"], b["fps"]):
            out.append(matches(np.asarray(ds), unpacked(fps), np.asarray(es), unpacked(gps), need(max(n, m))))
        return pd.Series(out, dtype=bool)

    return cand.where(same("a_l", "b_l")).select(F.least("a_l.sig", "b_l.sig").alias("signature_a"), F.greatest("a_l.sig", "b_l.sig").alias("signature_b"))


def groups(prints: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``audio_signature, group_id, links``: every signature with the least signature it is linked to, by components."""
    from ..operators.graph import connected_components

    pairs = cut(found_pairs(prints) if pairs is None else pairs)
    comp = connected_components(pairs, "signature_a", "signature_b")
    links = pairs.select(F.explode(F.array("signature_a", "signature_b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    every = prints.where("audio_signature is not null").select(F.col("audio_signature").alias("node")).distinct()
    return every.join(comp, "node", "left").join(links, "node", "left").select(F.col("node").alias("audio_signature"), F.coalesce("component", "node").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))

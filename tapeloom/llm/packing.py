"""Filling fixed-capacity containers (problem 6): a grouping genetic algorithm on islands.

A chromosome is a set of containers. Crossover injects whole well-filled containers of one parent into the other,
removes the containers that hold their documents a second time, and best-fits the displaced documents, largest first;
mutation empties the worst containers. Fitness is the mean of squared fills.

Documents are dealt by hash into blocks of bounded size. Each block evolves on several islands, one row and task slot
each; after every epoch each island's elite migrates to the next island. A population begins with best fit decreasing; where
that takes no more containers than the sizes sum up to, nothing can be gained and the block is left at it. Only full
containers close; all else goes on to a further round, dealt anew, until one block is left. A round that hardly closes any
loosens what counts as full.

A text is split only if it alone exceeds the capacity: into full containers and one remainder, which is packed.
"""

from __future__ import annotations

import bisect
import itertools
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import TOKENIZER, token_counts

#: Documents of a block; islands of a block; epochs between which elites migrate; population; generations of an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2000, 2, 2, 8, 12
#: Share of the capacity that may stay empty in a container that closes, once a round has closed less than a tenth; doubled
#: with each such round, so that the rounds end.
LOOSE = 0.001
MAX_CAPACITIES = 1000


def best_fit(bins: list[list[int]], room: list[int], items: list[int], size: list[int], cap: int) -> None:
    """Places items, largest first, each into the fullest container that takes it; opens new ones at the end."""
    order = sorted((r, k) for k, r in enumerate(room))
    for i in sorted(items, key=lambda i: -size[i]):
        at = bisect.bisect_left(order, (size[i], -1))
        if at < len(order):
            r, k = order.pop(at)
            bins[k].append(i)
        else:
            r, k = cap, len(bins)
            bins.append([i])
            room.append(cap)
        room[k] = r - size[i]
        bisect.insort(order, (room[k], k))


class Packing:
    __slots__ = ("bins", "room", "fit")

    def __init__(self, bins: list[list[int]], size: list[int], cap: int):
        self.bins = [b for b in bins if b]
        self.room = [cap - sum(size[i] for i in b) for b in self.bins]
        self.fit = sum(((cap - r) / cap) ** 2 for r in self.room) / max(1, len(self.bins))

    @classmethod
    def of(cls, owner: list[int], size: list[int], cap: int) -> Packing:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(owner):
            bins.setdefault(b, []).append(i)
        return cls(list(bins.values()), size, cap)

    def owners(self, n: int) -> list[int]:
        out = [0] * n
        for k, b in enumerate(self.bins):
            for i in b:
                out[i] = k
        return out


def start(rng: random.Random, size: list[int], cap: int) -> Packing:
    """Best fit over sizes shaken a little, so that a population differs."""
    bins: list[list[int]] = []
    room: list[int] = []
    shaken = [int(s * rng.uniform(0.9, 1.1)) for s in size]
    order = sorted((r, k) for k, r in enumerate(room))
    for i in sorted(range(len(size)), key=lambda i: -shaken[i]):
        at = bisect.bisect_left(order, (size[i], -1))
        if at < len(order):
            r, k = order.pop(at)
            bins[k].append(i)
        else:
            r, k = cap, len(bins)
            bins.append([i])
            room.append(cap)
        room[k] = r - size[i]
        bisect.insort(order, (room[k], k))
    return Packing(bins, size, cap)


def cross(rng: random.Random, a: Packing, b: Packing, size: list[int], cap: int) -> Packing:
    """Well-filled containers of b go into a; a's containers that share documents with them are dissolved."""
    ranked = sorted(range(len(b.bins)), key=lambda k: (b.room[k], rng.random()))
    top = max(1, len(ranked) // 2)
    take = rng.sample(ranked[:top], max(1, int(top * rng.uniform(0.3, 0.8))))
    held = {i for k in take for i in b.bins[k]}
    bins = [list(b.bins[k]) for k in take]
    room = [b.room[k] for k in take]
    loose: list[int] = []
    rest = []
    for k, c in enumerate(a.bins):
        if held.isdisjoint(c):
            rest.append(k)
        else:
            loose += [i for i in c if i not in held]
    # mutation: the worst of what is left is dissolved as well
    rest.sort(key=lambda k: a.room[k])
    for k in rest[: len(rest) - rng.randint(0, min(3, len(rest)))]:
        bins.append(list(a.bins[k]))
        room.append(a.room[k])
    gone = {i for c in bins for i in c}
    loose += [i for k in rest for i in a.bins[k] if i not in gone]
    best_fit(bins, room, list(set(loose)), size, cap)
    return Packing(bins, size, cap)


def evolve(size: list[int], cap: int, elites: list[list[int]], seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
    """One epoch on one island, from given elites (owners per item) and fresh packings."""
    rng = random.Random(seed)
    pop = [Packing.of(o, size, cap) for o in elites]
    if not pop:
        best_fit(bins := [], [], list(range(len(size))), size, cap)
        pop = [Packing(bins, size, cap)]
    least = max(1, -(-sum(size) // cap))
    if any(len(p.bins) <= least for p in pop):
        return max(pop, key=lambda p: (-len(p.bins), p.fit))
    while len(pop) < population:
        pop.append(start(rng, size, cap))
    for _ in range(generations):
        pop.sort(key=lambda p: (len(p.bins), -p.fit))
        if len(pop[0].bins) <= least:
            break
        half = pop[: max(2, population // 2)]
        pop = half + [cross(rng, *rng.sample(half, 2), size, cap) for _ in range(population - len(half))]
    return max(pop, key=lambda p: (-len(p.bins), p.fit))


def items(docs: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``pack_id, capacity, doc_id, part, tokens``: whole documents, or the full parts and the remainder of too long ones."""
    caps = capacities.where("capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(caps) > MAX_CAPACITIES:
        raise ValueError("too many capacities")
    each = [F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in sorted(map(tuple, caps))]
    sized = cut(token_counts(docs, tokenizer=tokenizer))
    rows = sized.select("*", F.inline(F.array(*each) if each else F.array().cast("array<struct<pack_id:int,capacity:bigint>>")))
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    parts = F.when(F.col("tokens") <= F.col("capacity"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.when(F.col("tokens") % F.col("capacity") == 0, full - 1).otherwise(full)))
    rows = rows.withColumn("part", F.explode(parts))
    return rows.select("pack_id", "capacity", "doc_id", "part", F.least(F.col("capacity"), F.col("tokens") - F.col("part") * F.col("capacity")).alias("tokens"))


def _round(rows: DataFrame, plan: DataFrame, k: int, islands: int, epochs: int) -> DataFrame:
    """``pack_id, capacity, blocks, slack, blk, items, owner`` per block: the best packing of its islands.

    `plan`: ``pack_id, blocks, slack``, a row per capacity."""
    dealt = rows.join(F.broadcast(plan), "pack_id").withColumn("blk", F.pmod(F.xxhash64("doc_id", "part", F.lit(k)), F.col("blocks")))
    blocks = dealt.groupBy("pack_id", "capacity", "blocks", "slack", "blk").agg(F.sort_array(F.collect_list(F.struct("doc_id", "part", "tokens"))).alias("items"))
    blocks = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.array().cast("array<array<int>>")).withColumn("fit", F.lit(0.0)).select("pack_id", "capacity", "blocks", "slack", "blk", "items", "island", "elites", "fit")
    schema = "pack_id int, capacity bigint, blocks bigint, slack double, blk bigint, items array<struct<doc_id:bigint,part:int,tokens:bigint>>, island int, elites array<array<int>>, fit double"

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                best, fits = [], []
                for pack, cap, blk, its, island, elites in zip(df.pack_id, df.capacity, df.blk, df["items"], df.island, df.elites):
                    size = [int(i["tokens"]) for i in its]
                    p = evolve(size, int(cap), [list(map(int, e)) for e in elites], hash((int(pack), int(blk), int(island), number, k)))
                    best.append([p.owners(len(size))])
                    fits.append(p.fit)
                df = df.copy()
                df["elites"], df["fit"] = best, fits
                yield df

        return run

    slots = max(blocks.sparkSession.sparkContext.defaultParallelism, 8)
    for e in range(epochs):
        # each island is one row: spread rows over tasks, not blocks over partitions by size
        blocks = cut(blocks.repartition(slots * 4, "pack_id", "blk", "island").mapInPandas(epoch(e), schema))
        if e + 1 < epochs:  # migration: an island starts the next epoch from its own elite and its neighbour's
            guest = blocks.select("pack_id", "blk", ((F.col("island") + 1) % islands).alias("island"), F.col("elites").alias("guests"))
            blocks = blocks.join(guest, ["pack_id", "blk", "island"]).withColumn("elites", F.array_distinct(F.concat("elites", "guests"))).select(*[c.split()[0] for c in ("pack_id", "capacity", "blocks", "slack", "blk", "items", "island", "elites", "fit")])
    best = blocks.groupBy("pack_id", "blk").agg(F.max_by(F.struct("capacity", "blocks", "slack", "items", F.col("elites")[0].alias("owner")), F.struct(-F.array_max(F.col("elites")[0]), "fit", -F.col("island"))).alias("b"))
    return best.select("pack_id", "blk", "b.*")


def pack(docs: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``pack_id, bin, doc_id, part, tokens``: every document with a text once per capacity, each container within it.

    Empty texts take no room but do get a container. No documents or no capacities give no rows.
    """
    rows = cut(items(docs, capacities, tokenizer))
    whole = rows.where("tokens = capacity")  # fills a container by itself
    done = whole.select("pack_id", F.concat_ws("-", F.lit("full"), "doc_id", "part").alias("bin"), "doc_id", "part", "tokens")
    left = rows.where("tokens < capacity")
    before: dict[int, tuple[int, float]] = {}
    for k in itertools.count():
        counts = {r[0]: r[1] for r in left.groupBy("pack_id").agg(F.count(F.lit(1))).collect()}  # a row per capacity
        if not counts:
            return done
        for p, n in counts.items():
            was, slack = before.get(p, (0, 0.0))
            before[p] = (n, max(LOOSE, 2 * slack) if was and n > 0.9 * was else slack)
        plan = docs.sparkSession.createDataFrame([(p, -(-n // block), before[p][1]) for p, n in counts.items()], "pack_id int, blocks bigint, slack double")
        best = _round(left, plan, k, islands, epochs)
        placed = best.select("pack_id", "capacity", "blocks", "slack", "blk", F.posexplode("items").alias("pos", "i"), "owner").select("pack_id", "capacity", "blocks", "slack", "blk", "i.*", F.element_at("owner", F.col("pos") + 1).alias("b"))
        fill = placed.groupBy("pack_id", "capacity", "blocks", "slack", "blk", "b").agg(F.sum("tokens").alias("fill"), F.collect_list(F.struct("doc_id", "part", "tokens")).alias("its"))
        fill = cut(fill.withColumn("closed", (F.col("blocks") <= 1) | (F.col("capacity") - F.col("fill") <= F.floor(F.col("capacity") * F.col("slack")))))
        done = done.unionAll(fill.where("closed").select("pack_id", F.concat_ws("-", F.lit(k), "blk", "b").alias("bin"), F.inline("its")).select("pack_id", "bin", "doc_id", "part", "tokens"))
        left = fill.where("not closed").select("pack_id", "capacity", F.inline("its"))


def report(docs: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``pack_id, capacity_tokens, bins, least_bins, tokens, fill``: how full the containers are, and the fewest that could do."""
    made = pack(docs, capacities, tokenizer)
    sums = made.groupBy("pack_id").agg(F.countDistinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    return sums.join(capacities, "pack_id").select("pack_id", "capacity_tokens", "bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("bigint").alias("least_bins"), "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("fill"))

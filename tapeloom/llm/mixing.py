"""Mixing sources to target weights (problem 7): a time-varying curriculum.

Every source has a schedule of weights over training time t in [0, 1]. Its integral is the source's cumulative token
demand D(t); a document copy that begins after x of its source's tokens is wanted when D(t) = x, so its training
position is the inverse of D at its middle token. Documents are range-sorted by that position.

A source's demand is its target share of the total, at most ``max_repeats`` times what it has; what capped sources
cannot give is spread over the others in proportion to their targets. Prefix sums of tokens run in levels (buckets of
buckets, buckets, rows of a bucket), so neither a source, however large, nor its buckets are sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut
from .tokens import TOKENIZER, token_counts

#: Rows of a bucket at each level of the sums; target sources the driver may hold; steepest default schedule.
BUCKET_ROWS, MAX_SOURCES, STEEPEST = 2000, 10_000, 0.6


def demands(have: Mapping[str, int], targets: list[tuple[str, float, int]], total: int) -> dict[str, float]:
    """Tokens wanted of each source: target share of `total`, capped, the rest spread over the uncapped."""
    cap = {s: float(have.get(s, 0)) * max(0, r or 0) for s, _, r in targets}
    want = {s: 0.0 for s in cap}
    open_, left = {s: w for s, w, _ in targets if w and w > 0 and cap[s] > 0}, float(total)
    while open_ and left > 1e-9:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if want[s] + left * w / weight >= cap[s]]
        if not full:
            for s, w in open_.items():
                want[s] += left * w / weight
            break
        for s in full:
            left -= cap[s] - want[s]
            want[s] = cap[s]
            del open_[s]
        # the rest share what is left afresh, so that they keep the proportion of their targets
        left += sum(want[s] for s in open_)
        want |= dict.fromkeys(open_, 0.0)
    return want


def slopes(want: Mapping[str, float], lean: Mapping[str, float] | None = None) -> dict[str, float]:
    """Slope a of each source's schedule, weight(t) = share * (1 + a (1 - 2t)), such that the weights always sum to 1.

    `lean`: early (positive) or late (negative) preference per source; by default larger sources lean early.
    """
    used = {s: d for s, d in want.items() if d > 0}
    if len(used) < 2:
        return dict.fromkeys(want, 0.0)
    order = sorted(used, key=lambda s: (-used[s], s))
    x = {s: (lean or {}).get(s, 0.0) if lean is not None else 1 - 2 * order.index(s) / (len(order) - 1) for s in used}
    mean = sum(used[s] * x[s] for s in used) / sum(used.values())
    x = {s: v - mean for s, v in x.items()}
    top = max(map(abs, x.values())) or 1.0
    return {s: x.get(s, 0.0) / top * STEEPEST for s in want}


def arrival(y: Column, a: Column) -> Column:
    """t with t + a (t - t^2) = y, the inverse of the cumulative share."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + a) * (1 + a) - 4 * a * y))
    return F.when(F.abs(a) < 1e-9, y).otherwise(2 * y / ((1 + a) + root))


def running(df: DataFrame, group: list[str], bucket: Column, buckets: int, order: list[str], value: str, out: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Exclusive prefix sums of `value` per group in the order of (bucket, order). `bucket` counts from 0 to below `buckets` and
    must follow the order. The sums of the buckets are summed up in the same way, level by level, until at most `rows` are
    left of a group, so no window ever holds more than a bucket's rows."""
    b = df.withColumn("_bucket", bucket)
    sums = b.groupBy(*group, "_bucket").agg(F.sum(value).alias("_s"))
    if buckets > rows:
        base = running(sums.withColumnRenamed("_bucket", "_below"), group, F.floor(F.col("_below") / rows), -(-buckets // rows), ["_below"], "_s", "_sum", rows)
        base = base.select(*group, F.col("_below").alias("_bucket"), F.col("_sum").alias("_base"))
    else:
        base = sums.select(*group, "_bucket", (F.sum("_s").over(Window.partitionBy(*group or [F.lit(0)]).orderBy("_bucket")) - F.col("_s")).alias("_base"))
    w = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return b.join(broadcast_if_small(cut(base)), [*group, "_bucket"]).withColumn(out, F.col("_base") + F.sum(value).over(w) - F.col(value)).drop("_bucket", "_base")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, lean: Mapping[str, float] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``position, doc_id, copy, source, tokens, at``: the training order, positions from 0, `at` in [0, 1].

    ``total_tokens`` is by default all tokens of the target sources. Documents of no target source, of null source or
    without tokens are not used. A source that is not there gives nothing. Ends of demand are rounded to whole
    documents: a copy is taken if its middle lies within the demand.
    """
    want, sized, have = _plan(docs, targets, total_tokens, tokenizer)
    spark = docs.sparkSession
    a = slopes(want, lean)
    reps = {r[0]: r[2] for r in _targets(targets)}
    plan = [(s, float(d), float(a[s]), int(have[s]), int(reps[s] or 0)) for s, d in want.items() if d > 0]
    plan = F.broadcast(spark.createDataFrame(plan, "source string, want double, lean double, have bigint, most int"))  # at most MAX_SOURCES rows
    n = sized.count()
    buckets = max(1, n // BUCKET_ROWS)
    h = sized.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 33))
    bucket = F.floor(F.col("h") * F.lit(float(buckets)) / F.lit(float(1 << 31))).cast("bigint")
    run = running(h, ["source"], bucket, buckets, ["h", "doc_id"], "tokens", "before")
    rows = run.join(plan, "source").withColumn("passes", F.least(F.col("most"), F.ceil(F.col("want") / F.col("have")).cast("int")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.col("passes"), F.lit(1)) - 1)))
    middle = F.col("copy") * F.col("have") + F.col("before") + F.col("tokens") / 2
    rows = rows.withColumn("x", middle).where((F.col("x") <= F.col("want")) & (F.col("copy") < F.col("most")))
    rows = rows.withColumn("at", F.least(F.lit(1.0), arrival(F.col("x") / F.col("want"), F.col("lean"))))
    rows = cut(rows.select("doc_id", "copy", "source", "tokens", "at"))
    steps = max(1, rows.count() // BUCKET_ROWS)
    rows = running(rows.withColumn("one", F.lit(1).cast("bigint")), [], F.floor(F.col("at") * steps), steps + 1, ["at", "doc_id", "copy"], "one", "position")
    return rows.select("position", "doc_id", "copy", "source", "tokens", "at").orderBy("position")


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(t) > MAX_SOURCES:
        raise ValueError("too many sources")
    return sorted((r[0], float(r[1] or 0), int(r[2] or 0)) for r in t)


def _plan(docs: DataFrame, targets: DataFrame, total_tokens: int | None, tokenizer: str) -> tuple[dict[str, float], DataFrame, dict[str, int]]:
    t = _targets(targets)
    spark = docs.sparkSession
    names = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in t] or [("",)], "source string"))
    sized = cut(token_counts(docs.join(names, "source", "left_semi"), "source", tokenizer=tokenizer).where("tokens > 0"))
    have = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("tokens")).collect()}
    return demands(have, t, total_tokens or sum(have.values())), sized, have


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents, most_uses, capped`` of each target, of the mix as made."""
    made = cut(mix(docs, targets, total_tokens, tokenizer=tokenizer))
    used = made.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), (F.max("copy") + 1).alias("most_uses"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = t.join(F.broadcast(used), "source", "left").withColumn("total", F.sum("tokens").over(Window.partitionBy()))  # a row per source
    z = lambda c: F.coalesce(c, F.lit(0))
    return out.select("source", "target_share", (z("tokens") / F.col("total")).alias("actual_share"), z("tokens").alias("tokens"), z("documents").alias("documents"), z("most_uses").alias("most_uses"), (z("tokens") < F.col("target_share") * F.col("total") * 0.999).alias("capped"))

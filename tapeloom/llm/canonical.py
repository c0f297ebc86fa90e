"""Free-typed values to a reference list (problem 5): symmetric-delete dictionary.

The identifying words of every reference entry go, with all their shortenings by up to k letters, into a dictionary
from shortened word to entries. A typed value's words are shortened likewise and looked up; entries met are ranked by a
weighted Damerau-Levenshtein cost of all words (slips of neighbouring keys, vowels and doubled letters cost less), then
by how often the entry's own spelling occurs. No entry within the cost allowed: the value is reported as unmatched.

While the reference list is proven small (``MAX_REFERENCE`` entries, counted first), the dictionary is built once and
broadcast. Beyond that, values and entries meet in an equi-join on their shortened words, and the entries that a value met
are ranked with a dictionary of their own: the same entries in the same order, whatever the list's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, spread
from .names import PLACE_SHORT, Name, edits, fold, is_filler, same_word, slack, sound, words

#: Reference entries whose dictionary is broadcast: about 1,000 shortened words of some 40 bytes each, so 80 MB at most.
MAX_REFERENCE = 2_000
DELETES = 3
#: Longer words are no names: they are looked up whole.
LONGEST = 48
MEMO = 300_000
ROWS = {c: (r, k) for r, line in enumerate(("qwertyuiop", "asdfghjkl", "zxcvbnm")) for k, c in enumerate(line)}
VOWELS = set("aeiou")


def shortened(word: str, k: int) -> set[str]:
    """`word`, and what it sounds like, with up to k letters left out; k is bounded by the length of the longer word it may stand for."""
    k = min(k, slack(len(word) + 1)) if len(word) <= LONGEST else 0
    out: set[str] = set()
    for w in {word, sound(word)}:
        out.add(w)
        last = {w}
        for _ in range(min(k, len(w))):
            last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
            out |= last
    return out


def weighted(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein with weights: neighbouring keys and vowels 0.8, swaps 0.9, doubled letters 0.5, others 1."""
    if a == b:
        return 0.0
    if edits(a, b, int(most / 0.5) if most < 2 else 4) > 4:
        return most + 1

    def sub(x: str, y: str) -> float:
        if x in VOWELS and y in VOWELS:
            return 0.8
        p, q = ROWS.get(x), ROWS.get(y)
        return 0.8 if p and q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 else 1.0

    n, m = len(a), len(b)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    gap = lambda s, i: 0.5 if i and s[i] == s[i - 1] else 1.0
    for i in range(1, n + 1):
        d[i][0] = d[i - 1][0] + 1
    for j in range(1, m + 1):
        d[0][j] = d[0][j - 1] + 1
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = a[i - 1] == b[j - 1]
            c = min(d[i - 1][j - 1] + (0 if same else sub(a[i - 1], b[j - 1])), d[i - 1][j] + gap(a, i - 1), d[i][j - 1] + gap(b, j - 1))
            if i > 1 and j > 1 and not same and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, d[i - 2][j - 2] + 0.9)
            d[i][j] = c
    return d[n][m]


def word_cost(a: str, b: str) -> float:
    """Cost of reading `a` for `b`; sound-alike spellings count as little."""
    most = slack(max(len(a), len(b)))
    c = weighted(a, b, most)
    s, t = sound(a), sound(b)
    return min(c, 0.3 + weighted(s, t, most)) if (s, t) != (a, b) else c


class Lookup:
    """A symmetric-delete dictionary over entries ``(id, text, place)``; place: region or city name, may be None."""

    def __init__(self, entries: list[tuple[int, str, str | None]], kind: str, frequency: dict[int, int] | None = None):
        self.kind, self.freq = kind, frequency or {}
        self.entries: dict[int, tuple] = {}
        self.by: dict[str, set[int]] = {}
        self.memo: dict[str, list] = {}
        self.given = {i: (text, place) for i, text, place in entries}
        for i, text, place in entries:
            if text is None or is_filler(text):
                continue
            key, extra = self.read(text)
            if not key:
                continue
            self.entries[i] = (key, extra, place, fold(text))
            for w in self.spellings(text, key, extra):
                for s in shortened(w, DELETES):
                    self.by.setdefault(s, set()).add(i)

    def read(self, text: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(identifying words, kind-of-venue words or place words)."""
        if self.kind == "venue":
            n = Name(text, "venue")
            return tuple(w for w, _ in n.rest), n.types
        s = re.sub(r"^\s*(?:in|at|@)\s+", "", fold(text))
        ws = [PLACE_SHORT.get(w, w) if len(w) <= 4 and (d or w not in ("n", "s", "no")) else w for w, d in words(s)]
        ws = [w for w in ws if w]
        own = [w for w in ws if not place_word(w)] or ws
        long = max(own, key=len, default="")
        return ((long,), tuple(w for w in ws if w != long)) if long else ((), ())

    def spellings(self, text: str, key: tuple, extra: tuple) -> set[str]:
        """The words under which an entry stands; a city also as one word, in the order of its text, in full and as it is."""
        out = {*key, "".join(key)}
        if self.kind == "city":
            left = [*key, *extra]
            own = [w for w, _ in words(re.sub(r"^\s*(?:in|at|@)\s+", "", fold(text)))]
            full = [w if w in left else PLACE_SHORT.get(w, w) for w in own]
            out |= {"".join(left), "".join(own), "".join(full)}
        return out - {""}

    def ids(self, words: set[str], k: int) -> set[int]:
        """Every entry one of whose words is within k edits of one of `words`."""
        out: set[int] = set()
        by = self.by
        for w in words:
            for s in shortened(w, k):
                if s in by:
                    out |= by[s]
        return out

    def cost(self, value: str, key: tuple, extra: tuple, i: int) -> float:
        """Cost of `value` for entry i; 9 or more: no."""
        rkey, rextra, place, rtext = self.entries[i]
        if self.kind == "venue":
            if not key:
                return 9.0
            a, b = "".join(key), "".join(rkey)
            c = word_cost(a, b)
            if c > slack(max(len(a), len(b))) * 1.0:
                return 9.0
            if not extra:
                return c + 0.6
            x, y = sorted(extra), sorted(rextra)
            if x == y:
                return c
            if set(x) <= set(y) or set(y) <= set(x):
                return c + 0.4
            if len(x) == len(y) and all(edits(u, v, 2) <= 2 for u, v in zip(x, y)):
                return c + 0.5
            return 9.0
        a, b = key[0], rkey[0]
        best = word_cost(a, b)
        left = list(extra)
        squash = fold(value).replace(" ", "").replace("-", "").replace(".", "")
        whole = "".join(w for w, _ in words(rtext))
        if best > slack(max(len(a), len(b))):
            c = word_cost(squash, whole)
            return c if c <= min(2, slack(len(whole))) else 9.0
        for w in rextra:  # each place word of the entry must stand in the value, more or less
            hit = next((v for v in left if v == w or (len(w) > 2 and len(v) > 1 and same_word(v, False, w, False)) or (len(v) <= 3 and w.startswith(v))), None)
            if hit is None:
                if len(w) > 2:
                    best += 0.8
            else:
                left.remove(hit)
                best += 0.2 * (hit != w)
        for v in left:  # more words: the region, a country, fillers; else another place's name
            if place and (v in fold(place).split() or v == fold(place)):
                best -= 0.3
            elif v in PLACE_WORDS or (len(v) > 2 and any(same_word(v, False, p, False) for p in PLACE_WORDS)):
                best += 1.5
            else:
                best += 0.3
        return best

    def tries(self, value: str) -> list[str]:
        """The readings of a value: what follows a city's comma or stands in brackets is the region, unless nothing is found."""
        head = re.split(r"[,(\[/]| - ", value)[0].strip() if self.kind == "city" else ""
        return [value, head] if head and head != value else [value]

    def asked(self, text: str, key: tuple, extra: tuple, k: int) -> set[str]:
        """The words that a value is looked up by at k letters left out."""
        out = {*key, "".join(key)}
        if self.kind == "city" and k >= 2:
            out |= {"".join([*key, *extra]), "".join(w for w, _ in words(fold(text)))}
        return out

    def find(self, value: str | None) -> list[tuple[float, int]]:
        """(cost, entry) of all entries within the cost allowed, best first."""
        got = self.memo.get(value)
        if got is not None:
            return got
        out: list[tuple[float, int]] = []
        if not is_filler(value):
            for t in self.tries(value):
                key, extra = self.read(t)
                if not key:
                    continue
                most = 3.0 if len("".join(key)) > 7 else 2.2
                seen: set[int] = set()
                for k in range(DELETES + 1):  # near entries first: one within k edits ends the search if no farther one can beat it
                    for i in self.ids(self.asked(t, key, extra, k), k) - seen:
                        seen.add(i)
                        c = self.cost(t, key, extra, i)
                        if c <= most:
                            out.append((round(c, 3), i))
                    if out and min(out)[0] <= 0.5 * (k + 1):
                        break
                if out:
                    break
            out.sort(key=lambda x: (x[0], -self.freq.get(x[1], 0), x[1]))
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[value] = out
        return out


#: Words that tell one place from another of the same main word.
PLACE_WORDS = ("north", "south", "east", "west", "new", "old", "fort", "port", "mount", "saint", "san", "santa", "bad", "den", "monte", "lower", "upper", "springs", "falls", "chateau", "hills", "beach", "lake", "grove")


@lru_cache(200_000)
def place_word(w: str) -> bool:
    return w in PLACE_WORDS or any(len(p) >= 4 and len(w) >= 4 and edits(w, p, 2) <= (1 if len(p) <= 5 else 2) for p in PLACE_WORDS)


def near_text(region: str | None, place: str | None) -> bool:
    return bool(region and place) and (fold(region) == fold(place))


HITS = "array<struct<cost:double,id:bigint,text:string,place:string>>"
#: Entries that cost so much more than the best one may still be meant, if their names are the same.
TIE = 0.31


def _hits(look: Lookup, value: str) -> list[dict]:
    got = look.find(value)
    return [{"cost": c, "id": i, "text": look.given[i][0], "place": look.given[i][1]} for c, i in got if c <= got[0][0] + TIE]


def answers(values: DataFrame, ref: DataFrame, kind: str, most: int = MAX_REFERENCE) -> DataFrame:
    """``value, hits`` of the distinct strings `value`: the best entries of ``ref(ref_id, text, place, freq)``, best first.

    `ref` may have any size: at most `most` entries are a broadcast dictionary, more are joined."""
    entries = ref.where("ref_id is not null and text is not null").select("ref_id", "text", "place", "freq").groupBy("ref_id").agg(F.min(F.struct("text", "place", "freq")).alias("e")).select("ref_id", "e.*")
    entries = cut(entries)
    got = entries.limit(most + 1).collect()
    vals = values.select("value").where("value is not null").distinct()
    if len(got) <= most:
        got.sort()
        shared = values.sparkSession.sparkContext.broadcast(Lookup([(i, t, p) for i, t, p, _ in got], kind, {i: n or 0 for i, _, _, n in got}))

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            look = shared.value
            for df in batches:
                yield pd.DataFrame({"value": df.value, "hits": [_hits(look, v) for v in df.value]})

        return spread(vals).mapInPandas(ask, f"value string, hits {HITS}")

    def of_value(reader: Lookup, t: str) -> set[str]:
        read = [(x, *reader.read(x)) for x in ([] if is_filler(t) else reader.tries(t))]
        return {w for x, key, extra in read if key for w in reader.asked(x, key, extra, DELETES)}

    def of_entry(reader: Lookup, t: str) -> set[str]:
        key, extra = reader.read(t) if not is_filler(t) else ((), ())
        return reader.spellings(t, key, extra) if key else set()

    def keys(of):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = Lookup([], kind)
            for df in batches:
                out = [(t, s) for t in df.text for s in set().union(*(shortened(w, DELETES) for w in of(reader, t))) if s]
                yield pd.DataFrame(out, columns=["text", "key"])

        return run

    left = spread(vals.select(F.col("value").alias("text"))).mapInPandas(keys(of_value), "text string, key string").select(F.col("text").alias("value"), "key")
    right = spread(entries.select("text").distinct()).mapInPandas(keys(of_entry), "text string, key string")
    met = left.join(right, "key").select("value", "text").distinct().join(entries, "text")
    # a value's entries: those within a few letters of it, however many rows hold the value
    met = met.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("ref_id", "text", "place", "freq"))).alias("es"))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [_hits(Lookup([(e["ref_id"], e["text"], e["place"]) for e in es], kind, {e["ref_id"]: e["freq"] or 0 for e in es}), v) for v, es in zip(df.value, df.es)]
            yield pd.DataFrame({"value": df.value, "hits": found})

    ranked = met.mapInPandas(rank, f"value string, hits {HITS}")
    return vals.join(ranked, "value", "left").select("value", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def resolve(rows: DataFrame, venue_ref: DataFrame, city_ref: DataFrame, most: int = MAX_REFERENCE) -> DataFrame:
    """``table_name, row_id, field_name, value, ref_id, cost`` for rows of ``table_name, row_id, venue, city, region``.

    `venue_ref(venue_id, venue, city_id)`, `city_ref(city_id, city, region)`. Blank values give no row; fillers and misses give
    -1. Of cities that cost the same, the one in the row's region is meant, else the one that the value itself tells, else
    the one where the row's venue stands, else the more frequent, else the lower id. Each distinct string is looked up once;
    rows join the answers, which are broadcast only when counted small.
    """
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)\s", "") == "", F.lit(True))
    v_rows = rows.where(~blank("venue")).select("table_name", "row_id", "venue")
    c_rows = rows.where(~blank("city")).select("table_name", "row_id", "venue", "city", F.coalesce("region", F.lit("")).alias("region"))

    def with_freq(ref: DataFrame, text: str, used: DataFrame) -> DataFrame:
        """How often each entry's own spelling occurs."""
        own = broadcast_if_small(ref.select(F.col(text).alias("value")).where("value is not null").distinct())
        n = used.join(own, "value").groupBy("value").agg(F.count(F.lit(1)).alias("freq"))
        return ref.join(broadcast_if_small(n), ref[text] == n["value"], "left").drop("value")

    vr = with_freq(venue_ref.select("venue_id", "venue", "city_id"), "venue", v_rows.select(F.col("venue").alias("value")))
    cr = with_freq(city_ref.select("city_id", "city", "region"), "city", c_rows.select(F.col("city").alias("value")))
    v_ask = cut(answers(v_rows.select(F.col("venue").alias("value")), vr.select(F.col("venue_id").alias("ref_id"), F.col("venue").alias("text"), F.lit(None).cast("string").alias("place"), "freq"), "venue", most))
    c_ask = cut(answers(c_rows.select(F.col("city").alias("value")), cr.select(F.col("city_id").alias("ref_id"), F.col("city").alias("text"), F.col("region").alias("place"), "freq"), "city", most))

    first = F.try_element_at("hits", F.lit(1))
    at = venue_ref.where("venue_id is not null").groupBy(F.col("venue_id").alias("ref_id")).agg(F.min("city_id").alias("at"))
    v_ask = v_ask.select(F.col("value").alias("venue"), F.coalesce(first["id"], F.lit(-1)).alias("ref_id"), first["cost"].alias("cost"))
    v_ask = v_ask.join(broadcast_if_small(at), "ref_id", "left")
    of_venue = v_rows.join(broadcast_if_small(v_ask.select("venue", "ref_id", "cost")), "venue").select("table_name", "row_id", F.lit("venue").alias("field_name"), F.col("venue").alias("value"), "ref_id", "cost")

    @F.pandas_udf("array<bigint>")
    def meant(city: pd.Series, region: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for c, r, hs in zip(city, region, hits):
            same = [h for h in hs if fold(h["text"]) == fold(hs[0]["text"])]
            if len(same) > 1:
                by_region = [h for h in same if near_text(r, h["place"])]
                named = [h for h in same if h["place"] and re.search(rf"\b{re.escape(fold(h['place']))}\b", fold(c))]
                same = by_region or named or same
            out.append([h["id"] for h in same])
        return pd.Series(out)

    met = c_rows.join(broadcast_if_small(c_ask.withColumnRenamed("value", "city")), "city").withColumn("cost", first["cost"])
    clear = met.where(F.size("hits") <= 1).select("table_name", "row_id", F.col("city").alias("value"), F.coalesce(first["id"], F.lit(-1)).alias("ref_id"), "cost")
    tied = met.where(F.size("hits") > 1).withColumn("ids", meant("city", "region", "hits")).join(broadcast_if_small(v_ask.where("at is not null").select("venue", "at")), "venue", "left")
    tied = tied.select("table_name", "row_id", F.col("city").alias("value"), F.when(F.array_contains("ids", F.col("at")), F.col("at")).otherwise(F.element_at("ids", 1)).alias("ref_id"), "cost")
    of_city = clear.unionAll(tied).select("table_name", "row_id", F.lit("city").alias("field_name"), "value", "ref_id", "cost")
    return of_venue.unionAll(of_city)


def found(concerts: DataFrame, lexicon: DataFrame, starter: DataFrame, venue_ref: DataFrame, city_ref: DataFrame, most: int = MAX_REFERENCE) -> DataFrame:
    """``table_name, row_id, field_name, ref_id``: each non-blank venue and city with its entry, -1 if none."""
    rows = concerts.select(F.lit("concerts").alias("table_name"), F.col("concert_id").alias("row_id"), "venue", "city", "region")
    for t, df in (("lexicon", lexicon), ("starter_lexicon", starter)):
        rows = rows.unionAll(df.where("kind = 'venue'").select(F.lit(t), F.col("entry_id"), "name", F.lit(None).cast("string"), F.lit(None).cast("string")))
    return resolve(rows, venue_ref, city_ref, most).select("table_name", "row_id", "field_name", "ref_id")

"""Text decoded with a wrong encoding (problem 4): EM with a latent encoding chain per word.

Every word with a non-ASCII character was, unseen, clean text that went through one chain: written in encoding X, read
in encoding Y (perhaps twice), or through none. Given a chain the clean text follows by inversion, so the likelihood of
a word under a chain is that of the restored text under a character model. EM estimates three things together from all
records: the character model of clean text, the share of each chain per field, and, shrunk towards that, per source and
field, so that a source which garbles one way lends its weak cases that evidence. A record is repaired by the chain of
highest posterior in each of its words. Replacement characters say for certain that a word is garbled, and that it
cannot be restored.

The E-step runs over distinct words with counts, not over records. What the driver gathers of it is pairs of a cell and a
number, and the cells are fixed, whatever the data's size: ``BIGRAMS`` + ``UNIGRAMS`` hashed character cells, fields x chains,
and fields x ``SOURCES`` x chains, 1.3 million at the very most (20 MB), some ten per source in use. Sources (the artists'
directories) are hashed into as many; of more, some share their evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

#: Bounds of the model: hashed cells of character pairs, characters, sources.
BIGRAMS, UNIGRAMS, SOURCES = 1 << 16, 1 << 12, 1 << 12
FIELDS = ("folder", "info_txt", "title")
ROUNDS, SHRINK, SMOOTH = 4, 40.0, 2.0
#: Encodings text is written in, and wrongly read in.
WRITTEN = ("utf-8", "cp1252", "cp1251", "koi8_r", "cp932", "mac_roman", "cp1250", "cp437", "cp850")
READ = ("cp1252", "latin_1", "cp437", "cp850", "cp1251", "mac_roman", "cp1250", "koi8_r", "iso8859_2", "cp866")
TWICE = ("cp1252", "latin_1", "cp437", "cp1251", "mac_roman")
CHAINS: list[tuple] = [(), *((x, y, 1) for x in WRITTEN for y in READ if x != y), *(("utf-8", y, 2) for y in TWICE)]
LOST = len(CHAINS)  # the last state: characters were replaced, nothing can be restored
NAMES = ["clean", *(f"{x}>{y}" + "x2" * (n == 2) for x, y, n in CHAINS[1:]), "lost"]
BREAK = re.compile(r"([ \t\r\n\f/]+)")
HIGH = re.compile(r"[^\x00-\x7f]+")
#: No clean text holds these: control characters, line graphics, characters for private use.
NO_TEXT = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\u2500-\u259f\ue000-\uf8ff]")
CONTROL = re.compile("[\x80-\x9f]")
FAR = 35.0  # readings less likely by so many nats than the best cannot win: no prior makes up for it
NEVER = 60.0  # nats against a control character in clean text


@lru_cache(None)
def codepage(y: str) -> dict[str, int]:
    """Character to byte; bytes a code page leaves undefined pass through as control characters."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(y)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def undo(text: str, x: str, y: str) -> str | None:
    """The text before it was written in `x` and read in `y`; None if it cannot have been."""
    t = codepage(y)
    try:
        return bytes([t[c] for c in text]).decode(x)
    except (KeyError, UnicodeDecodeError):
        pass
    if x != "utf-8":
        return None
    hit = False

    def one(m: re.Match) -> str:  # clean and garbled characters in one word: repair the runs that can be
        nonlocal hit
        try:
            r = bytes([t[c] for c in m[0]]).decode(x)
        except (KeyError, UnicodeDecodeError):
            return m[0]
        hit = hit or r != m[0]
        return r

    r = HIGH.sub(one, text)
    return r if hit else None


def restore(word: str, chain: int) -> str | None:
    x, y, n = CHAINS[chain]
    r: str | None = word
    for _ in range(n):
        r = undo(r, x, y)
        if r is None:
            return None
    return r if r != word and "�" not in r else None


def kind(c: str) -> str:
    """Coarse class of a character, with case; unlike the character model it tells `рЕУОС` from `Песня`."""
    o = ord(c)
    if o < 128:
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "."
    if o < 160:
        return "x"
    if 0x2500 <= o < 0x25A0:
        return "b"
    if 0x400 <= o < 0x530:
        return "r" if c.islower() else "R"
    if 0x370 <= o < 0x400:
        return "g"
    if 0x3000 <= o < 0x3100:
        return "h"
    if 0x4E00 <= o < 0xA000:
        return "k"
    if c.isalpha():
        return "e" if c.islower() else "E" if c.isupper() else "o"
    return "p" if 0x2010 <= o < 0x2030 else "s"


def cells(text: str) -> tuple[list[int], list[int], list[int], int]:
    """(pair cells, their first characters' cells, second characters' cells, control characters) of a word."""
    low = "^" + text.lower() + "$"
    cls = "^" + "".join(map(kind, text)) + "$"
    pairs, first, second = [], [], []
    for s, salt in ((low, 0), (cls, 7919)):
        for a, b in zip(s, s[1:]):
            u, v = ord(a) + salt, ord(b) + salt
            pairs.append((u * 40503 + v * 2654435 + (u ^ v) * 97) % BIGRAMS)
            first.append((u * 2654435761 >> 7) % UNIGRAMS)
            second.append((v * 2654435761 >> 7) % UNIGRAMS)
    return pairs, first, second, sum("\x80" <= c < "\xa0" for c in text)


class Model:
    def __init__(self, bi: np.ndarray, uni: np.ndarray, fields: dict[str, np.ndarray], sources: dict[tuple[str, int], dict[int, float]]):
        self.bi, self.uni, self.fields, self.sources = bi.tolist(), uni.tolist(), fields, sources
        self.total = float(uni.sum()) + UNIGRAMS
        self.active = {f: [c for c in range(1, LOST) if p[c] > 1e-6] for f, p in fields.items()}
        every = sorted(set().union(*self.active.values())) if fields else []
        self.every = every
        self.memo: dict[str, list] = {}
        self.base: dict[tuple, tuple] = {}

    def loglik(self, text: str) -> float:
        pairs, first, second, bad = cells(text)
        bi, uni, total, out = self.bi, self.uni, self.total, -NEVER * bad
        for p, a, b in zip(pairs, first, second):
            out += math.log((bi[p] + SMOOTH * (uni[b] + 1) / total) / (uni[a] + SMOOTH))
        return out

    def readings(self, word: str) -> list[tuple[int, str, float]]:
        """(chain, restored, log likelihood) of every chain the word can have come through."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            texts: dict[str, list[int]] = {}
            for c in self.every:
                r = restore(word, c)
                if r is not None and not NO_TEXT.search(r):
                    texts.setdefault(r, []).append(c)
            got = [(0, word, self.loglik(word))]
            for r, cs in texts.items():
                ll = self.loglik(r)
                got += [(c, r, ll) for c in cs]
            top = max(ll for _, _, ll in got)
            got = [x for x in got if x[0] == 0 or x[2] > top - FAR]  # a field may have closed the best one's chain
            self.memo[word] = got
        return got

    def posterior(self, word: str, field: str, source: int) -> list[tuple[int, str, float]]:
        if "�" in word:
            return [(LOST, word, 1.0)]
        base = self.base.get((word, field))
        if base is None:
            if len(self.base) > 400_000:
                self.base.clear()
            base = self.base[(word, field)] = self._base(word, field)
        fixed, open_ = base
        own = self.sources.get((field, source)) if open_ else None
        if not own:
            return fixed
        # only words that the field leaves open ask their source
        weight = sum(own.values()) + SHRINK
        get, log = own.get, math.log
        got = [(c, r, ll + log((get(c, 0.0) + k) / weight + 1e-12)) for c, r, ll, k in open_]
        top = max(x for _, _, x in got)
        got = [(c, r, math.exp(x - top)) for c, r, x in got if x > top - 14]
        z = sum(x for _, _, x in got)
        return [(c, r, x / z) for c, r, x in got]

    def _base(self, word: str, field: str) -> tuple[list, list]:
        """(posterior by the field alone, readings to weigh by source; none if the field is sure of one)."""
        pi = self.fields[field]
        read = [(c, r, ll, SHRINK * pi[c]) for c, r, ll in self.readings(word) if c == 0 or pi[c] > 1e-6]
        if CONTROL.search(word):  # never clean: by the open chains, else by any chain, else beyond repair
            read = [x for x in read if x[0]] or [(c, r, ll, SHRINK * 1e-6) for c, r, ll in self.readings(word) if c]
            if not read:
                return [(LOST, word, 1.0)], []
        top = max(ll + math.log(k / SHRINK + 1e-12) for _, _, ll, k in read)
        got = [(c, r, math.exp(ll + math.log(k / SHRINK + 1e-12) - top)) for c, r, ll, k in read]
        z = sum(x for _, _, x in got)
        post = [(c, r, x / z) for c, r, x in got if x / z > 1e-6]
        return post, [] if max(p for _, _, p in post) > 1 - 1e-6 else read


def first_model(fields: list[str]) -> dict[str, np.ndarray]:
    p = np.full(LOST + 1, 1e-4)
    for k, c in enumerate(CHAINS[1:], 1):
        p[k] = 1e-2 if c[0] == "utf-8" else 1e-3 if c[0] in WRITTEN[1:6] else 1e-4
    p[0] = 0
    p[0] = 1 - p.sum()
    return {f: p.copy() for f in fields}


def values(concerts: DataFrame, tracks: DataFrame) -> DataFrame:
    """``table_name, row_id, field_name, source, text`` of the values with a non-ASCII character (the rest cannot be garbled)."""
    src = F.pmod(F.xxhash64(F.coalesce("parent", F.lit(""))), F.lit(SOURCES)).cast("int")
    one = lambda df, t, i, f: df.where(F.length(f) != F.octet_length(f)).select(F.lit(t).alias("table_name"), F.col(i).alias("row_id"), F.lit(f).alias("field_name"), src.alias("source"), F.col(f).alias("text"))
    return one(concerts, "concerts", "concert_id", "folder").unionAll(one(concerts, "concerts", "concert_id", "info_txt")).unionAll(one(tracks, "tracks", "track_id", "title"))


def words(vals: DataFrame) -> DataFrame:
    ws = F.array_distinct(F.filter(F.split("text", r"[ \t\r\n\f/]+"), lambda w: F.length(w) != F.octet_length(w)))
    return vals.select("table_name", "row_id", "field_name", "source", F.explode(ws).alias("word"))


#: Where the cells of each kind begin: character pairs, characters, chains of a field, chains of a source in a field.
OF_UNIGRAM = BIGRAMS
OF_FIELD = OF_UNIGRAM + UNIGRAMS
OF_SOURCE = OF_FIELD + len(FIELDS) * (LOST + 1)


def _sums(counts: DataFrame, model: Model | None) -> pd.DataFrame:
    """The E-step: ``cell, v``, expected counts of every cell. Without a model, of the words as they stand."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        acc: dict[int, float] = {}
        # all rows of a word are in one partition: the character cells are touched once per reading of a word
        read: dict[str, float] = {}
        place = {f: k for k, f in enumerate(FIELDS)}
        for df in batches:
            for word, field, source, n in zip(df.word, df.field_name, df.source, df.n):
                w = math.sqrt(n)  # a word's repeats count less and less: they are no further evidence of its source or its letters
                if m is None:
                    if "\ufffd" not in word and not any("\x80" <= c < "\xa0" for c in word):
                        read[word] = read.get(word, 0.0) + w
                    continue
                f = place[field]
                for c, text, p in m.posterior(word, field, source):
                    if p < 1e-4:
                        continue
                    k = OF_FIELD + f * (LOST + 1) + c
                    acc[k] = acc.get(k, 0.0) + p * n
                    k = OF_SOURCE + (f * SOURCES + source) * (LOST + 1) + c
                    acc[k] = acc.get(k, 0.0) + p * w
                    if c != LOST:
                        read[text] = read.get(text, 0.0) + p * w
        bi, uni = np.zeros(BIGRAMS), np.zeros(UNIGRAMS)
        for text, w in read.items():
            pairs, first, _, _ = cells(text)
            for i in pairs:
                bi[i] += w
            for i in first:
                uni[i] += w
        flat = np.concatenate([bi, uni])
        at = np.nonzero(flat)[0]
        yield pd.DataFrame({"cell": np.concatenate([at, np.fromiter(acc.keys(), np.int64, len(acc))]), "v": np.concatenate([flat[at], np.fromiter(acc.values(), float, len(acc))])})

    return counts.mapInPandas(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()


def fit_em(counts: DataFrame, rounds: int = ROUNDS) -> Model:
    def chars(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.zeros(OF_SOURCE)
        near = x[x.cell < OF_SOURCE]
        flat[near.cell.to_numpy()] = near.v.to_numpy()
        return flat[:OF_UNIGRAM], flat[OF_UNIGRAM:OF_FIELD], flat[OF_FIELD:]

    bi, uni, _ = chars(_sums(counts, None))
    model = Model(bi, uni, first_model(list(FIELDS)), {})
    for _ in range(rounds):
        x = _sums(counts, model)
        bi, uni, chains = chars(x)
        pi, own = {}, {}
        for k, f in enumerate(FIELDS):
            p = first_model([f])[f] * 5.0 + chains[k * (LOST + 1) :][: LOST + 1]
            p[1:LOST][p[1:LOST] < 1.5] = 0.0  # a chain with hardly a word behind it is closed
            pi[f] = p / p.sum()
        far = x[x.cell >= OF_SOURCE]
        for at, v in zip((far.cell - OF_SOURCE).tolist(), far.v.tolist()):
            at, c = divmod(at, LOST + 1)
            own.setdefault((FIELDS[at // SOURCES], at % SOURCES), {})[c] = v
        model = Model(bi, uni, pi, own)
    return model


def garbled_words(vals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``field_name, source, word, chain, restored, posterior`` of the words more likely garbled than not."""
    counts = words(vals).groupBy("word", "field_name", "source").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.repartition("word"))
    model = fit_em(counts, rounds)
    shared = vals.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for df in batches:
            out = []
            for word, field, source in zip(df.word, df.field_name, df.source):
                post = m.posterior(word, field, source)
                clean = sum(p for c, _, p in post if c == 0)
                if clean < 0.5:
                    by: dict[str, float] = {}
                    for c, r, p in post:
                        if c:
                            by[r] = by.get(r, 0.0) + p
                    text = max(by, key=lambda r: (by[r], r))
                    chain = max((x for x in post if x[0] and x[1] == text), key=lambda x: x[2])[0]
                    out.append((field, source, word, NAMES[chain], None if chain == LOST else text, 1 - clean))
            yield pd.DataFrame(out, columns=["field_name", "source", "word", "chain", "restored", "posterior"])

    return counts.mapInPandas(run, "field_name string, source int, word string, chain string, restored string, posterior double")


def found(concerts: DataFrame, tracks: DataFrame) -> DataFrame:
    """``table_name, row_id, field_name``: each garbled value once. Null and ASCII-only values are never garbled."""
    vals = values(concerts, tracks)
    bad = cut(garbled_words(vals)).select("field_name", "source", "word")
    return words(vals).join(broadcast_if_small(bad), ["field_name", "source", "word"]).select("table_name", "row_id", "field_name").distinct()


def restored(concerts: DataFrame, tracks: DataFrame) -> DataFrame:
    """``table_name, row_id, field_name, restored, whole``: each garbled value with its words repaired; whole: none was lost."""
    vals = values(concerts, tracks)
    bad = cut(garbled_words(vals)).select("field_name", "source", "word", "restored")
    hits = words(vals).join(broadcast_if_small(bad), ["field_name", "source", "word"])
    fix = hits.groupBy("table_name", "row_id", "field_name").agg(F.map_from_entries(F.collect_set(F.struct("word", F.coalesce("restored", "word").alias("r")))).alias("fix"), F.min(F.col("restored").isNotNull()).alias("whole"))

    @F.pandas_udf("string")
    def put(text: pd.Series, fix: pd.Series) -> pd.Series:
        return pd.Series(["".join(dict(f).get(w, w) for w in BREAK.split(t)) for t, f in zip(text, fix)])

    return vals.join(fix, ["table_name", "row_id", "field_name"]).select("table_name", "row_id", "field_name", put("text", "fix").alias("restored"), "whole")

"""Languages of documents and their paragraphs (problem 8): compression classification.

Each language has a zstandard raw-content dictionary; a piece of text belongs to the language whose dictionary
encodes it in the fewest bytes. A narrow margin over the runner-up is rejected: the piece then takes the language of
the whole document, by the sizes summed over its pieces. Only where these tie, or no piece has a letter, the delivered label
is believed.

Dictionaries are fitted on the driver from a bounded sample of labelled documents (``SAMPLE_PER_LANGUAGE`` per
language, lowest hash first), found by one scan of ids and labels and one of texts. Labels may be wrong, so each sample line first moves, twice, to the language whose
labelled lines use its words most.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounded fit: labelled documents per language, characters of each taken into the sample, bytes of a dictionary.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS, DICT_BYTES = 250, 6000, 65536
#: A piece is settled by itself if the runner-up is larger by this share and this many bytes.
MARGIN, MARGIN_BYTES = 0.04, 2
LEVEL = 1
#: ISO 639-2 codes (terminological, bibliographic) of the two-letter codes.
ISO3 = {"en": ("eng",), "de": ("deu", "ger"), "fr": ("fra", "fre"), "es": ("spa",), "it": ("ita",), "nl": ("nld", "dut"), "pt": ("por",), "sv": ("swe",), "da": ("dan",), "no": ("nor",), "fi": ("fin",), "pl": ("pol",), "cs": ("ces", "cze"), "ru": ("rus",), "ja": ("jpn",), "hu": ("hun",), "ro": ("ron", "rum")}
LINK = re.compile(r"https?://\S+")


class _Letters(dict):
    """Character to what counts of it: compatibility form without accents; digits and punctuation are a space."""

    def __missing__(self, o: int) -> str:
        out = "".join(c if c.isalpha() or c.isspace() or c in "_'" or (c.isalnum() and c not in "0123456789") else " " for c in unicodedata.normalize("NFKD", chr(o)) if not unicodedata.combining(c))
        self[o] = out
        return out


LETTERS = _Letters()


def label_map(codes: list[tuple[str, str]]) -> dict[str, str]:
    """Every lower-case way to write a label: code, three-letter code, English name."""
    out = {}
    for code, name in codes:
        for k in (code, name, *ISO3.get(code, ())):
            if k:
                out[k.strip().lower()] = code
    return out


def label_code(c: Column, names: dict[str, str]) -> Column:
    """The code a delivered label stands for, null if none; region suffixes (`fr-FR`, `de_DE`) are dropped."""
    if not names:
        return F.lit(None).cast("string")
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(m, t), F.try_element_at(m, F.regexp_extract(t, r"^([a-z]{2,3})[-_].*$", 1)))


def plain(text: str) -> str:
    """Lower case without accents, digits and punctuation, so that case and typing of accents do not count."""
    t = text.lower()
    if "://" in t:
        t = LINK.sub(" ", t)
    return " ".join(t.translate(LETTERS).split())


LISTED = re.compile(r"^\W*\d+\s*[.):-]|\S\s+(?:->|>)\s+\S")
ENDED = re.compile(r"[.!?…][\"'”»)\]]*\s*$")


def prose(text: str) -> str:
    """The lines that are sentences: names, headings and numbered titles don't count towards a language. All, if none is."""
    lines = [x for x in text.splitlines() if ENDED.search(x) and not LISTED.search(x)]
    return "\n".join(lines) if lines else text


class Coders:
    """The per-language compressors; `raw` maps code to dictionary bytes, in the order of ties."""

    def __init__(self, raw: dict[str, bytes]):
        self.langs = list(raw)
        self.c = []
        for b in raw.values():
            d = zstandard.ZstdCompressionDict(b or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.c.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.empty = [len(c.compress(b"")) for c in self.c]

    def sizes(self, text: str) -> list[int]:
        b = text.encode()
        return [len(c.compress(b)) - e for c, e in zip(self.c, self.empty)]


def fit(labelled: dict[str, list[str]]) -> dict[str, bytes]:
    """Dictionaries from sample texts by label, after moving lines that are under a wrong label."""
    lines = {k: Counter(p for t in v for s in re.split(r"[\n.!?]+", prose(t)) if len(p := plain(s)) >= 24) for k, v in labelled.items()}

    def pack(found: Counter) -> bytes:
        """Frequent lines first; lines that bring words the dictionary lacks before lines that don't."""
        order = sorted(found, key=lambda x: (-found[x], hash_of(x)))
        words, first, rest = Counter(), [], []
        for x in order:
            ws = set(x.split())
            (first if any(words[w] < 2 for w in ws) else rest).append(x)
            words.update(ws)
        out, size = [], 0
        for x in first + rest:
            b = x.encode() + b"\n"
            if size + len(b) <= DICT_BYTES:
                out.append(b)
                size += len(b)
        return b"".join(out)

    for _ in range(2):
        # a line compresses to nothing under a dictionary that holds it, so training lines are judged by their words
        seen = {k: Counter() for k in lines}
        for k, v in lines.items():
            for s, n in v.items():
                for w in set(s.split()):
                    seen[k][w] += n
        total = {k: max(1, sum(v.values())) for k, v in lines.items()}
        order = list(lines)
        logs = {w: [math.log((seen[j][w] + 0.02) / total[j]) for j in order] for w in set().union(*seen.values())}
        moved = {k: Counter() for k in lines}
        for k, v in lines.items():
            for s, n in v.items():
                score = [sum(x) for x in zip(*(logs[w] for w in s.split()))]
                best = max(score)
                moved[k if score[order.index(k)] == best else order[score.index(best)]][s] += n
        lines = moved
    # a line that still stands under several languages stays where its words are most frequent
    for text in [x for x, n in Counter(x for v in lines.values() for x in v).items() if n > 1]:
        holders = [k for k in lines if text in lines[k]]
        home = max(holders, key=lambda k: sum(math.log((seen[k][w] + 0.02) / total[k]) for w in text.split()))
        for k in holders:
            if k != home:
                del lines[k][text]
    return {k: pack(v) for k, v in lines.items()}


def hash_of(s: str) -> int:
    h = 1469598103934665603
    for b in s.encode():
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


def fit_dictionaries(docs: DataFrame, codes: list[tuple[str, str]], per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, bytes]:
    """The lowest `per_language` documents of each label by the hash of their id. Ids and labels are counted first, which
    gives a threshold of the hash that leaves little more than the sample; then the texts are read once."""
    names = label_map(codes)
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    lab = docs.where("text is not null").select("doc_id", "text", label_code(F.col("lang"), names).alias("l"), hashed.alias("h")).where("l is not null")
    n = {r.l: r.n for r in docs.select(label_code(F.col("lang"), names).alias("l")).where("l is not null").groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, 2.0 * (per_language + 50) / v) for k, v in n.items()}
    got: dict[str, list[str]] = {}
    while share:  # a second time only for a label most of whose texts are null
        low = F.coalesce(*[F.when(F.col("l") == k, F.col("h") < int(v * (1 << 30))) for k, v in share.items()], F.lit(False))
        rows = sorted((r.l, r.h, r.doc_id, r.t) for r in lab.where(low).select("l", "h", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("t")).collect())
        for k in list(share):
            mine = [t for label, _, _, t in rows if label == k]
            if len(mine) >= per_language or share[k] >= 1.0:
                got[k] = mine[:per_language]
                del share[k]
            else:
                share[k] = min(1.0, share[k] * 4)
    return fit({code: got.get(code, []) for code, _ in codes})


def settled(s: list[int]) -> tuple[int, float, bool]:
    """(best, confidence, clear). Confidence is the runner-up's excess in bytes as a share of its size."""
    a = min(s)
    best = s.index(a)
    if len(s) < 2:
        return best, 1.0, True
    b = min(s[:best] + s[best + 1 :])
    gain = (b - a) / max(b, 1)
    return best, gain, b - a >= MARGIN_BYTES and gain >= MARGIN


def segments(docs: DataFrame, codes: list[tuple[str, str]], raw: dict[str, bytes] | None = None) -> DataFrame:
    """``doc_id, seg, lang, confidence, clear, doc_lang, doc_confidence, label``: one row per piece between blank lines.

    A null text has no piece; an empty one has one, which takes the document's language or label. Texts of any length are read whole.
    ``lang`` is null only when neither piece, document nor label says anything.
    """
    names = label_map(codes)
    raw = raw if raw is not None else fit_dictionaries(docs, codes)
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    schema = "doc_id bigint, seg bigint, lang string, confidence double, clear boolean, doc_lang string, doc_confidence double, label string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coders = Coders(shared.value)
        langs = coders.langs
        for df in batches:
            out = []
            for doc_id, text, label in zip(df.doc_id, df.text, df.label):
                label = label if isinstance(label, str) else None
                pieces = [plain(prose(p)) for p in text.split("\n\n")]
                sizes = [coders.sizes(p) if p and langs else None for p in pieces]
                read = [x for x in sizes if x]
                whole = read[0] if len(read) == 1 else [sum(x) for x in zip(*read)]
                d_best, d_gain, _ = settled(whole) if whole else (0, 0.0, False)
                doc = langs[d_best] if d_gain > 0 else label
                for k, s in enumerate(sizes):
                    best, gain, clear = settled(s) if s else (0, 0.0, False)
                    lang = langs[best] if clear else doc if doc is not None else langs[best] if s else None
                    out.append((doc_id, k, lang, gain, clear, doc, d_gain, label))
            yield pd.DataFrame(out, columns=["doc_id", "seg", "lang", "confidence", "clear", "doc_lang", "doc_confidence", "label"])

    return docs.where("text is not null").select("doc_id", "text", label_code(F.col("lang"), names).alias("label")).mapInPandas(run, schema)


def mislabelled(docs: DataFrame, codes: list[tuple[str, str]]) -> DataFrame:
    """``doc_id, seg, lang`` of the pieces whose language is not the label's; all pieces where the label names none."""
    s = segments(docs, codes)
    return s.where("lang is not null and (label is null or lang != label)").select("doc_id", "seg", "lang")


def documents_language(docs: DataFrame, codes: list[tuple[str, str]]) -> DataFrame:
    """``doc_id, lang, confidence, label, mixed``: one row per document; mixed: two clear languages among its pieces."""
    s = segments(docs, codes)
    return s.groupBy("doc_id").agg(F.first("doc_lang").alias("lang"), F.first("doc_confidence").alias("confidence"), F.first("label").alias("label"), (F.size(F.collect_set(F.when(F.col("clear"), F.col("lang")))) > 1).alias("mixed"))

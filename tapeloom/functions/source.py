"""Source kind and microphones told by folder name, file names and notes."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Fixed values, in order: the first kind that is found counts.
KINDS = ((r"(?i)\bpre[\s._-]*fm\b", "Pre-FM"), (r"(?i)\bmtx\b|\bmatrix\b", "Matrix"), (r"(?i)\bsbd\b|\bsoundboard\b|\bboard\b", "SBD"), (r"(?i)\baud\b|\baudience\b", "AUD"), (r"(?i)\bfm\b(?!.*broadcast)|\bbroadcast\b|\bpre-?broadcast\b", "FM"), (r"(?i)\bdigital\s*master\b|\bdat\b", "DAT"))
#: What a text in lower case must hold for each: a plain search before a pattern.
KIND_WORDS = (("fm",), ("mtx", "matrix"), ("sbd", "board"), ("aud",), ("fm", "broadcast"), ("digital", "dat"))
#: Fixed values, in order: pattern and the label before its group ("" for none).
MICS = (
    (r"(?i)\bschoeps\s*(ccm\s*\d+\w*|cmc\s*\d+\w*|mk\s*\d+\w*|m\s*\d+\w*)", "Schoeps "), (r"(?i)\bmk\s*(4|41|5|6|21|22|2s)\b", "Schoeps MK"),
    (r"(?i)\bakg\s*(c?\s*\d{2,3}[a-z]*|ck\s*\d+\w*)", "AKG "), (r"(?i)\bakg\b()", "AKG"),
    (r"(?i)\bneumann\s*(km\s*\d+\w*|u\s*\d+\w*|tlm\s*\d+)", "Neumann "), (r"(?i)\bneumann\b()", "Neumann"),
    (r"(?i)\bsennheiser\s*(mkh?\s*\d+\w*|mke\s*\d+|md\s*\d+\w*|\d{3,4})", "Sennheiser "), (r"(?i)\bmkh\s*(\d+\w*)", "Sennheiser MKH"),
    (r"(?i)\bdpa\s*(\d{4})", "DPA "), (r"(?i)\bdpa\b()", "DPA"),
    (r"(?i)\bnak(?:amichi)?\s*(cm-?\s*\d+\w*|dr-?\s*\d+\w*|cr-?\s*\d+\w*)", "Nak "), (r"(?i)\bnak\s*(\d+\w*)", "Nak "), (r"(?i)\bnak\b()", "Nak"),
    (r"(?i)\bsony\s*(pcm-?[dm]\s*\d+\w*|tc-?d\s*\d+\w*|d\s*\d+)", "Sony "), (r"(?i)\bcore\s*sound\s*(\w+)?", "CoreSound "), (r"(?i)\bbinaural\b()", "Binaural"),
    (r"(?i)\bshure\s*(ksm\d+|sm\d+)", "Shure "), (r"(?i)\bmicrotech\s*gefell\s*([a-z]{0,4}\s*\d+\w*)", "MT Gefell "), (r"(?i)\bmicrotech\s*gefell\b()", "MT Gefell"),
    (r"(?i)\bmilab\s*(vm-?\s*\d+\w*(?:\s*link)?|[a-z]+\d+\w*)", "Milab "), (r"(?i)\bearthworks\s*(sr\s*\d+\w*|qtc\s*\d+\w*|[a-z]{1,3}\s*\d+\w*)", "Earthworks "),
    (r"(?i)\baudio[-\s]?technica\s*(at\s*\d+\w*)", "AT "), (r"(?i)\bat\s*(\d{3,4}\w*)\b", "AT "),
    (r"(?i)\btascam\s*(dr-?\s*\d+\w*|da-?\s*\d+\w*|hd-?p?\s*\d+\w*|portastudio\s*\d+)", "Tascam "), (r"(?i)\btascam\b()", "Tascam"),
    (r"(?i)\bedirol\s*(r-?\s*\d+\w*|ua-?\s*\d+\w*)", "Edirol "), (r"(?i)\bedirol\b()", "Edirol"),
    (r"(?i)\bzoom\s*([hf]\s*\d+\w*)", "Zoom "), (r"(?i)\bsound\s*devices\s*(mix\s*pre\s*\d+\w*|\d{3,4}\w*)", "SD "),
)


#: The word that each pattern begins with.
MIC_WORDS = tuple(re.match(r"\(\?i\)\\b([a-z]+)", p)[1] for p, _ in MICS)


def kind(text: Column) -> Column:
    def one(low: Column) -> Column:
        held = lambda words: reduce(or_, [low.contains(w) for w in words])
        return F.coalesce(*[F.when(held(words) & text.rlike(p), F.lit(label)) for (p, label), words in zip(KINDS, KIND_WORDS)])

    return let(F.lower(text), one)


def mics(text: Column) -> Column:
    """Labels in the order of the patterns, then of place; each once whatever its case; a family name goes if a model of it is there."""
    def labels(low: Column, word: str, p: str, before: str) -> Column:
        got = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda g: F.trim(F.regexp_replace(F.concat(F.lit(before), g), r"\s+", " ")))
        return F.when(low.contains(word) & text.rlike(p), got).otherwise(F.array().cast("array<string>"))

    found = let(F.lower(text), lambda low: F.concat(*[labels(low, word, p, before) for word, (p, before) in zip(MIC_WORDS, MICS)]))
    return let(found, _families)


def _families(found: Column) -> Column:
    once = F.filter(found, lambda x, i: ~F.exists(F.slice(found, 1, i), lambda y: F.lower(y) == F.lower(x)))
    family = lambda x: F.lower(F.substring_index(x, " ", 1))
    models = F.transform(F.filter(once, lambda x: x.rlike(r"\d")), family)
    return F.filter(once, lambda x: x.rlike(r"\d") | ~F.array_contains(models, family(x)))


def detect(*texts: Column) -> Column:
    """struct(kind, mics, taper) of all texts together; the taper is never told."""
    blob = F.concat_ws("  ", *[F.coalesce(t, F.lit("")) for t in texts])
    return let(blob, lambda b: F.struct(kind(b).alias("kind"), mics(b).alias("mics"), F.lit(None).cast("string").alias("taper")))


def label(source: Column) -> Column:
    """`[SBD Schoeps MK4]`, empty if nothing is known."""
    parts = F.concat_ws(" ", F.when(source["kind"] != "", source["kind"]), F.array_join(F.coalesce(source["mics"], F.array().cast("array<string>")), " "))
    return F.when(F.trim(parts) == "", "").otherwise(F.concat(F.lit("["), F.trim(parts), F.lit("]")))

"""Problems 6, 7 and 8: packing, mixing, languages."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import language, mixing, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no vocabulary files")
D = "doc_id bigint, text string, lang string, source string, tokens int, part int, capacity string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 7, 1, "clash") for i, t, lang, s in rows], D)


def _sizes(spark, docs):
    return {r.doc_id: r.tokens for r in tokens.token_counts(docs).collect()}


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 90), None, None) for i in range(300)] + [(900, None, None, None), (901, "", None, None), (902, "long text " * 700, None, None), (903, "same " * 64, None, None), (904, "same " * 64, None, None)]
    docs = _docs(spark, rows)
    caps = spark.createDataFrame([(1, 128, "x"), (2, 1000, "x"), (3, None, "x")], "pack_id int, capacity_tokens int, bin string")
    size = _sizes(spark, docs)
    assert 900 not in size and size[901] == 0
    got = packing.pack(docs, caps, block=80).collect()
    for p, cap in ((1, 128), (2, 1000)):
        mine = [r for r in got if r.pack_id == p]
        fill, have = Counter(), defaultdict(list)
        for r in mine:
            fill[r.bin] += r.tokens
            have[r.doc_id].append((r.part, r.tokens))
        assert max(fill.values()) <= cap and set(have) == set(size)
        for d, parts in have.items():
            assert sum(t for _, t in parts) == size[d] and (len(parts) == 1 or size[d] > cap)
            assert len(parts) == max(1, -(-size[d] // cap))
        assert sum(fill.values()) / (len(fill) * cap) > 0.93
    assert {r.pack_id for r in got} == {1, 2}
    assert packing.pack(docs.limit(0), caps).count() == 0 and packing.pack(docs, caps.limit(0)).count() == 0


def test_crossover_keeps_every_document():
    rng = random.Random(3)
    size = [rng.randint(1, 60) for _ in range(150)]
    a, b = packing.start(rng, size, 100), packing.start(rng, size, 100)
    for _ in range(30):
        c = packing.cross(rng, a, b, size, 100)
        assert sorted(i for x in c.bins for i in x) == list(range(150)) and min(c.room) >= 0
        a, b = b, c
    best = packing.evolve(size, 100, [], 5)
    plain: list = []
    packing.best_fit(plain, [], list(range(150)), size, 100)
    assert len(best.bins) <= len(plain)


def test_evolution_gains_where_best_fit_does_not_suffice():
    """Items that fill their containers exactly by threes: best fit decreasing, the first of the population, wastes some."""
    rng, plain, evolved = random.Random(7), 0, 0
    for n in range(6):
        size = []
        for _ in range(40):
            a = rng.randint(380, 480)
            b = rng.randint(250, (1000 - a) // 2)
            size += [a, b, 1000 - a - b]
        packing.best_fit(bins := [], [], list(range(len(size))), size, 1000)
        elites: list = []
        for epoch in range(4):
            elites = [packing.evolve(size, 1000, elites, 100 * n + epoch).owners(len(size))]
        plain, evolved = plain + len(bins), evolved + max(elites[0]) + 1
    assert 6 * 40 <= evolved < plain


def test_running_sums_by_levels(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).alias("v"))
    got = mixing.running(df, ["g"], F.floor(F.col("id") / 4), 125, ["id"], "v", "before", rows=4).collect()
    sums: dict = defaultdict(int)
    for r in sorted(got, key=lambda r: r.id):
        assert r.before == sums[r.g]
        sums[r.g] += r.v
    assert len(got) == 500
    assert {r.id: r.before for r in mixing.running(df, [], F.floor(F.col("id") / 4), 125, ["id"], "v", "before", rows=5).collect()} == {i: sum(k * 7 % 11 for k in range(i)) for i in range(500)}


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "some words here " * rng.randint(1, 20), None, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None, "other"])) for i in range(900)] + [(2000, None, None, "a"), (2001, "", None, "a")]
    docs = _docs(spark, rows)
    t = spark.createDataFrame([("a", 0.4, 1, 1), ("b", 0.3, 2, 1), ("c", 0.29, 3, 1), ("gone", 0.01, 4, 1), (None, 0.5, 1, 1)], "source string, target_share double, max_repeats int, tokens int")
    size, src = _sizes(spark, docs), {r[0]: r[3] for r in rows}
    have = Counter()
    for d, n in size.items():
        if src[d] in ("a", "b", "c"):
            have[src[d]] += n
    got = mixing.mix(docs, t).collect()
    assert [r.position for r in got] == list(range(len(got)))
    assert [r["at"] for r in got] == sorted(r["at"] for r in got) and all(0 <= r["at"] <= 1 for r in got)
    want = mixing.demands(have, [("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.29, 3), ("gone", 0.01, 4)], sum(have.values()))
    used, tok = Counter((r.doc_id, r.copy) for r in got), Counter()
    for r in got:
        tok[r.source] += r.tokens
        assert r.tokens == size[r.doc_id] and r.copy < {"a": 1, "b": 2, "c": 3}[r.source]
    assert max(used.values()) == 1 and set(tok) == {"a", "b", "c"}
    most = max(size.values())
    assert all(abs(tok[s] - want[s]) <= most for s in tok)
    early, late = Counter(), Counter()
    for r in got:
        (early if r["at"] < 0.5 else late)[r.source] += r.tokens
    a = mixing.slopes(want)
    for s in tok:  # the share in the first half is 1/2 + a/4
        assert abs(early[s] / tok[s] - (0.5 + a[s] / 4)) < 0.05
    s = {r.source: r for r in mixing.shares(docs, t).collect()}
    assert s["gone"].actual_share == 0 and s["gone"].capped and abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    assert mixing.mix(docs.limit(0), t).count() == 0 and mixing.mix(docs, t.limit(0)).count() == 0


def test_demands():
    d = mixing.demands({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.2, 9)], 60)
    assert d == {"a": 40.0, "b": 20.0, "c": 0.0}
    assert mixing.demands({}, [("a", 1.0, 3)], 10) == {"a": 0.0}


SENT = {
    "en": ["The crowd talks through the quiet parts, which is a shame.", "We missed the beginning of the show, but it was worth it.", "Nobody knows who made the original tape of the tour.", "There is a small cut in the second song after a minute."],
    "de": ["Das Publikum redet in den leisen Stellen, was sehr schade ist.", "Wir haben den Anfang verpasst, aber es hat sich gelohnt.", "Niemand weiß, wer das ursprüngliche Band der Tournee gemacht hat.", "Es gibt einen kleinen Schnitt im zweiten Lied nach einer Minute."],
    "fr": ["Le public parle pendant les passages calmes, ce qui est dommage.", "Nous avons raté le début du concert, mais cela en valait la peine.", "Personne ne sait qui a fait la bande originale de la tournée.", "Il y a une petite coupure dans la deuxième chanson après une minute."],
}
CODES = [("en", "English"), ("de", "German"), ("fr", "French")]


def test_languages(spark):
    rng = random.Random(5)
    names = ["The Velvet Signal", "Mabel Drezedroher", "Silver Lullaby Blues"]
    rows, truth = [], {}
    for i in range(240):
        main = rng.choice(list(SENT))
        pieces, langs = [], []
        for _ in range(rng.randint(1, 4)):
            k = main if rng.random() < 0.85 else rng.choice(list(SENT))
            p = " ".join(rng.sample(SENT[k], rng.randint(1, 3)))
            if rng.random() < 0.3:
                p = "\n".join([rng.choice(names), "01. " + rng.choice(names), p])
            pieces.append(p.upper() if rng.random() < 0.1 else p)
            langs.append(k)
        label = rng.choice([main] * 7 + [None, "??", dict(CODES)[main], main.upper() + "-XX", rng.choice(list(SENT))])
        rows.append((i, "\n\n".join(pieces), label, None))
        truth[i] = (langs, language.label_map(CODES).get((label or "").lower().split("-")[0]))
    rows += [(500, None, "en", None), (501, "", "en", None), (502, "", None, None), (503, "x " * 60_000, "de", None)]
    docs = _docs(spark, rows)
    got = {(r.doc_id, r.seg): r.lang for r in language.mislabelled(docs, CODES).where("doc_id < 500").collect()}
    want = {(d, k): lang for d, (langs, lab) in truth.items() for k, lang in enumerate(langs) if lab is None or lang != lab}
    assert len(set(got.items()) & set(want.items())) >= 0.98 * max(len(got), len(want))
    seg = language.segments(docs, CODES)
    assert seg.where("doc_id = 500").count() == 0 and seg.where("doc_id = 501").first().lang == "en" and seg.where("doc_id = 502").first().lang is None
    assert seg.where("doc_id = 503").count() == 1 and seg.where("confidence < 0 or confidence > 1").count() == 0
    one = language.documents_language(docs, CODES)
    assert one.count() == len({r[0] for r in rows}) - 1
    assert language.mislabelled(docs.limit(0), CODES).count() == 0
    assert language.segments(docs, []).where("lang is not null").count() == 0


def test_labels(spark):
    m = language.label_map(CODES)
    r = spark.createDataFrame([(x,) for x in (" en ", "English", "deu", "fr-FR", "de_DE", "??", None, "", "xx")], "l string").select(language.label_code(F.col("l"), m)).collect()
    assert [x[0] for x in r] == ["en", "en", "de", "fr", "de", None, None, None, None]

"""Operators on small tables against plain Python."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import artists, source
from tapeloom.functions.text import normalize_name
from tapeloom.operators import assemble, dedupe, discover, history, lexicon, notes, setlist
from tapeloom.operators.graph import connected_components
from tapeloom.streaming import upsert
from tapeloom.streaming.upsert import run_upserts


def find(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(40)] + [(None, "x"), ("self", "self")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}
    for a, b in edges:
        if a and b and a != b:
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(parent, x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_fuzzy_match_is_difflib(spark):
    rng = random.Random(5)
    keys = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(6, 14))).strip() for _ in range(120)]
    keys = [" ".join(k.split()) for k in keys if len(k.replace(" ", "")) > 4]
    names = []
    for k in keys[:80]:
        s = list(k)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], [s[i], "z"], ["z"]])
        names.append(" ".join("".join(s).split()))
    lex = spark.createDataFrame([(k, k, 5) for k in sorted(set(keys))], "key string, name string, cnt bigint")
    got = {r.name: (r.match, r.how) for r in lexicon.match(spark.createDataFrame([(n,) for n in names], "name string"), lex).collect()}
    for n in set(names):
        k = spark.range(1).select(normalize_name(F.lit(n))).first()[0]
        if k in set(keys):
            assert got[n][1] == "exact"
            continue
        best = max((difflib.SequenceMatcher(None, x, k).ratio(), x) for x in set(keys))
        if best[0] >= 0.88 and len(k) >= 5:
            assert got[n] == (best[1], "fuzzy"), (n, best)
        else:
            assert n not in got or got[n][1] == "contained"


def test_notes_stop_at_the_deciding_line(spark):
    """Neither the artist's line nor the place is read twice or beyond the line that decides: lines behind it don't enter the plan's
    fields, whatever they hold, and one line costs no more patterns for being asked for twice."""
    rest = "\n".join(f"Hall {i}, Springfield, NY" for i in range(9))
    d = spark.createDataFrame([(1, "Some Player\nBig Hall, Boston, MA\n" + rest), (2, "Some Player\nvenue: Big Hall\nBoston, MA\n" + rest), (3, "Some Player\nBig Hall\nDisc 1\n" + rest)], "i int, body string")
    x = notes.parse_notes(d)
    assert [(r.n_artist, r.n_venue, r.n_city, r.n_region) for r in x.orderBy("i").collect()] == [("Some Player", "Big Hall", "Boston", "MA"), ("Some Player", "Big Hall", "Boston", "MA"), ("Some Player", "Big Hall", None, None)]
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(slice(") == 2  # one for the artist, one for the place


def test_near_pairs_few_and_whole(spark):
    """Names that share words only are not met, and every pair that difflib holds for near is, of long names too."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklm") for _ in range(n))
    keys = [f"{word(7)} brothers band" for _ in range(150)] + [" ".join(word(rng.randint(2, 9)) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    names = []
    for k in keys:
        s = list(k)
        for _ in range(rng.randint(0, max(1, len(s) // 7))):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice(([], [s[i], "z"], ["z"]))
        names.append("".join(s))
    want = {(n, k) for n in names for k in keys if difflib.SequenceMatcher(None, n, k).ratio() >= lexicon.RATIO}
    k = spark.createDataFrame([(x, x, 2) for x in sorted(set(keys))], "key string, name string, cnt bigint")
    got = {(r.want, r.key) for r in lexicon._near(k, spark.createDataFrame([(x,) for x in sorted(set(names))], "key string")).collect()}
    assert want <= got and len(got) < 2 * len(want) and any(len(x) > lexicon.POSITIONED for _, x in want)


def test_duplicate_pairs_any_length(spark):
    """Lists of up to 23 tracks, one of them differing or cut off, some without durations or with words of other numbers."""
    rng = random.Random(4)
    recs = []
    for i in range(60):
        recs.append((f"s{i:03d}", [(float(rng.choice((200, 205, 214, 300))), [rng.getrandbits(32) for _ in range(rng.choice((6, 6, 6, 3, 8)))]) for _ in range(rng.randint(1, 23))]))
    for i in range(120):
        t = [(d + rng.choice((-7.0, 0.0, 3.5, 7.0)), [w ^ (1 << rng.randrange(32)) for w in f]) for d, f in rng.choice(recs[:60])[1]]
        for _ in range(rng.randint(0, max(1, len(t) // 4))):
            t[rng.randrange(len(t))] = rng.choice(((None, [1] * 6), (150.0, None), (float("nan"), [1] * 6), (200.0, [rng.getrandbits(32) for _ in range(6)])))
        recs.append((f"t{i:03d}", t[: rng.randint(max(1, len(t) * 3 // 4), len(t))]))
    df = spark.createDataFrame([(k, [{"duration": d, "fp": f} for d, f in t]) for k, t in recs], "sig string, tracks array<struct<duration:double,fp:array<bigint>>>")
    like = lambda x, y: None not in (x[0], y[0], x[1], y[1]) and abs(x[0] - y[0]) <= 7 and 1 - sum((p ^ q).bit_count() for p, q in zip(x[1], y[1])) / (32.0 * min(len(x[1]), len(y[1]))) >= 0.85
    for fraction in (0.8, 0.5):
        got = {(r.a, r.b, r.matched) for r in dedupe.duplicate_pairs(df, fraction=fraction).collect()}
        want = {(a, b, m) for a, s in recs for b, t in recs if a < b and (m := sum(map(like, s, t))) >= fraction * max(len(s), len(t))}
        assert got == want and len(want) > 40


def test_clusters_take_one_copy_and_no_paths(spark):
    """A signature is represented by its first print, of which only durations and fingerprints are exchanged."""
    rows = [(k, s, [{"path": f"{k}/{i}", "duration": 200.0 + i, "fp": [7 * i + v] * 6} for i in range(6)]) for k, s, v in ((1, "b", 1), (2, "b", 1 << 30), (3, "a", 1), (4, "c", 0x0FFFF000), (5, None, 1))]
    df = spark.createDataFrame(rows, "print_id bigint, audio_signature string, tracks array<struct<path:string,duration:double,fp:array<bigint>>>")
    assert dedupe.representatives(df).schema["tracks"].dataType.elementType.names == ["duration", "fp"]
    assert {(r.print_id, r.cluster) for r in dedupe.clusters(df).collect()} == {(1, "a"), (2, "a"), (3, "a"), (4, "c")}


def test_duplicate_lists_are_kept_packed(spark, monkeypatch):
    """What is kept and exchanged of a list holds no array for each track; odd words are compared as before."""
    rng = random.Random(6)
    base = [(2e6 + 200.0 * i if i < 2 else 200.0 + i, [rng.getrandbits(32) for _ in range(6)]) for i in range(8)]
    odd = {"high": lambda f: [w + (5 << 32) for w in f], "minus": lambda f: [w - (1 << 32) for w in f], "five": lambda f: f[:5], "null": lambda f: [None, *f[1:]], "none": lambda f: None, "same": lambda f: f, "far": lambda f: [w ^ 0xFFFF for w in f]}
    rows = [("base", base)] + [(k, [(d + 6.99, f if i else of(f)) for i, (d, f) in enumerate(base)]) for k, of in odd.items()] + [("all", [(d - 7, [w - (1 << 40) for w in f]) for d, f in base])]
    df = spark.createDataFrame([(k, [{"duration": d, "fp": f} for d, f in t]) for k, t in rows], "sig string, tracks array<struct<duration:double,fp:array<bigint>>>")
    kept, cut = [], dedupe.cut
    monkeypatch.setattr(dedupe, "cut", lambda x: kept.append(cut(x)) or kept[-1])
    got = {x.b if x.a == "base" else x.a: x.matched for x in dedupe.duplicate_pairs(df).collect() if "base" in (x.a, x.b)}
    assert got == {"high": 8, "minus": 8, "five": 8, "null": 7, "none": 7, "same": 8, "far": 7, "all": 8}
    assert {x.key: (x.words is None, x.fps is None) for x in kept[0].collect()} == {k: (k in ("five", "null", "none"), k not in ("five", "null", "none")) for k, _ in rows}


def test_duplicate_candidates_of_unrelated_lists(spark):
    """Lists of the same durations that sound different are not met: candidates don't grow with the square of the lists."""
    rng = random.Random(5)
    r = [(i, 8, [200.0] * 8, [[rng.getrandbits(32) for _ in range(6)] for _ in range(8)]) for i in range(300)]
    r.append((300, 8, [203.0] * 8, r[7][3]))
    got = dedupe.candidates(spark.createDataFrame(r, "rid bigint, n int, ds array<double>, fps array<array<bigint>>")).collect()
    assert [{x.a, x.b} for x in got] == [{7, 300}]


def test_duplicate_pairs_brute_force(spark):
    rng = random.Random(9)
    recs = []
    for i in range(40):
        n = rng.randint(1, 6)
        recs.append((f"s{i:03d}", [(rng.uniform(60, 120), [rng.getrandbits(32) for _ in range(6)]) for _ in range(n)]))
    for i in range(25):
        k, t = rng.choice(recs[:40])
        t = [(d + rng.uniform(-8, 8), [w ^ (1 << rng.randrange(32)) for w in f]) for d, f in t]
        recs.append((f"t{i:03d}", t if rng.random() < 0.7 else t[:-1] or t))
    df = spark.createDataFrame([(k, [{"duration": d, "fp": f} for d, f in t]) for k, t in recs], "sig string, tracks array<struct<duration:double,fp:array<bigint>>>")
    got = {(r.a, r.b, r.matched) for r in dedupe.duplicate_pairs(df).collect()}
    want = set()
    for a, s in recs:
        for b, t in recs:
            if a < b:
                m = sum(abs(x[0] - y[0]) <= 7 and 1 - sum((p ^ q).bit_count() for p, q in zip(x[1], y[1])) / 192 >= 0.85 for x, y in zip(s, t))
                if m >= 0.8 * max(len(s), len(t)):
                    want.add((a, b, m))
    assert got == want and want


def test_base64_similarity(spark):
    import base64

    a, b = bytes(range(12)), bytes([1, *range(1, 12)])
    e = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    df = spark.createDataFrame([(e(a), e(b)), (e(a), "%%%"), (None, e(a)), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(dedupe.base64_similarity(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - (1 - 1 / 96)) < 1e-9 and got[1:] == [0.0, 0.0, 0.0]


def _setlists(spark, bodies):
    got = {r.doc: [(x.disc, x.title) for x in r.raw] for r in setlist.setlist(spark.createDataFrame(list(enumerate(bodies)), "doc int, body string")).collect()}
    return [got[i] for i in range(len(bodies))]


RUN = "One Two\nThree Four\nFive Six\nSeven Eight"


def test_unnumbered_setlists(spark):
    titles = [(None, x) for x in ("One Two", "Three Four", "Five Six", "Seven Eight")]
    cases = {
        "Setlist:\nFoo Bar\nBaz Qux": [(None, "Foo Bar"), (None, "Baz Qux")],
        f"AC/DC\n{RUN}": titles,  # a heading of one word before four titles makes five lines
        f"The Band\n{RUN}": [(None, "The Band"), *titles],
        RUN: [],  # four lines are no list
        f"The Band\n\n{RUN}\nthis is a note\nNine Ten": [(None, "The Band"), *titles, (None, "Nine Ten")],
        f"Lost One\nthis is a note\n\nThe Band\n{RUN}": [(None, "The Band"), *titles],
        f"The Band\nOne Two\nthis is a note\n{RUN}": [],
        "Disc 1\nAlpha Song\nEncore\nBeta Song": [(1, "Alpha Song"), (2, "Beta Song")],
        f"The Band\nOne Two\nSetlist\n{RUN}": titles,  # the header comes before the run is complete
        "Setlist\nTrack 01 - Foo Bar  3:45\nA1 Side Song\nBaz Qux Quux 10:01": [(None, "Foo Bar"), (1, "Side Song"), (1, "Baz Qux Quux")],
        "Recorded by someone\nhttp://x": [], "": [], None: [],
    }
    assert dict(zip(cases, _setlists(spark, list(cases)))) == cases


def test_numbered_setlists(spark):
    cases = {
        "01. One\n02. Two\n03. Three": [(None, "One"), (None, "Two"), (None, "Three")],
        "Disc Two\n1 One 3:21\n5. md5 x\nSet 3\n2) Two\nEncore\n3: Three\n4 - Four\nDisc 1\n5_Five": [(2, "One"), (3, "Two"), (4, "Three"), (4, "Four"), (1, "Five")],
        "A1 One\nA2 Two\nB1 Three\n04. Four": [(1, "One"), (1, "Two"), (2, "Three"), (2, "Four")],
        "late show\n01. One\n02. 0123456789abcdef0 x\n03. Three\nearly show\n04. Four": [(2, "One"), (2, "Three"), (1, "Four")],
    }
    assert dict(zip(cases, _setlists(spark, list(cases)))) == cases


def test_notes_and_assembly(spark):
    body = "Taj MAHAL, Bologna-Italy, 9 april 1978, SB\nVenue: The Hall\nCity: Bologna\n\n01. One\n02. Two\n03. Three"
    rows = [("/Tapes/X/1978-04-09 y", ["01 - a.flac"], body), ("/Tapes/Howard Jones/Encores", None, None), ("/Tapes/Various Artists/All Them Witches", [], ""), ("/Tapes/A/gd77-05-08.sbd", ["x"], "")]
    got = assemble.assemble(spark.createDataFrame(rows, "folder string, files array<string>, body string")).orderBy("folder").collect()
    by = {r.folder: r for r in got}
    assert by[rows[0][0]].artist == "Taj MAHAL" and by[rows[0][0]].date == "1978-04-09" and by[rows[0][0]].venue == "The Hall" and by[rows[0][0]].city == "Bologna"
    assert by[rows[1][0]].artist == "Howard Jones" and by[rows[2][0]].artist == "All Them Witches" and by[rows[3][0]].artist == "Grateful Dead"
    assert by[rows[3][0]].source.kind == "SBD"


def test_notes_lines(spark):
    f = lambda b: notes.parse_notes(spark.createDataFrame([(b,)], "body string")).first()
    r = f("Steel Pulse\nThe Palace, Hollywood, CA\n1983-01-02")
    assert (r.n_artist, r.n_venue, r.n_city, r.n_region, r.n_date) == ("Steel Pulse", "The Palace", "Hollywood", "CA", "1983-01-02")
    r = f("Venue Concertgebouw\nCity Amsterdam\nState Holland\nCountry Netherlands")
    assert (r.n_venue, r.n_city, r.n_region) == ("Concertgebouw", "Amsterdam", "Holland")
    assert f(None).n_artist is None and f("").n_venue is None


def test_history_and_stream(spark, tmp_path):
    known = spark.createDataFrame([("a", 1.0, "x", "s1"), ("b", 2.0, "y", None)], "folder string, mtime double, fingerprint string, signature string")
    new = spark.createDataFrame([("b", 3.0, "z", None), ("c", 1.0, "q", "s3")], known.schema)
    out = {r.folder: tuple(r)[1:] for r in history.upsert(known, new).collect()}
    assert out == {"a": (1.0, "x", "s1"), "b": (3.0, "z", None), "c": (1.0, "q", "s3")}
    src = tmp_path / "in"
    src.mkdir()
    known.write.json(str(src / "1"))
    new.write.json(str(src / "2"))
    q = run_upserts(spark.readStream.schema(known.schema).json(str(src / "*")), str(tmp_path / "t"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {r.folder: tuple(r)[1:] for r in upsert.read_state(spark, str(tmp_path / "t")).collect()} == out


def test_upsert_survives_a_crash(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(list(rows), "folder string, mtime double, fingerprint string, signature string")
    state = lambda: {r.folder: r.mtime for r in upsert.read_state(spark, target).collect()}
    upsert.apply_batch(df(("a", 1.0, "x", None), ("b", 1.0, "x", None)), "v0", target)
    second = df(("b", 2.0, "y", None), ("c", 2.0, "y", None))
    with monkeypatch.context() as m:
        m.setattr(upsert, "switch", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            upsert.apply_batch(second, "v1", target)
    assert state() == {"a": 1.0, "b": 1.0}  # the new version was written, but nothing points to it
    for _ in range(2):  # the batch runs again, and once more after the switch
        upsert.apply_batch(second, "v1", target)
        assert state() == {"a": 1.0, "b": 2.0, "c": 2.0}


def test_keepers(spark):
    m = spark.createDataFrame([("k", 1, 5, 2, 9.0), ("k", 2, 7, 1, 8.0), ("k", 3, 7, 3, 7.0), ("solo", 4, 1, 1, 1.0)], "cluster string, print_id int, bytes bigint, tracks int, mtime double")
    for s, want in (("largest", 2), ("most_tracks", 3), ("oldest", 3), ("newest", 1)):
        assert [r.print_id for r in dedupe.keepers(m, s).where("keep").collect()] == [want]


def test_candidates_and_prefixes(spark):
    r = spark.range(1).select(artists.candidates(F.lit("06 Bob Dylan-Highlights 1987 (x)")), source.detect(F.lit("akg AKG 414"))).first()
    assert r[0][:2] == ["06 Bob Dylan-Highlights 1987 (x)", "Bob Dylan-Highlights 1987 (x)"] and r[1].mics == ["AKG 414"]
    t = spark.createDataFrame([(b"x",)], "b binary").select(discover.checksum_body(F.lit("d41d8cd98f00b204e9800998ecf8427e *a\nd41d8cd98f00b204e9800998ecf8427e *b\nd41d8cd98f00b204e9800998ecf8427e *c"), F.lit(120))).first()
    assert t[0]
    h = "d41d8cd98f00b204"
    sums = {f"{h}  a b.flac\n# c\n\n{h} *b\n{h} c": True, f"a.flac:{h}\nb.shn:{h}\nc.mp3:{h}": True, "one 19770508\ntwo 19770508\nthree 19770508": False, f"{h} a\n{h} b": False, f"{h} a\n{h} b\nx\ny": False}
    got = spark.createDataFrame([(b,) for b in sums], "b string").select("b", discover.checksum_body(F.col("b"), F.lit(100)).alias("ok")).collect()
    assert {r.b: r.ok for r in got} == sums

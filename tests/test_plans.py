"""Folders with their discs, tags that differ, songs of sets, names from directories, skipping, whole records."""

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import assemble, discover, history, lexicon, stats
from tapeloom.plans import tags

TREE = ["A/1999-01-01 Show/02.flac", "A/1999-01-01 Show/01.flac", "A/1999-01-01 Show/b.txt", "A/1999-01-01 Show/a.txt", "A/Big Show/Disc 2/a.flac", "A/Big Show/Disc 1/b.flac", "A/Big Show/Disc 1/a.flac", "A/Big Show/Disc 1/x.txt", "B/show 2001 flac16/show 2001 flac16/t.mp3", "B/show 2001 flac16/n.txt", "B/.hid/x.flac", "C/art/x.jpg"]


def test_folders_with_their_discs(spark):
    files = spark.createDataFrame([(f"/lib/{p}", 9 if p.endswith("b.txt") else 1, "x") for p in TREE], "path string, size bigint, folder string")
    got = {r.folder[5:]: (r.how, [p.rsplit("/", 2)[-2] + "/" + p.rsplit("/", 1)[-1] for p in r.audio], r.info and r.info[5:]) for r in discover.enumerate_folders(files, "/lib").collect()}
    assert got == {
        "A/1999-01-01 Show": ("audio", ["1999-01-01 Show/01.flac", "1999-01-01 Show/02.flac"], "A/1999-01-01 Show/b.txt"),
        "A/Big Show": ("discs", ["Disc 1/a.flac", "Disc 1/b.flac", "Disc 2/a.flac"], "A/Big Show/Disc 1/x.txt"),
        "B/show 2001 flac16": ("wrapper", ["show 2001 flac16/t.mp3"], "B/show 2001 flac16/n.txt"),
    }
    assert discover.enumerate_folders(files.limit(0), "/lib").count() == 0
    dirs = spark.createDataFrame([("/a/x",), ("/a/.h",), ("/a/x/y",), ("/b/z",), ("/c/q",)], "dir string")
    assert [r.dir for r in discover.children_of_roots(dirs, spark.createDataFrame([("/a/",), ("/b",)], "root string")).collect()] == ["/a/x", "/b/z"]


PLAN = "file int, artist string, album string, date string, track int, title string, disc int, disc_total int, track_total int, minimal boolean, tags map<string,array<string>>"


def test_tags_that_differ(spark):
    had = {"ARTIST": ["A"], "albumartist": ["A"], "TRACKNUMBER": ["01/12"], "date": ["x"], "TITLE": [" t "], "ALBUM": ["X"]}
    rows = [
        (1, "A", "X", "1999", 1, "t", None, None, 12, False, had), (2, "A", "Y", "1999", 1, "t", None, None, 12, False, had), (3, "A", "X", "1999", 2, "t", None, None, None, False, {**had, "DISCTOTAL": ["2"]}), (4, "A", "X", "1999", 1, "t", 1, 2, 12, False, had),
        (5, "The A", "X", None, None, None, None, None, None, True, {}), (6, "A", "X", "1", 1, None, 9, 9, 9, True, {k: had[k] for k in ("ARTIST", "albumartist", "TRACKNUMBER", "ALBUM")}), (7, "A", "X", "", None, None, None, None, None, False, {"ARTIST": [""], "artist": ["B"]}), (8, "A", "X", "", None, None, None, None, None, False, None),
    ]
    plans = spark.createDataFrame(rows, PLAN)
    assert {r.file: r.outcome for r in tags.compared(plans).collect()} == {1: "unchanged", 2: "album_only", 3: "full", 4: "full", 5: "full", 6: "unchanged", 7: "full", 8: "full"}
    writes: dict = {}
    for r in tags.tag_writes(plans, "file").collect():
        writes.setdefault(r.file, {})[r.key] = r.value if r.op == "set" else r.op
    names = {"ARTIST": "A", "ARTISTSORT": "A", "ALBUMARTIST": "A", "ALBUMARTISTSORT": "A", "ALBUM": "X"}
    assert writes[2] == {"ALBUM": "Y"} and 1 not in writes and 6 not in writes
    assert writes[3] == names | {"TRACKNUMBER": "02", "DATE": "1999", "TITLE": "t", "DISCTOTAL": "delete"}
    assert writes[4] == names | {"TRACKNUMBER": "01", "DATE": "1999", "TITLE": "t", "DISCNUMBER": "1/2", "DISCTOTAL": "2", "TOTALDISCS": "2", "TRACKTOTAL": "12", "TOTALTRACKS": "12"}
    assert writes[5] == {"ARTIST": "The A", "ARTISTSORT": "A", "ALBUMARTIST": "The A", "ALBUMARTISTSORT": "A", "ALBUM": "X"} and writes[7] == writes[8] == names
    assert tags.outcome_counts(plans, "minimal").where("minimal").first()[1:] == (2, 1, 0, 1)
    r = spark.range(1).select(tags.destination(F.lit("/a/b/c"), "/a/", "/z"), tags.destination(F.lit("/ab/c"), "/a", "/z")).first()
    assert tuple(r) == ("/z/b/c", None)


def test_songs_of_sets(spark):
    kind = "sets array<struct<encore:int,song:array<struct<name:string,cover:struct<name:string>,tape:boolean>>>>"
    song = lambda n, c=None, t=None: (n, (c,) if c else None, t)
    rows = [([(None, [song("One", "Bob"), song(" "), song("Two", None, True)])],), ([(None, [song("One")]), (1, [song("Two")])],), ([],), (None,), ([(1, None)],)]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame(rows, kind).select(tags.songs_of_sets(F.col("sets"))).collect()]
    assert got == [[(None, "One (Bob cover)"), (None, "[Tape] Two")], [(1, "One"), (2, "Two")], [], [], []]


def test_names_from_directories(spark):
    lex = lexicon.build(spark.createDataFrame([("Bob Dylan", 5), ("The Band", 3), ("Rare", 1)], "name string, cnt bigint"), cnt=F.col("cnt"))
    rows = ["/x/Tapes/06 Bob Dylan-Highlights 1987/1987/1987-01-01 a", "/x/the band/Tapes/y", "/x/Various/Nobody/y", "/x/Various/The Band/y", "/x/The Band/1999-01-01 q/y", "/x/Rare/y", None, ""]
    got = {r.folder: r.artist for r in lexicon.from_ancestors(spark.createDataFrame([(f,) for f in rows], "folder string"), lex).collect()}
    assert got == {rows[0]: "Bob Dylan", rows[2]: "Various Artists", rows[3]: "The Band", rows[4]: "The Band"}


def test_whole_records(spark):
    shows = [(1, "/Tapes/Bob Dylan/1978-04-09 y", ["01 - One.flac", "02 - Two.flac"], "Boob Dylan\n1978-04-09\nThe Haall"), (2, "/Tapes/bob dylan/1978-04-10", None, None), (3, "/Tapes/bob dylan/1978-04-11", ["a", "b"], "01. A\n02. B\n03. C")]
    lex = lambda *n: lexicon.build(spark.createDataFrame([(x, 5) for x in n], "name string, cnt bigint"), cnt=F.col("cnt"))
    got = {r.k: r for r in assemble.assemble_whole(spark.createDataFrame(shows, "k int, folder string, files array<string>, body string"), "k", lex("Bob Dylan"), lex("The Hall")).collect()}
    assert (got[1].artist, got[1].venue, [t.title for t in got[1].tracks], got[1].issues, got[1].confidence) == ("Bob Dylan", "The Hall", ["One", "Two"], [], 0.9)
    assert (got[2].artist, got[2].date, got[2].tracks, got[2].issues) == ("Bob Dylan", "1978-04-10", [], [])
    assert [t.number for t in got[3].tracks] == [1, 2, 3] and got[3].issues == ["track count mismatch: 3 parsed vs 2 audio files"] and got[3].artist == "Bob Dylan"


def test_skipping(spark):
    now = spark.createDataFrame([(f, 2.0, "p", s) for f, s in (("same", "s"), ("moved", "s"), ("edited", "s"), ("failed", "s"), ("mute", None), ("new", "s"))], "folder string, mtime double, fingerprint string, signature string")
    known = spark.createDataFrame([("same", 2.0, "q", "t", "in-place", 0, None), ("moved", 1.0, "p", "t", "in-place", 0, None), ("edited", 1.0, "q", "s", "copy-to", 0, "/z"), ("failed", 2.0, "p", "s", "in-place", 1, None), ("mute", 2.0, "p", None, "in-place", 0, None)], "folder string, mtime double, fingerprint string, signature string, mode string, failed int, copy_to string")
    got = lambda *a, **k: {r.folder: r.reason for r in history.skips(now, known, *a, **k).collect()}
    assert got("in-place") == {"same": "mtime", "moved": "content", "mute": "mtime"} and got("in-place", rescan=True) == {}
    assert got("dry-run", audio=True) == {"same": "mtime", "moved": "content", "edited": "audio", "mute": "mtime"} and got("dry-run", rescan=True, audio=True) == {"moved": "content", "edited": "audio"}
    assert got("copy-to", "/z", audio=True) == {"edited": "audio"} and got("copy-to", "/y", audio=True) == {} and got("copy-to", audio=True) == {}


@pytest.mark.parametrize("body, kinds", [(["akg 414 and AKG  414", "sbd", None], {"SBD": 1, None: 1})])
def test_mining(spark, body, kinds):
    df = spark.createDataFrame([(b,) for b in body], "body string")
    assert [tuple(r) for r in stats.mine_mics(df).collect()] == [("akg 414", 2, True)]
    assert {r.kind: r.n for r in stats.source_kinds(df).collect()} == kinds

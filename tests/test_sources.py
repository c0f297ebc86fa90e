import json

from tapeloom.sources import files


def test_decode():
    assert files.decode(None) == "" and files.decode(b"") == ""
    assert files.decode("Füße".encode("utf-16")) .lstrip("\ufeff") == "Füße"
    assert files.decode("plain text".encode("utf-16-le")) == "plain text" and files.decode("plain text".encode("utf-16-be")) == "plain text"
    assert files.decode("é".encode()) == "é" and files.decode(b"caf\xe9") == "café" and files.decode(b"\x81x") == "\x81x"
    assert files.decode(rb"{\rtf1\ansi {\fonttbl{\f0 A;}}Artist\par Caf\'e9 \u8211?x}") == "Artist\nCafé –x"


def test_json_tables(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"schema": 1, "entries": {"/a": {"fingerprint": "f", "folder_mtime": 1.5}, "/b": {"scanned_at": "x"}}}))
    (tmp_path / "old.json").write_text(json.dumps({"schema": 2, "entries": {"/a": {"fingerprint": "f"}}}))
    (tmp_path / "bad.json").write_text("{")
    assert [r.folder for r in files.read_history(spark, str(tmp_path / "h.json")).collect()] == ["/a"]
    assert files.read_history(spark, str(tmp_path / "old.json")).count() == 0 and files.read_history(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "l.json").write_text(json.dumps({"schema": 1, "artists": {"A": 3, "B": "x"}, "venues": {"V": 2}}))
    assert {tuple(r) for r in files.read_lexicon(spark, str(tmp_path / "l.json")).collect()} == {("artist", "A", 3), ("venue", "V", 2)}
    (tmp_path / "d.json").write_text(json.dumps([{"folder": "/x", "artist": "A", "tracks": [{"number": 1, "title": "t"}], "more": 1}]))
    s = files.read_shows(spark, str(tmp_path / "d.json"))
    assert s.first().tracks[0].title == "t"
    files.write_shows(s, str(tmp_path / "out"))
    assert spark.read.schema(files.SHOW).json(str(tmp_path / "out")).first().artist == "A"
    (tmp_path / "log.jsonl").write_text('{"identifier":"i","venue":"first"}\n{broken\n{"identifier":"i","venue":"second"}\n{"identifier":"e","error":"x"}\n')
    assert [(r.identifier, r.venue) for r in files.read_log(spark, str(tmp_path / "log.jsonl")).collect()] == [("i", "first")]


def test_read_notes_of_any_size(spark, tmp_path):
    (tmp_path / "small.txt").write_bytes(b"x")
    (tmp_path / "large.txt").write_bytes(b"y" * ((1 << 20) + 1))
    assert {r.path[-9:]: len(r.body) for r in files.read_notes(spark, str(tmp_path)).collect()} == {"small.txt": 1, "large.txt": (1 << 20) + 1}
    assert {r.path[-9:]: r.body for r in files.read_notes(spark, str(tmp_path), 10).collect()} == {"small.txt": "x", "large.txt": None}


def test_read_notes(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.txt").write_bytes(b"caf\xe9")
    assert [r.body for r in files.read_notes(spark, str(tmp_path / "n")).collect()] == ["café"]
    names = [("i", "x.txt", 9), ("i", "my info.txt", 1), ("j", "b.txt", 2), ("j", "a.txt", 2), ("k", "_info.txt", 9), ("k", "x ffp.txt", 8), ("k", "md5.TXT", 8), ("k", "README.txt", 1), ("k", "y.txt", 7), ("l", "notes.doc", 1)]
    f = spark.createDataFrame(names, "identifier string, name string, size int")
    assert {r.identifier: r.name for r in files.best_notes(f).collect()} == {"i": "my info.txt", "j": "a.txt", "k": "README.txt"}

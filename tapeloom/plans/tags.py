"""Rows to write per file: tracks and files paired by place, or files alone; and what of them differs from the tags there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, sort_key
from ..operators.setlist import disc_and_track_of_file


def paired(tracks: DataFrame, files: DataFrame, key: str = "show", by: tuple[str, ...] = ("pos",), file_by: tuple[str, ...] = ("path",), keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, place, path, title, number, disc, disc_total, track_total, track_text, disc_text``.

    The k-th track goes to the k-th file by name, as far as both go. `tracks(key, pos, title, number, disc, disc_total)`,
    `files(key, path)`; places are counted per show. Columns of the tracks in `keep` stay.
    """
    t = tracks.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*by)))
    t = t.withColumn("track_total", F.count(F.lit(1)).over(Window.partitionBy(key, "disc")).cast("int"))
    f = files.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*file_by)))
    j = t.join(f, [key, "k"])
    disc = F.when(F.col("disc").isNotNull(), F.concat_ws("/", F.col("disc").cast("string"), F.col("disc_total").cast("string")))
    return j.select(key, F.col("k").alias("place"), "path", "title", "number", "disc", "disc_total", "track_total", F.format_string("%02d", "number").alias("track_text"), disc.alias("disc_text"), *keep)


def files_only(files: DataFrame, key: str = "show", by: tuple[str, ...] = ("path",), existing: Column | None = None) -> DataFrame:
    """``key, path, track, disc``: none where a file has a track number (`existing`) already, else the numbers its name tells,
    else its place."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    x = files.withColumns({"told": disc_and_track_of_file(F.col("path")), "place": place, "free": F.lit(True) if existing is None else existing.isNull()})
    return x.select(key, "path", F.when(F.col("free"), F.coalesce("told.track", "place")).alias("track"), F.when(F.col("free"), F.col("told.disc")).alias("disc"))


def enrich(shows: DataFrame, found: DataFrame, key: str = "show") -> DataFrame:
    """Local values win; `found(key, venue, city, region, songs, rank)` fills what is missing, the first whose venue agrees
    with the local one, else the first of all. Adds ``songs_action``: fill, overwrite, confirm or none."""
    from ..functions.text import filled
    from ..operators.stats import agrees

    j = shows.select(key, F.col("venue").alias("v")).join(found, key)
    best = j.groupBy(key).agg(F.min_by(F.struct("venue", "city", "region", "songs"), F.struct((~agrees(F.col("v"), F.col("venue"))).cast("int"), "rank")).alias("e"))
    x = shows.join(best, key, "left")
    songs = F.size(F.coalesce("e.songs", F.array().cast("array<string>")))
    action = F.when(songs == 0, "none").when(F.col("tracks") == 0, "fill").when(F.col("tracks") == songs, "confirm").otherwise("overwrite")
    return x.select(key, *[F.coalesce(filled(F.col(c)), F.col(f"e.{c}")).alias(c) for c in ("venue", "city", "region")], "tracks", songs.alias("songs"), action.alias("songs_action"))


def destination(path: Column, root: str, to: str) -> Column:
    """Where a copy of a file below `root` goes below `to`; null for a path that isn't below it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.concat(F.lit(to.rstrip("/") + "/"), F.substring(path, len(base) + 1, 1 << 30)))


def tag(tags: Column, *keys: str) -> Column:
    """The first value that isn't blank of the tags ``map<string,array<string>>`` under any of the keys."""
    return F.coalesce(*[filled(F.try_element_at(F.try_element_at(tags, F.lit(k)), F.lit(1))) for k in keys])


def _both(key: str) -> tuple[str, str]:
    return key, key.lower()


DISC_KEYS, TOTAL_KEYS = ("DISCNUMBER", "DISCTOTAL", "TOTALDISCS"), ("TRACKTOTAL", "TOTALTRACKS")


def compared(plans: DataFrame) -> DataFrame:
    """Adds ``outcome``: `unchanged` where the file's tags say all that the plan does, `album_only` where but the album differs,
    else `full`.

    `plans`: artist, album, date, track, title, disc, disc_total, track_total, minimal, tags. Artist, album artist and track number
    must be equal, of date, title and disc any value is good; a minimal plan asks for the former only.
    """
    t = F.col("tags")
    artist, own = tag(t, *_both("ARTIST")), tag(t, *_both("ALBUMARTIST"))
    number = F.trim(F.substring_index(tag(t, *_both("TRACKNUMBER")), "/", 1)).try_cast("int")
    artists = F.when(F.coalesce(F.col("artist"), F.lit("")) != "", (artist == F.col("artist")) & (own == F.col("artist"))).otherwise(artist.isNotNull())
    there = lambda wanted, key: ~wanted | tag(t, *_both(key)).isNotNull()
    rest = there(F.coalesce(F.col("date"), F.lit("")) != "", "DATE") & there(F.col("title").isNotNull(), "TITLE") & there(F.col("disc").isNotNull() & F.col("disc_total").isNotNull(), "DISCNUMBER")
    same = F.coalesce(artists, F.lit(False)) & (F.col("track").isNull() | F.coalesce(number == F.col("track"), F.lit(False))) & (F.col("minimal") | rest)
    first = lambda k: F.try_element_at(F.try_element_at(t, F.lit(k)), F.lit(1))
    album = F.coalesce(first("ALBUM"), first("album"), F.lit(""))
    return plans.withColumn("outcome", F.when(~same, "full").when(album == F.col("album"), "unchanged").otherwise("album_only"))


def tag_writes(plans: DataFrame, *keys: str) -> DataFrame:
    """``*keys, key, value, op``: a row for each tag to set or delete, of plans as of :func:`compared`.

    Disc and total tags that a plan with a track number doesn't fill are deleted where they are there. Files that are unchanged
    have no row."""
    x = compared(plans)
    full, more = F.col("outcome") == "full", (F.col("outcome") == "full") & ~F.col("minimal")
    sort = sort_key(F.col("artist"))
    discs, total = F.col("disc").isNotNull() & F.col("disc_total").isNotNull(), F.col("track_total").isNotNull()
    put = lambda when, key, value: F.when(when, F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"), F.lit("set").alias("op")))
    drop = lambda when, key: F.when(when & F.coalesce(F.map_contains_key("tags", key), F.lit(False)), F.struct(F.lit(key).alias("key"), F.lit(None).cast("string").alias("value"), F.lit("delete").alias("op")))
    numbered = F.col("track").isNotNull()
    ops = [
        put(full, "ARTIST", F.col("artist")), put(full, "ARTISTSORT", sort), put(full, "ALBUMARTIST", F.col("artist")), put(full, "ALBUMARTISTSORT", sort),
        put(F.col("outcome").isin("full", "album_only"), "ALBUM", F.col("album")), put(full & numbered, "TRACKNUMBER", F.format_string("%02d", "track")),
        put(more & (F.coalesce(F.col("date"), F.lit("")) != ""), "DATE", F.col("date")), put(more & F.col("title").isNotNull(), "TITLE", F.col("title")),
        put(more & discs, "DISCNUMBER", F.concat_ws("/", F.col("disc").cast("string"), F.col("disc_total").cast("string"))), *[put(more & discs, k, F.col("disc_total")) for k in DISC_KEYS[1:]],
        *[put(more & total, k, F.col("track_total")) for k in TOTAL_KEYS], *[drop(more & ~discs & numbered, k) for k in DISC_KEYS], *[drop(more & ~total & numbered, k) for k in TOTAL_KEYS],
    ]
    return x.select(*keys, F.inline(F.filter(F.array(*ops), lambda o: o.isNotNull())))


def outcome_counts(plans: DataFrame, key: str = "show") -> DataFrame:
    """``key, files, unchanged, album_only, full`` of plans as of :func:`compared`: one aggregate with partial counts."""
    return compared(plans).groupBy(key).agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("unchanged", "album_only", "full")])


def songs_of_sets(sets: Column) -> Column:
    """array of struct(disc, title) of ``array<struct<encore, song array<struct<name, cover struct<name>, tape>>>>``.

    Discs are the sets' places, null where there is but one set and no encore. Covers and tapes are marked; songs without a name
    are left out."""
    many = (F.size(sets) > 1) | F.exists(sets, lambda s: F.coalesce(s["encore"], F.lit(0)) != 0)

    def of_song(o: Column, disc: Column) -> Column:
        cover = filled(o["cover"]["name"])
        name = F.concat(filled(o["name"]), F.when(cover.isNotNull(), F.concat(F.lit(" ("), o["cover"]["name"], F.lit(" cover)"))).otherwise(F.lit("")))
        return F.struct(disc.alias("disc"), F.when(F.coalesce(o["tape"], F.lit(False)), F.concat(F.lit("[Tape] "), name)).otherwise(name).alias("title"))

    of_set = lambda s, i: F.transform(F.coalesce(s["song"], F.array()), lambda o: of_song(o, F.when(many, i + 1)))
    return F.filter(F.flatten(F.transform(F.coalesce(sets, F.array()), of_set)), lambda t: t["title"].isNotNull())


def enrichment_counts(shows: DataFrame, enriched: DataFrame, found: DataFrame, key: str = "show") -> DataFrame:
    """One row ``matched, changed, missed``: shows with something found, of these the ones that it filled in, and the rest."""
    hit = found.select(key).distinct().withColumn("hit", F.lit(True))
    cols = ("venue", "city", "region")
    e = enriched.select(key, *[F.col(c).alias(f"e_{c}") for c in cols])
    x = shows.select(key, *cols).join(hit, key, "left").join(e, key, "left")
    new = F.lit(False)
    for c in cols:
        new = new | (filled(F.col(c)).isNull() & F.col(f"e_{c}").isNotNull())
    return x.agg(F.count_if("hit").alias("matched"), F.count_if(F.col("hit") & new).alias("changed"), F.count_if(F.col("hit").isNull()).alias("missed"))

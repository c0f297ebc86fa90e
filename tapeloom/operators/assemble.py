"""One record per show from folder, file names and notes: every candidate a column, precedence as coalesce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import artists as A
from ..functions.dates import parse_date
from ..functions.lines import city_of_folder, is_prose
from ..functions.source import detect, label
from ..functions.text import filled, path_name
from ..session import broadcast_if_small, cut
from .lexicon import from_ancestors, match
from .notes import parse_notes
from .setlist import finalize, setlist, tracks_of_files


def album_name(date: Column, venue: Column, city: Column, region: Column, source: Column) -> Column:
    """`1977-05-08 Venue, City, ST [SBD]`, blanks left out."""
    full = lambda c: F.nullif(c, F.lit(""))
    place = F.concat_ws(", ", full(venue), full(city), full(region))
    return F.concat_ws(" ", full(date), full(place), full(label(source)))


def confidence(artist: Column, date: Column, venue: Column, city: Column, tracks: Column, audio: Column) -> Column:
    """0 to 1 in whole hundredths: .25 artist, .25 date, .15 venue, .10 city; .25 if tracks and files agree, else .05 if there are both."""
    has = lambda c: F.coalesce(filled(c).isNotNull(), F.lit(False)).cast("int")
    t, a = F.coalesce(tracks, F.lit(0)), F.coalesce(audio, F.lit(0))
    counts = F.when((t > 0) & (a > 0), F.when(t == a, 25).otherwise(5)).otherwise(0)
    return (has(artist) * 25 + has(date) * 25 + has(venue) * 15 + has(city) * 10 + counts) / F.lit(100.0)


def issues(artist: Column, date: Column, tracks: Column, audio: Column) -> Column:
    t, a = F.coalesce(tracks, F.lit(0)), F.coalesce(audio, F.lit(0))
    return F.filter(F.array(
        F.when(filled(artist).isNull(), "artist unknown"), F.when(filled(date).isNull(), "date unknown"),
        F.when((t == 0) & (a > 0), "no setlist found").when((t > 0) & (t != a), F.format_string("track count mismatch: %d parsed vs %d audio files", t, a)),
    ), lambda x: x.isNotNull())


def tolerance(tracks: Column, audio: Column, override: Column | None = None) -> Column:
    """How far counts may differ: the override if not negative, else the larger of 2 and 15 % of the smaller count, rounded up."""
    least = F.least(tracks, audio)
    own = F.greatest(F.lit(2), ((least * 15 + 99) / 100).cast("int"))
    return own if override is None else F.when(override >= 0, override).otherwise(own)


def _matched(d: DataFrame, col: str, lexicon: DataFrame, out: str, where: str = "true") -> DataFrame:
    """Adds `out`, the lexicon's spelling of `col`: each distinct name of the rows `where` is matched once; the answers are
    broadcast if small."""
    known = cut(match(d.where(where).select(F.col(col).alias("name")), lexicon)).select(F.col("name").alias(col), F.col("match").alias(out))
    return d.join(broadcast_if_small(known), col, "left")


def assemble(shows: DataFrame, artists: DataFrame | None = None, venues: DataFrame | None = None) -> DataFrame:
    """``folder, artist, date, venue, city, region, source`` and the candidates, of ``folder, files array<string>, body``.

    artist: notes, else folder; a sentence gives way to a name that the lexicon finds in it, else to the folder; then the
    lexicon's spelling, or, without an artist, the directory above that the lexicon knows; else the directory above; inside
    `Various Artists` the folder's own name; else the folder's weak reading. date: folder, file names, notes. venue: notes, in
    the lexicon's spelling. `artists`, `venues`: lexicons as of ``lexicon.build``, or none.
    """
    d = parse_notes(shows)
    files = F.array_join(F.coalesce("files", F.array().cast("array<string>")), "  ")
    d = d.withColumns({"_name": path_name(F.col("folder")), "_files": files})
    d = d.withColumns({"artist_folder": A.guess(F.col("_name")), "artist_parent": A.trust_parent(F.col("folder")), "artist_weak": A.weak(F.col("_name")), "various": A.in_various(F.col("folder")), "_city": city_of_folder(F.col("_name"))})
    d = d.withColumn("_source", detect(F.col("_name"), F.col("_files"), F.col("body")))  # before the names are matched, so once
    d = d.withColumn("_said", F.coalesce("n_artist", "artist_folder")).withColumn("_prose", F.coalesce(is_prose(F.col("_said")), F.lit(False)))
    d = d.withColumn("_known", F.lit(None).cast("string"))
    if artists is not None:
        d = _matched(cut(d.drop("_known")), "_said", artists, "_known", "_prose")
    d = d.withColumn("artist_read", F.when(F.col("_prose"), F.coalesce("_known", "artist_folder")).otherwise(F.col("_said")))
    first, venue = F.col("artist_read"), F.col("n_venue")
    if artists is not None:
        d = _matched(d, "artist_read", artists, "_spelled")
        above = from_ancestors(d.where("artist_read is null"), artists).select("folder", F.col("artist").alias("_above"))
        d = d.join(broadcast_if_small(cut(above)), "folder", "left")
        first = F.coalesce("_spelled", "artist_read", "_above")
    if venues is not None:
        d = _matched(d, "n_venue", venues, "_place")
        venue = F.coalesce("_place", "n_venue")
    first = F.coalesce(first, F.col("artist_parent"))
    artist = F.when(F.col("various") & F.col("artist_weak").isNotNull(), F.col("artist_weak")).otherwise(F.coalesce(first, F.col("artist_weak")))
    return d.select(
        *shows.columns, "artist_read", "artist_folder", "artist_parent", "artist_weak",
        filled(artist).alias("artist"), F.coalesce(parse_date(F.col("_name")), parse_date(F.col("_files")), F.col("n_date")).alias("date"), filled(venue).alias("venue"),
        F.coalesce("n_city", F.col("_city.city")).alias("city"), F.coalesce("n_region", F.when(F.col("n_city").isNull(), F.col("_city.region"))).alias("region"),
        F.col("_source").alias("source"),
    )


def tracks_of(shows: DataFrame, key: str) -> DataFrame:
    """``key, tracks array<struct<number, title, disc, disc_total>>`` of ``key, files, body``: the notes' setlist, else what the
    file names say, else an empty array. `key` is unique."""
    raw = setlist(shows, key, "body").select(key, F.posexplode("raw").alias("pos", "x")).select(key, "pos", "x.disc", "x.title")
    told = finalize(raw, [key]).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "number", "title", "disc", F.col("disc_total").cast("int").alias("disc_total")))).alias("told"))
    null = F.lit(None).cast("int")
    one = lambda n, t, d, m: F.struct(n.alias("number"), t.alias("title"), d.alias("disc"), m.alias("disc_total"))
    named = F.transform(tracks_of_files(F.coalesce("files", F.array().cast("array<string>"))), lambda x: one(x["number"], x["title"], null, null))
    x = shows.select(key, "files").join(told, key, "left")
    return x.select(key, F.coalesce(F.transform("told", lambda x: one(x["number"], x["title"], x["disc"].cast("int"), x["disc_total"])), named).alias("tracks"))


def assemble_whole(shows: DataFrame, key: str, artists: DataFrame | None = None, venues: DataFrame | None = None) -> DataFrame:
    """:func:`assemble` of ``key, folder, files, body`` with ``tracks, issues, confidence, album``."""
    d = assemble(shows, artists, venues).join(tracks_of(shows, key), key)
    n, files = F.size("tracks"), F.greatest(F.size(F.coalesce("files", F.array().cast("array<string>"))), F.lit(0))
    return d.withColumns({
        "issues": issues(F.col("artist"), F.col("date"), n, files), "confidence": confidence(F.col("artist"), F.col("date"), F.col("venue"), F.col("city"), n, files),
        "album": album_name(F.col("date"), F.col("venue"), F.col("city"), F.col("region"), F.col("source")),
    })

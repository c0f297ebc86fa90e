"""Recording folders in a file listing: which directories are shows, which are discs of one, which only wrap another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import has_date_shape
from ..functions.lines import CHECKSUM_LINE
from ..functions.text import extension, path_name, strip
from ..session import cut
from .setlist import LINE_BREAK, disc_of_name

#: Fixed values.
AUDIO = (".flac", ".mp3", ".m4a", ".ogg", ".opus", ".wav", ".aif", ".aiff")
INFO = (".txt", ".nfo", ".info", ".md", ".rtf")
INFO_NAMES = ("info", "notes", "setlist", "tracks", "readme", "tracklist")
CHECKSUM_HINTS = ("ffp", "fpt", "md5", "sha", "shntool", "audiochecker", "aucdtect", "sbeok", "foo_dr", "artwork", "demonoid", "tau analyzer", "tauanalyzer")
WRAPPERS = ("flac", "flac16", "flac24", "flac1644", "flac2448", "mp3", "wav", "shn", "shnf", "audio", "files", "music", "tracks", "songs", "cd", "single cd", "compact disc")
QUALITY = r"(?i)^(?:flac\d*|mp3|wav|shn|shnf|\d{1,2}bit|\d{2,3}(?:\.\d)?khz|hd|hires|hi-res|lossless|audio|files|music|tracks|songs|cd|disc)$"
SUFFIX = r"(?i)^(.*?)[\s_\-]*(\d{1,2}|one|two|three|four|five|six|seven|eight)\s*$"
MAX_DEPTH = 8


def file_kind(name: Column) -> Column:
    """`audio`, `info` or null of a file name; hidden files and checksum files are neither."""
    low, ext = F.lower(name), extension(name)
    hinted = F.lit(False)
    for h in CHECKSUM_HINTS:
        hinted = hinted | low.contains(h)
    return F.when(name.startswith("."), F.lit(None).cast("string")).when(ext.isin(*AUDIO), "audio").when((ext.isin(*INFO) | low.isin(*INFO_NAMES)) & ~hinted, "info")


def checksum_body(body: Column, size: Column) -> Column:
    """True if a small text is a checksum list: of the lines in its first 4096 characters, comments aside, there are three and
    at least 60 % are a hash with a file or a file with a hash."""
    ls = F.filter(F.transform(F.split(F.substring(body, 1, 4096), LINE_BREAK), strip), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith(";"))
    hits = F.size(F.filter(ls, lambda x: x.rlike(CHECKSUM_LINE)))
    return F.coalesce((size > 0) & (size <= 16384) & (F.size(ls) >= 3) & (hits * 10 >= F.size(ls) * 6), F.lit(False))


def is_wrapper(outer: Column, inner: Column) -> Column:
    """Is `inner` only the unpacked archive of `outer`: the same name, a format's name, or the name plus formats?"""
    o, i = F.lower(F.trim(outer)), F.lower(F.trim(inner))
    short, long = F.when(F.length(o) <= F.length(i), o).otherwise(i), F.when(F.length(o) <= F.length(i), i).otherwise(o)
    tail = F.regexp_replace(F.substring(long, F.length(short) + 1, F.length(long)), r"^[ \-_.()\[\]{}]+|[ \-_.()\[\]{}]+$", "")
    marks = F.forall(F.filter(F.split(tail, r"[\s\-_]+"), lambda t: t != ""), lambda t: t.rlike(QUALITY))
    longer = (F.length(short) >= 6) & long.startswith(short) & ((tail == "") | tail.isin(*WRAPPERS) | marks)
    return F.coalesce((o != "") & (i != "") & ((o == i) | i.isin(*WRAPPERS) | longer), F.lit(False))


def directories(files: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``dir, parent, name, audio, infos`` of every directory on the way to a file of `path, size`; hidden ones and those
    named in `exclude` vanish with all below them."""
    f = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), path_name(F.col("path")).alias("name"))
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    hidden = F.exists(parts, lambda p: p.startswith(".") | F.lower(p).isin(*[e.lower() for e in exclude], ""))
    f = f.where(~hidden).withColumn("kind", file_kind(F.col("name")))
    own = f.groupBy("dir").agg(F.count_if(F.col("kind") == "audio").alias("audio"), F.count_if(F.col("kind") == "info").alias("infos"))
    up = own.select("dir", F.filter(F.split("dir", "/"), lambda p: p != "").alias("p")).where(F.size("p") > 0)
    all_ = up.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.concat(F.lit("/"), F.array_join(F.slice("p", 1, n), "/")))).alias("dir")).distinct()
    d = all_.join(own, "dir", "left").na.fill(0, ["audio", "infos"])
    return d.withColumn("parent", F.regexp_replace("dir", "/[^/]*$", "")).withColumn("name", path_name(F.col("dir")))


def disc_parents(dirs: DataFrame) -> DataFrame:
    """``dir, discs`` of directories that hold the discs of one show: at least two children with audio, all marked with one
    base and different discs; or one shared prefix with different endings, if the parent has notes or a date."""
    kids = dirs.where("audio > 0").select(F.col("parent").alias("dir"), "name", disc_of_name(F.trim("name")).alias("m"))
    low = F.lower(F.trim(F.regexp_extract(F.trim("name"), SUFFIX, 1)))
    kids = kids.withColumns({"pre": F.when(F.trim("name").rlike(SUFFIX), F.regexp_replace(low, r"[ \-_]+$", "")), "suf": F.when(F.trim("name").rlike(SUFFIX), F.lower(F.regexp_extract(F.trim("name"), SUFFIX, 2)))})
    g = kids.groupBy("dir").agg(
        F.count(F.lit(1)).alias("n"), F.count("m").alias("marked"), F.countDistinct("m.base").alias("bases"), F.countDistinct("m.idx").alias("idxs"),
        F.count("pre").alias("ended"), F.countDistinct("pre").alias("pres"), F.countDistinct("suf").alias("sufs"),
    ).where("n >= 2")
    g = g.join(dirs.select("dir", "infos", "name"), "dir")
    strict = (F.col("marked") == F.col("n")) & (F.col("bases") == 1) & (F.col("idxs") == F.col("n"))
    loose = (F.col("ended") == F.col("n")) & (F.col("pres") == 1) & (F.col("sufs") == F.col("n")) & ((F.col("infos") > 0) | has_date_shape(F.col("name")))
    return g.where(strict | loose).select("dir", F.col("n").alias("discs"))


def candidates(files: DataFrame, root: str, max_depth: int = MAX_DEPTH, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``dir, how``: the show folders below `root`. A folder with audio is one; a parent of discs is one in their place; a
    folder whose only child merely wraps the unpacked archive stands for that child. Sorted by path."""
    d = cut(directories(files.where(F.col("path").startswith(root.rstrip("/") + "/")), exclude))
    level = F.size(F.filter(F.split("dir", "/"), lambda p: p != "")) - len([p for p in root.split("/") if p])
    d = d.where(F.col("dir").startswith(root.rstrip("/") + "/")).where(level <= max_depth)
    discs = disc_parents(d).select(F.col("dir"), F.lit("discs").alias("how"))
    only = d.groupBy(F.col("parent").alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.first("dir").alias("kid"), F.first("name").alias("kid_name"), F.first("audio").alias("kid_audio")).where("n = 1")
    wrap = d.where("audio = 0").join(only, "dir").where((F.col("kid_audio") > 0) & is_wrapper(F.col("name"), F.col("kid_name"))).select("dir", "kid")
    own = d.where("audio > 0").select("dir", "parent")
    own = own.join(discs.select(F.col("dir").alias("parent")), "parent", "left_anti").join(wrap.select(F.col("kid").alias("dir")), "dir", "left_anti")
    return own.select("dir", F.lit("audio").alias("how")).unionAll(discs).unionAll(wrap.select("dir", F.lit("wrapper").alias("how"))).orderBy("dir")


def enumerate_folders(files: DataFrame, root: str, max_depth: int = MAX_DEPTH, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``folder, how, audio, info``: the show folders of `files(path, size)` below `root` with the paths of their audio files in
    order and of their info file.

    A folder's own audio stands by name. The discs of one show stand one after the other, by disc, then by name; a wrapped
    folder's audio stands for the wrapper's. The info file is the folder's own, else the first disc's that has one: the largest,
    then by name.
    """
    shows = cut(candidates(files, root, max_depth, exclude))
    f = files.select("path", "size", F.regexp_replace("path", "/[^/]*$", "").alias("host"), path_name(F.col("path")).alias("name")).withColumn("kind", file_kind(F.col("name"))).where("kind is not null")
    below = f.where("kind = 'audio'").select("host").distinct().select("host", F.regexp_replace("host", "/[^/]*$", "").alias("folder"))
    own = shows.where("how = 'audio'").select(F.col("dir").alias("folder"), "how", F.col("dir").alias("host"))
    inner = shows.where("how != 'audio'").select(F.col("dir").alias("folder"), "how").join(below, "folder").select("folder", "how", "host")
    hosts = own.unionAll(inner).withColumn("at", F.struct(F.coalesce(disc_of_name(F.trim(path_name(F.col("host"))))["idx"], F.lit(0)).alias("disc"), F.lower(path_name(F.col("host"))).alias("name")))
    audio = hosts.join(f.where("kind = 'audio'"), "host").groupBy("folder", "how").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name", "path"))), lambda x: x["path"]).alias("audio"))
    at_home = hosts.select("folder", "host", F.lit(1).alias("level"), "at").unionAll(shows.select(F.col("dir").alias("folder"), F.col("dir").alias("host"), F.lit(0), F.struct(F.lit(0).alias("disc"), F.lit("").alias("name"))))
    infos = at_home.join(f.where("kind = 'info'"), "host").groupBy("folder").agg(F.min_by("path", F.struct("level", "at", -F.coalesce("size", F.lit(-1)), "name")).alias("info"))
    return audio.join(infos, "folder", "left").select("folder", "how", "audio", "info")


def children_of_roots(dirs: DataFrame, roots: DataFrame) -> DataFrame:
    """``dir`` of the directories right below any of the `roots(root)`, hidden ones left out, sorted and each once."""
    r = roots.select(F.regexp_replace("root", "/+$", "").alias("parent")).distinct()
    up = dirs.select("dir", F.regexp_replace("dir", "/[^/]*$", "").alias("parent")).where(~path_name(F.col("dir")).startswith("."))
    return up.join(r, "parent", "left_semi").select("dir").distinct().orderBy("dir")

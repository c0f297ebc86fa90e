"""Query name to function over the given tables, and to the SQL whose result it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import artists, lines, source, text
from .functions.dates import first_date_end, first_date_position, parse_date
from .operators import assemble, dedupe, discover, history, lexicon, notes, setlist, stats
from .plans import tags
from .session import by_key, ship, spread_if_few, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _values(rows: list[tuple], names: str) -> str:
    """A VALUES query; None is a null."""
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


def _vectors(name: str, rows: list[tuple], expr: Callable[[Column], Column], kind: str = "string", sql_type: str = "VARCHAR") -> None:
    """A query over inline texts whose expected values are its SQL."""

    def f(s: SparkSession, d: str) -> DataFrame:
        ship(s)
        return s.createDataFrame([(r[0],) for r in rows], "t string").select("t", expr(F.col("t")).cast(kind).alias("got"))

    QUERIES[name] = f
    SQL[name] = f"SELECT t, got::{sql_type} AS got FROM ({_values(rows, 't, got')})"


# --- shared shapes -------------------------------------------------------------------------------------------------

FILES_SQL = "SELECT concert_id AS show_id, i AS idx, t.path AS path FROM (SELECT concert_id, unnest(tracks) AS t, generate_subscripts(tracks, 1) AS i FROM folder_prints)"
EXT_SQL = f"SELECT show_id, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS ext, count(*) AS n FROM ({FILES_SQL}) GROUP BY 1, 2"
FILLED = "nullif(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '')"
COUNTS_SQL = "SELECT c.*, coalesce(t.n, 0) AS n_tracks, coalesce(len(p.tracks), 0) AS n_audio FROM concerts c LEFT JOIN (SELECT concert_id, count(*) AS n FROM tracks GROUP BY 1) t USING (concert_id) LEFT JOIN folder_prints p USING (concert_id)"
CONF_SQL = f"""(CASE WHEN {FILLED.format("artist")} IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN {FILLED.format("show_date")} IS NOT NULL THEN 25 ELSE 0 END
 + CASE WHEN {FILLED.format("venue")} IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN {FILLED.format("city")} IS NOT NULL THEN 10 ELSE 0 END
 + CASE WHEN n_tracks > 0 AND n_audio > 0 THEN CASE WHEN n_tracks = n_audio THEN 25 ELSE 5 END ELSE 0 END)"""
KEY_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^the\\s+', ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "folder_prints").select(F.col("concert_id").alias("show"), F.posexplode(F.col("tracks.path")).alias("idx", "path"))


def _exts(s: SparkSession, d: str) -> DataFrame:
    f = _files(s, d)
    return f.select("show", F.regexp_replace(text.extension(F.col("path")), r"^\.", "").alias("ext"), F.lit(1).alias("n"))


def _counted(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "tracks").groupBy("concert_id").agg(F.count(F.lit(1)).alias("n_tracks"))
    p = table(s, d, "folder_prints").select("concert_id", F.size(F.col("tracks.path")).alias("n_audio"))
    return table(s, d, "concerts").join(t, "concert_id", "left").join(p, "concert_id", "left").na.fill(0, ["n_tracks", "n_audio"])


def _confidence() -> Column:
    return assemble.confidence(F.col("artist"), F.col("show_date"), F.col("venue"), F.col("city"), F.col("n_tracks"), F.col("n_audio"))


# --- reports -------------------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT concert_id AS show_id, coalesce({FILLED.format("artist")}, '(unknown)') AS artist, {FILLED.format("show_date")} AS date FROM concerts),
f AS ({EXT_SQL}), x AS (SELECT artist, ext, sum(n) AS n FROM s LEFT JOIN f USING (show_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY n DESC, ext) AS r FROM x WHERE ext IS NOT NULL),
m AS (SELECT artist, string_agg(ext || ':' || n::BIGINT::VARCHAR, ', ' ORDER BY r) AS formats FROM r WHERE r <= 3 GROUP BY 1)
SELECT s.artist, count(*) AS shows, any_value(t.n)::BIGINT AS tracks, min(date) AS first_date, max(date) AS last_date, coalesce(any_value(m.formats), '') AS formats
FROM s LEFT JOIN m ON m.artist = s.artist LEFT JOIN (SELECT artist, coalesce(sum(n), 0) AS n FROM x GROUP BY 1) t ON t.artist = s.artist GROUP BY s.artist""")
def artist_report(s, d):
    return stats.artist_report(table(s, d, "concerts").select(F.col("concert_id").alias("show"), "artist", F.col("show_date").alias("date")), _exts(s, d))


@query(f"WITH x AS (SELECT ext, sum(n)::BIGINT AS n FROM ({EXT_SQL}) GROUP BY 1) SELECT ext, n, floor(n * 1000 / sum(n) OVER ())::BIGINT AS permille FROM x")
def format_mix(s, d):
    return stats.format_mix(_exts(s, d))


@query(f"""WITH c AS (SELECT *, {CONF_SQL} AS conf FROM ({COUNTS_SQL}))
SELECT count(*) AS shows, count(*) FILTER ({FILLED.format("artist")} IS NULL) AS no_artist, count(*) FILTER ({FILLED.format("show_date")} IS NULL) AS no_date,
count(*) FILTER (conf < 50) AS low_confidence, count(*) FILTER (n_tracks = 0) AS no_setlist, count(DISTINCT {FILLED.format("artist")}) AS artists, floor(avg(conf) * 100)::BIGINT AS mean_confidence_bp FROM c""")
def library_health(s, d):
    return stats.health(_counted(s, d).select("artist", F.col("show_date").alias("date"), _confidence().alias("confidence"), F.col("n_tracks").alias("tracks")))


@query(f"SELECT concert_id, {CONF_SQL}::INTEGER AS confidence_pct FROM ({COUNTS_SQL})")
def confidence_score(s, d):
    return _counted(s, d).select("concert_id", F.round(_confidence() * 100).cast("int").alias("confidence_pct"))


@query("""SELECT concert_id, concat_ws(' ', nullif(show_date, ''), nullif(concat_ws(', ', nullif(venue, ''), nullif(city, ''), nullif(region, '')), ''), nullif(CASE WHEN lab = '' THEN '' ELSE '[' || lab || ']' END, '')) AS album
FROM (SELECT *, trim(concat_ws(' ', nullif(source.kind, ''), array_to_string(coalesce(source.mics, []), ' '))) AS lab FROM concerts)""")
def album_name(s, d):
    c = table(s, d, "concerts")
    return c.select("concert_id", assemble.album_name(F.col("show_date"), F.col("venue"), F.col("city"), F.col("region"), F.col("source")).alias("album"))


@query(f"""WITH c AS ({COUNTS_SQL}), i AS (
SELECT 'artist unknown' AS issue FROM c WHERE {FILLED.format("artist")} IS NULL UNION ALL SELECT 'date unknown' FROM c WHERE {FILLED.format("show_date")} IS NULL
UNION ALL SELECT 'no setlist found' FROM c WHERE n_tracks = 0 AND n_audio > 0 UNION ALL SELECT 'track count mismatch' FROM c WHERE n_tracks > 0 AND n_tracks <> n_audio)
SELECT issue, count(*) AS n FROM i GROUP BY 1""")
def issue_counts(s, d):
    c = _counted(s, d)
    return stats.issue_counts(c.select(assemble.issues(F.col("artist"), F.col("show_date"), F.col("n_tracks"), F.col("n_audio")).alias("issues")))


@query(f"SELECT concert_id, greatest(2, (least(n_tracks, n_audio) * 15 + 99) // 100)::INTEGER AS tolerance, abs(n_tracks - n_audio) <= greatest(2, (least(n_tracks, n_audio) * 15 + 99) // 100) AS within FROM ({COUNTS_SQL})")
def count_tolerance(s, d):
    t = assemble.tolerance(F.col("n_tracks"), F.col("n_audio"))
    return _counted(s, d).select("concert_id", t.cast("int").alias("tolerance"), (F.abs(F.col("n_tracks") - F.col("n_audio")) <= t).alias("within"))


@query("""SELECT token, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents) GROUP BY 1) ORDER BY n DESC, token LIMIT 50""")
def token_topk(s, d):
    return stats.top_tokens(table(s, d, "documents"))


FOLD_SQL = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH j AS (SELECT {FILLED.format("artist")} IS NOT NULL AS has, {FOLD_SQL.format("artist")} AS x, {FOLD_SQL.format("regexp_extract(parent, '([^/]*)$', 1)")} AS y FROM concerts),
k AS (SELECT has, x, y, list_distinct(string_split(x, ' ')) AS p, list_distinct(string_split(y, ' ')) AS q FROM j)
SELECT 'artist' AS field, count(*) AS total, count(*) FILTER (has) AS filled, count(*) FILTER (x <> '' AND y <> '' AND (x = y OR contains(x, y) OR contains(y, x) OR len(list_intersect(p, q)) * 4 >= greatest(len(p), len(q)) * 3)) AS matched FROM k""")
def match_rates(s, d):
    c = table(s, d, "concerts")
    return stats.match_rates(c.select("concert_id", "artist"), c.select("concert_id", text.path_name(F.col("parent")).alias("artist")), "concert_id", ["artist"])


# --- tracks and files ----------------------------------------------------------------------------------------------

KEYED = "coalesce(pos, 0)::BIGINT * 10000000000 + track_id"


def _tracks(s, d):
    return table(s, d, "tracks").withColumn("at", F.coalesce("pos", F.lit(0)).cast("bigint") * F.lit(10_000_000_000) + F.col("track_id"))


RENUMBER_SQL = f"""SELECT track_id, title, CASE WHEN nd > 1 THEN CASE WHEN f IS NULL THEN 1 ELSE dr END END::INTEGER AS disc, CASE WHEN nd > 1 THEN nd END::INTEGER AS disc_total, concert_id, at_ FROM (
SELECT *, dense_rank() OVER (PARTITION BY concert_id ORDER BY f ASC NULLS LAST) AS dr FROM (
SELECT *, CASE WHEN disc IS NOT NULL THEN min(CASE WHEN disc IS NOT NULL THEN at_ END) OVER (PARTITION BY concert_id, disc) END AS f,
(SELECT count(DISTINCT u.disc) FROM tracks u WHERE u.concert_id = t.concert_id) AS nd FROM (SELECT *, {KEYED} AS at_ FROM tracks) t))"""


@query(f"SELECT track_id, disc, disc_total, (row_number() OVER (PARTITION BY concert_id, disc ORDER BY at_))::INTEGER AS number FROM ({RENUMBER_SQL})")
def disc_renumber(s, d):
    return setlist.finalize(_tracks(s, d).select("concert_id", "track_id", "at", "disc"), ["concert_id"], "at").select("track_id", "disc", F.col("disc_total").cast("int").alias("disc_total"), "number")


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY concert_id, disc ORDER BY at_) AS number, count(*) OVER (PARTITION BY concert_id, disc) AS track_total, row_number() OVER (PARTITION BY concert_id ORDER BY at_) AS k FROM ({RENUMBER_SQL})),
f AS (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY path, idx) AS k FROM ({FILES_SQL}))
SELECT concert_id AS show_id, n.k::INTEGER AS place, path, title, printf('%02d', number) AS track_text, CASE WHEN disc IS NOT NULL THEN disc || '/' || disc_total END AS disc_text, track_total::INTEGER AS track_total FROM n JOIN f ON f.show_id = n.concert_id AND f.k = n.k""")
def positional_plan(s, d):
    t = setlist.finalize(_tracks(s, d).select(F.col("concert_id").alias("show"), "at", "title", "disc"), ["show"], "at")
    return tags.paired(t, _files(s, d), by=("at",), file_by=("path", "idx")).select(F.col("show").alias("show_id"), "place", "path", "title", "track_text", "disc_text", "track_total")


STEM_SQL = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
#: The number a file has already: of its track entry, for files whose concert has an info file.
HAD_SQL = "SELECT p.concert_id AS show_id, t.track_no AS had, row_number() OVER (PARTITION BY p.concert_id ORDER BY t.pos, t.track_id) AS place FROM folder_prints p JOIN concerts c USING (concert_id) JOIN tracks t USING (concert_id) WHERE c.info_name IS NOT NULL"
CODE = r"(?i)(?:cd|disc|d)\s*(\d{1,2})\s*[._\-\s]*(?:track|t)\s*(\d{1,3})\s*$"


@query(rf"""SELECT show_id, path, CASE WHEN had IS NULL THEN coalesce(CASE WHEN c THEN regexp_extract(st, '{CODE}', 2)::INTEGER WHEN regexp_matches(st, '^\d{{1,3}}\s*[._\-\s]') THEN regexp_extract(st, '^(\d{{1,3}})', 1)::INTEGER END, place)::INTEGER END AS track,
CASE WHEN had IS NULL AND c THEN regexp_extract(st, '{CODE}', 1)::INTEGER END AS disc
FROM (SELECT *, regexp_matches(st, '{CODE}') AS c FROM (SELECT *, {STEM_SQL} AS st, row_number() OVER (PARTITION BY show_id ORDER BY path, idx) AS place FROM ({FILES_SQL})) LEFT JOIN ({HAD_SQL}) USING (show_id, place))""")
def metadata_only_plan(s, d):
    t = _tracks(s, d).select(F.col("concert_id").alias("show"), F.col("track_no").alias("had"), F.row_number().over(Window.partitionBy("concert_id").orderBy("pos", "track_id")).alias("place_"))
    t = t.join(table(s, d, "concerts").where("info_name is not null").select(F.col("concert_id").alias("show")), "show", "left_semi")
    f = _files(s, d).withColumn("place_", F.row_number().over(Window.partitionBy("show").orderBy("path", "idx"))).join(t, ["show", "place_"], "left")
    return tags.files_only(f, by=("path", "idx"), existing=F.col("had")).withColumnRenamed("show", "show_id")


@query(rf"""WITH f AS (SELECT print_id, len(tracks) AS files, i, {STEM_SQL} AS st FROM (SELECT print_id, tracks, unnest(tracks).path AS path, generate_subscripts(tracks, 1) AS i FROM folder_prints)),
t AS (SELECT print_id, files, i, trim(regexp_extract(st, '^\s*(\d{{1,3}})\s*[-._]+\s*(.+?)\s*$', 2), ' .-_,') AS title FROM f WHERE regexp_matches(st, '^\s*(\d{{1,3}})\s*[-._]+\s*(.+?)\s*$')),
k AS (SELECT * FROM t WHERE length(title) >= 2 AND NOT regexp_matches(title, '(?i)^(?:d\d+t\d+|t\d+|disc\s*\d+|track\s*\d+|\d{{4}}[-._]\d{{2}}[-._]\d{{2}})$'))
SELECT p.print_id, coalesce(x.n, 0)::INTEGER AS n, coalesce(x.titles, '') AS titles FROM folder_prints p LEFT JOIN (SELECT print_id, count(*) AS n, string_agg(title, '|' ORDER BY i) AS titles FROM k GROUP BY 1, files HAVING count(*) >= greatest(2, files * 4 // 5)) x USING (print_id)""")
def filename_tracks(s, d):
    f = table(s, d, "folder_prints").select("print_id", setlist.tracks_of_files(F.col("tracks.path")).alias("t"))
    return f.select("print_id", F.size("t").alias("n"), F.array_join(F.transform("t", lambda x: x["title"]), "|").alias("titles"))


#: Tags as a file may have them: of its concert as typed, the directory, and its track entry.
TAGS_SQL = f"""SELECT f.show_id, f.path, coalesce(nullif(trim(c.artist), ''), 'Unknown Artist') AS artist, coalesce(c.venue, '') AS album, c.show_date AS date, n.number AS track, n.title, n.disc, n.disc_total, n.track_total::INTEGER AS track_total, c.region IS NULL AS minimal,
nullif(trim(c.artist), '') AS had_artist, nullif(trim(regexp_extract(c.parent, '([^/]*)$', 1)), '') AS had_own, t.track_no AS had_track, nullif(trim(c.city), '') AS had_date, nullif(trim(t.title), '') AS had_title, t.disc AS had_disc, coalesce(c.city, '') AS had_album
FROM (SELECT *, row_number() OVER (PARTITION BY concert_id, disc ORDER BY at_) AS number, count(*) OVER (PARTITION BY concert_id, disc) AS track_total, row_number() OVER (PARTITION BY concert_id ORDER BY at_) AS k FROM ({RENUMBER_SQL})) n
JOIN (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY path, idx) AS k FROM ({FILES_SQL})) f ON f.show_id = n.concert_id AND f.k = n.k JOIN concerts c ON c.concert_id = n.concert_id JOIN tracks t ON t.track_id = n.track_id"""
OUTCOME_SQL = f"""SELECT *, CASE WHEN NOT coalesce(had_artist = artist AND had_own = artist, false) OR NOT coalesce(had_track = track, false) OR (NOT minimal AND ((coalesce(date, '') <> '' AND had_date IS NULL) OR (title IS NOT NULL AND had_title IS NULL) OR (disc IS NOT NULL AND had_disc IS NULL))) THEN 'full'
WHEN had_album = album THEN 'unchanged' ELSE 'album_only' END AS outcome FROM ({TAGS_SQL})"""


def _planned(s, d):
    t = _tracks(s, d).select(F.col("concert_id").alias("show"), "at", "title", "disc", "track_id", F.col("disc").alias("had_disc"), F.col("track_no").alias("had_track"), F.col("title").alias("had_title"))
    p = tags.paired(setlist.finalize(t, ["show"], "at"), _files(s, d), by=("at",), file_by=("path", "idx"), keep=("had_disc", "had_track", "had_title"))
    c = table(s, d, "concerts").select(F.col("concert_id").alias("show"), "artist", "venue", "show_date", "region", "city", text.path_name(F.col("parent")).alias("own"))
    x = p.join(c, "show")
    one = lambda key, c: F.when(c.isNotNull(), F.struct(F.lit(key).alias("k"), F.array(c.cast("string")).alias("v")))
    had = [one("ARTIST", F.col("artist")), one("albumartist", F.col("own")), one("TRACKNUMBER", F.concat(F.col("had_track").cast("string"), F.lit("/"), F.col("track_total").cast("string"))), one("date", F.col("city")), one("TITLE", F.col("had_title")), one("DISCNUMBER", F.col("had_disc")), one("ALBUM", F.col("city"))]
    tag_map = F.map_from_entries(F.filter(F.array(*had), lambda e: e.isNotNull()))
    return x.select("show", "path", F.coalesce(text.filled(F.col("artist")), F.lit("Unknown Artist")).alias("artist"), F.coalesce("venue", F.lit("")).alias("album"), F.col("show_date").alias("date"), F.col("number").alias("track"), "title", "disc", "disc_total", "track_total", F.col("region").isNull().alias("minimal"), tag_map.alias("tags"))


@query(f"SELECT show_id, count(*) AS files, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'album_only') AS album_only, count(*) FILTER (outcome = 'full') AS \"full\" FROM ({OUTCOME_SQL}) GROUP BY 1")
def tag_outcomes(s, d):
    return tags.outcome_counts(_planned(s, d)).withColumnRenamed("show", "show_id")


@query(f"""WITH o AS ({OUTCOME_SQL}), w AS (
SELECT show_id, path, 'ARTIST' AS key, artist AS value, 'set' AS op FROM o WHERE outcome = 'full' UNION ALL SELECT show_id, path, 'ALBUMARTIST', artist, 'set' FROM o WHERE outcome = 'full'
UNION ALL SELECT show_id, path, unnest(['ARTISTSORT', 'ALBUMARTISTSORT']), trim(regexp_replace(artist, '^[Tt]he\\s+', '')), 'set' FROM o WHERE outcome = 'full' UNION ALL SELECT show_id, path, 'ALBUM', album, 'set' FROM o WHERE outcome <> 'unchanged'
UNION ALL SELECT show_id, path, 'TRACKNUMBER', printf('%02d', track), 'set' FROM o WHERE outcome = 'full' UNION ALL SELECT show_id, path, 'DATE', date, 'set' FROM o WHERE outcome = 'full' AND NOT minimal AND coalesce(date, '') <> ''
UNION ALL SELECT show_id, path, 'TITLE', title, 'set' FROM o WHERE outcome = 'full' AND NOT minimal AND title IS NOT NULL UNION ALL SELECT show_id, path, 'DISCNUMBER', disc || '/' || disc_total, 'set' FROM o WHERE outcome = 'full' AND NOT minimal AND disc IS NOT NULL
UNION ALL SELECT show_id, path, unnest(['DISCTOTAL', 'TOTALDISCS']), disc_total::VARCHAR, 'set' FROM o WHERE outcome = 'full' AND NOT minimal AND disc IS NOT NULL UNION ALL SELECT show_id, path, unnest(['TRACKTOTAL', 'TOTALTRACKS']), track_total::VARCHAR, 'set' FROM o WHERE outcome = 'full' AND NOT minimal
UNION ALL SELECT show_id, path, 'DISCNUMBER', NULL, 'delete' FROM o WHERE outcome = 'full' AND NOT minimal AND disc IS NULL AND had_disc IS NOT NULL) SELECT * FROM w""")
def tag_writes(s, d):
    return tags.tag_writes(_planned(s, d), "show", "path").withColumnRenamed("show", "show_id")


@query("SELECT print_id, '/copies/' || substr(folder || '/' || tracks[1].path, 8) AS dest FROM folder_prints WHERE starts_with(folder, '/tapes/')")
def destinations(s, d):
    p = table(s, d, "folder_prints").select("print_id", tags.destination(F.concat("folder", F.lit("/"), F.try_element_at(F.col("tracks.path"), F.lit(1))), "/tapes", "/copies/").alias("dest"), "folder")
    return p.where(F.col("folder").startswith("/tapes/")).drop("folder")


@query("SELECT print_id, len(tracks)::INTEGER AS n_tracks, coalesce(list_sum(list_transform(tracks, lambda t: round(t.duration * 1000)::BIGINT)), 0)::BIGINT AS duration_ms FROM folder_prints")
def print_totals(s, d):
    return dedupe.totals(table(s, d, "folder_prints")).select("print_id", F.col("n_tracks").cast("int").alias("n_tracks"), "duration_ms")


# --- fingerprints --------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT print_id, unnest(tracks) AS t, generate_subscripts(tracks, 1) AS i FROM folder_prints)
SELECT a.print_id, a.i::INTEGER AS place, (192 - list_sum(list_transform(generate_series(1, 6), lambda k: bit_count(xor(a.t.fp[k], b.t.fp[k])))))::INTEGER AS equal_bits FROM t a JOIN t b ON a.print_id = b.print_id AND b.i = a.i + 1""")
def fp_similarity(s, d):
    p = table(s, d, "folder_prints").where(F.size("tracks") > 1).select("print_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tracks") - 1), lambda i: F.round(dedupe.bit_similarity(F.element_at("tracks", i)["fp"], F.element_at("tracks", i + 1)["fp"]) * 192).cast("int"))).alias("i", "equal_bits"))
    return p.select("print_id", (F.col("i") + 1).alias("place"), "equal_bits")


PAIRS_SQL = """SELECT a, b, matched, longest FROM (SELECT x.sig AS a, y.sig AS b, count(*) AS matched, greatest(any_value(x.n), any_value(y.n)) AS longest FROM q x JOIN q y ON x.sig < y.sig AND x.i = y.i AND abs(x.t.duration - y.t.duration) <= 7
AND 1 - list_sum(list_transform(generate_series(1, 6), lambda k: bit_count(xor(x.t.fp[k], y.t.fp[k])))) / 192.0 >= 0.85 GROUP BY 1, 2) WHERE matched >= longest * 0.8"""
Q_SQL = "q AS (SELECT audio_signature AS sig, len(tracks) AS n, unnest(tracks) AS t, generate_subscripts(tracks, 1) AS i FROM (SELECT * FROM folder_prints WHERE audio_signature IS NOT NULL QUALIFY row_number() OVER (PARTITION BY audio_signature ORDER BY print_id) = 1))"


@query(f"WITH {Q_SQL} SELECT a, b, matched::INTEGER AS matched, longest::INTEGER AS longest FROM ({PAIRS_SQL})")
def duplicate_pairs(s, d):
    return dedupe.duplicate_pairs(dedupe.representatives(table(s, d, "folder_prints")))


@query(f"""WITH RECURSIVE {Q_SQL}, e AS (SELECT a, b FROM ({PAIRS_SQL})), g AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r AS (SELECT u AS node, u AS m FROM g UNION SELECT g.v, r.m FROM r JOIN g ON g.u = r.node)
SELECT print_id, audio_signature, coalesce((SELECT min(m) FROM r WHERE r.node = p.audio_signature), audio_signature) AS cluster FROM folder_prints p WHERE audio_signature IS NOT NULL""")
def duplicate_clusters(s, d):
    return dedupe.clusters(table(s, d, "folder_prints"))


@query("""SELECT audio_signature AS cluster, print_id, print_id = first_value(print_id) OVER (PARTITION BY audio_signature ORDER BY total_size DESC NULLS LAST, print_id) AS keep FROM folder_prints WHERE audio_signature IS NOT NULL QUALIFY count(*) OVER (PARTITION BY audio_signature) > 1""")
def keeper_selection(s, d):
    p = table(s, d, "folder_prints").where("audio_signature is not null")
    return dedupe.keepers(p.select(F.col("audio_signature").alias("cluster"), "print_id", F.col("total_size").alias("bytes"), F.size("tracks").alias("tracks"), F.col("scanned_at").alias("mtime")))


INFO_SQL = "SELECT folder, arg_min(info_name, k) AS name, min(k).n AS size FROM (SELECT folder, info_name, {'s': -coalesce(strlen(info_txt), -1), 'm': info_name, 'n': coalesce(strlen(info_txt), -1)} AS k FROM concerts WHERE info_name IS NOT NULL) GROUP BY 1"


@query(f"""WITH l AS (SELECT folder, t.path AS path, coalesce(round(t.duration * 1000)::BIGINT, -1) AS size FROM (SELECT folder, unnest(tracks) AS t FROM folder_prints)),
a AS (SELECT folder, string_agg(chr(0) || 'a:' || path || '|' || size, '' ORDER BY path, size) AS audio FROM l WHERE path IS NOT NULL GROUP BY 1)
SELECT folder, sha1(regexp_extract(folder, '([^/]*)$', 1) || audio || CASE WHEN i.name IS NULL THEN '' ELSE chr(0) || 'i:' || i.name || '|' || i.size END) AS fingerprint FROM a LEFT JOIN ({INFO_SQL}) i USING (folder)""")
def folder_fingerprint(s, d):
    f = table(s, d, "folder_prints").select("folder", F.explode("tracks").alias("t")).select("folder", F.col("t.path").alias("path"), F.round(F.col("t.duration") * 1000).cast("bigint").alias("size"))
    return dedupe.content_fingerprint(f, table(s, d, "concerts").select("folder", F.col("info_name").alias("name"), F.octet_length("info_txt").alias("size")))


@query("""SELECT print_id, sha1(string_agg(regexp_extract(t.path, '([^/]*)$', 1) || '|' || array_to_string(t.fp, ',') || chr(0), '' ORDER BY regexp_extract(t.path, '([^/]*)$', 1), i)) AS signature FROM (SELECT print_id, unnest(tracks) AS t, generate_subscripts(tracks, 1) AS i FROM folder_prints) GROUP BY 1""")
def audio_signature(s, d):
    return dedupe.audio_signature(table(s, d, "folder_prints")).where("signature is not null")


# --- history -------------------------------------------------------------------------------------------------------

LATEST_SQL = "SELECT folder, epoch_us(scanned_at) AS mtime, md5(coalesce(info_txt, '')) AS fingerprint, s AS signature FROM (SELECT c.*, p.audio_signature AS s FROM concerts c LEFT JOIN folder_prints p USING (concert_id)) c WHERE folder IS NOT NULL AND {0} QUALIFY row_number() OVER (PARTITION BY folder ORDER BY scanned_at DESC, concert_id DESC) = 1"


def _state(s, d, cond):
    p = table(s, d, "folder_prints").select("concert_id", F.col("audio_signature").alias("signature"))
    c = table(s, d, "concerts").join(p, "concert_id", "left").where("folder is not null").where(cond)
    c = c.select("folder", "concert_id", "scanned_at", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("mtime"), F.md5(F.coalesce("info_txt", F.lit("")).cast("binary")).alias("fingerprint"), "signature")
    return history.latest(c, "folder", ["scanned_at", "concert_id"]).select("folder", "mtime", "fingerprint", "signature")


@query(LATEST_SQL.format("true"))
def history_latest(s, d):
    return _state(s, d, "true")


#: Two runs over one library: the earlier one knew the scans before SINCE, the later one sees the last state of all.
SINCE = "2022-06-01"
EARLIER = f"scanned_at < timestamp '{SINCE}'"
SKIP_SQL = f"WITH n AS ({LATEST_SQL.format('true')}), k AS ({LATEST_SQL.format(EARLIER)})"


@query(f"{SKIP_SQL} SELECT folder, reason FROM (SELECT folder, CASE WHEN n.mtime = k.mtime THEN 'mtime' WHEN n.fingerprint = k.fingerprint THEN 'content' WHEN n.signature = k.signature THEN 'audio' END AS reason FROM n JOIN k USING (folder)) WHERE reason IS NOT NULL")
def incremental_skip(s, d):
    return history.unchanged(_state(s, d, "true"), _state(s, d, EARLIER))


@query(f"{SKIP_SQL} SELECT n.* FROM n LEFT JOIN k USING (folder) WHERE coalesce(n.mtime = k.mtime OR n.fingerprint = k.fingerprint OR n.signature = k.signature, false) = false")
def incremental_changed(s, d):
    return history.changed(_state(s, d, "true"), _state(s, d, EARLIER))


@query(f"{SKIP_SQL} SELECT folder, coalesce(n.mtime, k.mtime) AS mtime, coalesce(n.fingerprint, k.fingerprint) AS fingerprint, coalesce(n.signature, k.signature) AS signature FROM k FULL JOIN n USING (folder)")
def history_upsert(s, d):
    return history.upsert(_state(s, d, EARLIER), _state(s, d, "true"))


#: How the earlier run went, told by the folder's name: mode, failures, where copies went.
RUN_SQL = "CASE WHEN length(folder) % 3 = 0 THEN 'copy-to' WHEN length(folder) % 3 = 1 THEN 'in-place' ELSE 'dry-run' END AS mode, CASE WHEN length(folder) % 7 = 0 THEN 1 ELSE 0 END AS failed, CASE WHEN length(folder) % 2 = 0 THEN '/a' ELSE '/b' END AS copy_to"
COVERED = {"dry-run": "mode IN ('in-place', 'copy-to')", "in-place": "mode = 'in-place'", "copy-to": "mode = 'copy-to' AND copy_to = '/a'"}


def _policy_sql(mode: str, rescan: bool) -> str:
    heard = "n.signature IS NOT NULL AND k.signature IS NOT NULL"
    reason = f"CASE WHEN n.mtime = k.mtime AND {not rescan} THEN 'mtime' WHEN n.fingerprint = k.fingerprint AND (NOT {rescan} OR ({heard})) THEN 'content' WHEN n.signature = k.signature THEN 'audio' END"
    return f"SELECT '{mode}' AS run, {rescan} AS rescan, folder, {reason} AS reason FROM n JOIN k USING (folder) WHERE failed = 0 AND {COVERED[mode]} AND {reason} IS NOT NULL"


RUNS = [(m, r) for m in COVERED for r in (False, True)]


@query(f"WITH n AS ({LATEST_SQL.format('true')}), k AS (SELECT *, {RUN_SQL} FROM ({LATEST_SQL.format(EARLIER)})) " + " UNION ALL ".join(_policy_sql(m, r) for m, r in RUNS))
def skip_policy(s, d):
    n = F.length("folder")
    k = _state(s, d, EARLIER).withColumns({"mode": F.when(n % 3 == 0, "copy-to").when(n % 3 == 1, "in-place").otherwise("dry-run"), "failed": F.when(n % 7 == 0, 1).otherwise(0), "copy_to": F.when(n % 2 == 0, "/a").otherwise("/b")})
    now, out = _state(s, d, "true"), None
    for mode, rescan in RUNS:
        x = history.skips(now, k, mode, "/a", rescan, audio=True).select(F.lit(mode).alias("run"), F.lit(rescan).alias("rescan"), "folder", "reason")
        out = x if out is None else out.unionAll(x)
    return out


# --- lexicon -------------------------------------------------------------------------------------------------------

BUILD_SQL = f"""SELECT key, name, cnt FROM (SELECT key, name, sum(n) OVER (PARTITION BY key)::BIGINT AS cnt, row_number() OVER (PARTITION BY key ORDER BY n DESC, length(name) DESC, name DESC) AS r
FROM (SELECT name, sum(n) AS n, {KEY_SQL.format("name")} AS key FROM (SELECT {FILLED.format("name")} AS name, coalesce(cnt, 0) AS n FROM lexicon WHERE kind = 'artist') WHERE name IS NOT NULL GROUP BY 1) WHERE key <> '') WHERE r = 1"""


def _lex(s, d):
    return lexicon.build(table(s, d, "lexicon").where("kind = 'artist'"), cnt=F.col("cnt"))


@query(BUILD_SQL)
def lexicon_build(s, d):
    return _lex(s, d)


@query(f"SELECT c.concert_id, c.artist AS name, l.name AS match FROM concerts c LEFT JOIN ({BUILD_SQL}) l ON l.key = {KEY_SQL.format('c.artist')} AND l.cnt >= 2")
def lexicon_exact(s, d):
    return lexicon.lookup(table(s, d, "concerts").select("concert_id", F.col("artist").alias("name")), _lex(s, d))


@query()
def lexicon_match(s, d):
    return lexicon.match(table(s, d, "concerts").select(F.col("artist").alias("name")), _lex(s, d))


@query(f"""WITH l AS (SELECT * FROM ({BUILD_SQL}) WHERE cnt >= 2), q AS (SELECT DISTINCT artist AS name, {KEY_SQL.format("artist")} AS k FROM concerts WHERE artist IS NOT NULL AND {KEY_SQL.format("artist")} <> ''),
e AS (SELECT q.name, l.name AS match, 'exact' AS how FROM q JOIN l ON l.key = q.k),
c AS (SELECT q.name, l.name AS match, 'contained' AS how, row_number() OVER (PARTITION BY q.name ORDER BY length(l.key) DESC, l.cnt DESC, l.key DESC) AS r FROM q JOIN l ON length(l.key) >= 5 AND length(l.key) < length(q.k) AND contains(' ' || q.k || ' ', ' ' || l.key || ' ')
WHERE NOT regexp_matches(q.k, '{text.TRIBUTE}') AND q.name NOT IN (SELECT name FROM e))
SELECT * FROM e UNION ALL SELECT name, match, how FROM c WHERE r = 1""")
def lexicon_contained(s, d):
    return lexicon.match(table(s, d, "concerts").select(F.col("artist").alias("name")), _lex(s, d), fuzzy=False)


@query("""SELECT name, greatest(coalesce(a, 0), coalesce(b, 0))::BIGINT AS cnt FROM (SELECT name, max(cnt) AS a FROM lexicon WHERE kind = 'venue' GROUP BY 1) FULL JOIN (SELECT name, max(cnt) AS b FROM starter_lexicon WHERE kind = 'venue' GROUP BY 1) USING (name)""")
def lexicon_merge(s, d):
    v = "kind = 'venue'"
    return lexicon.merge(table(s, d, "lexicon").where(v), table(s, d, "starter_lexicon").where(v))


@query(f"SELECT entry_id, {KEY_SQL.format('name')} AS key FROM lexicon")
def normalize_names(s, d):
    return table(s, d, "lexicon").select("entry_id", text.normalize_name(F.col("name")).alias("key"))


@query("SELECT entry_id, coalesce(trim(regexp_replace(name, '^[Tt]he\\s+', '')), '') AS sort_name FROM lexicon")
def sort_names(s, d):
    return table(s, d, "lexicon").select("entry_id", text.sort_key(F.col("name")).alias("sort_name"))


@query()
def lexicon_harvest(s, d):
    names = table(s, d, "concerts").select(text.release_artist(text.path_name(F.col("parent"))).alias("name"))
    return lexicon.harvest(names, table(s, d, "lexicon").where("kind = 'artist'").select("name", "cnt"))


@query("""WITH x AS (SELECT lower(substr(regexp_extract(parent, '([^/]*)$', 1), 1, 5)) AS prefix, artist AS creator, count(*) AS n FROM concerts WHERE artist IS NOT NULL GROUP BY 1, 2),
y AS (SELECT *, sum(n) OVER (PARTITION BY prefix) AS total, count(*) OVER (PARTITION BY prefix) AS creators, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, creator) AS r FROM x WHERE length(prefix) BETWEEN 2 AND 12)
SELECT prefix, creator, n AS count, total::BIGINT AS total, creators FROM y WHERE r = 1 AND n >= 2 AND n >= total * 0.8""")
def prefix_purity(s, d):
    c = table(s, d, "concerts").select(F.lower(F.substring(text.path_name(F.col("parent")), 1, 5)).alias("prefix"), F.col("artist").alias("creator"))
    return lexicon.prefix_purity(c).drop("purity")


# --- extraction ----------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT DISTINCT show_date AS date FROM concerts WHERE regexp_full_match(show_date, '(19|20)\\d\\d-\\d\\d-\\d\\d') AND try_cast(show_date AS DATE) IS NOT NULL)
SELECT date, date AS iso, date AS dots, date AS compact, date AS us, date AS prose, date AS month_day FROM x""")
def date_roundtrip(s, d):
    x = table(s, d, "concerts").select(F.col("show_date").alias("date")).distinct().where(F.col("date").rlike(r"^(19|20)\d\d-\d\d-\d\d$") & F.try_to_date("date", "yyyy-MM-dd").isNotNull())
    t = F.try_to_date("date", "yyyy-MM-dd")
    say = lambda p: F.concat(F.lit("Some Artist "), F.date_format(t, p), F.lit(" at the Hall"))
    x = x.select("date", *[say(p).alias(n) for n, p in (("iso", "yyyy-MM-dd"), ("dots", "yyyy.MM.dd"), ("compact", "yyyyMMdd"), ("us", "MM/dd/yyyy"), ("prose", "d MMMM yyyy"), ("month_day", "MMMM d, yyyy"))])
    return x.select("date", *[parse_date(F.col(c)).alias(c) for c in x.columns[1:]])


@query()
def folder_dates(s, d):
    n = text.path_name(F.col("folder"))
    return spread_if_few(table(s, d, "concerts")).select("concert_id", parse_date(n).alias("date"), first_date_position(n).alias("starts"), first_date_end(n).alias("ends"))


@query()
def folder_artists(s, d):
    n = text.path_name(F.col("folder"))
    return spread_if_few(table(s, d, "concerts")).select("concert_id", artists.guess(n).alias("before_date"), artists.weak(n).alias("weak"), artists.trust_parent(F.col("folder")).alias("above"), artists.in_various(F.col("folder")).alias("various"))


@query()
def notes_fields(s, d):
    return notes.parse_notes(spread_if_few(table(s, d, "concerts").select("concert_id", F.col("info_txt").alias("body")))).select("concert_id", "n_artist", "n_date", "n_venue", "n_city", "n_region")


@query()
def notes_setlists(s, d):
    t = setlist.setlist(spread_if_few(table(s, d, "concerts").select(F.col("concert_id").alias("doc"), F.col("info_txt").alias("body"))))
    x = t.select("doc", F.posexplode("raw").alias("pos", "x")).select("doc", "pos", "x.disc", "x.title")
    return setlist.finalize(x, ["doc"]).select(F.col("doc").alias("concert_id"), "pos", "number", "disc", F.col("disc_total").cast("int").alias("disc_total"), "title")


@query()
def assembled_shows(s, d):
    f = table(s, d, "folder_prints").select("concert_id", F.col("tracks.path").alias("files"))
    c = by_key(table(s, d, "concerts").select("concert_id", "folder", F.col("info_txt").alias("body")), "concert_id").join(by_key(f, "concert_id"), "concert_id", "left")
    lex = table(s, d, "lexicon").select("kind", "name", "cnt").unionAll(table(s, d, "starter_lexicon").select("kind", "name", "cnt"))
    known = lambda kind: lexicon.build(lex.where(F.col("kind") == kind), cnt=F.col("cnt"))
    x = assemble.assemble_whole(c, "concert_id", known("artist"), known("venue"))
    return x.select("concert_id", "artist", "date", "venue", "city", "region", source.label(F.col("source")).alias("source"), F.size("tracks").alias("tracks"), F.array_join("issues", "; ").alias("issues"), F.round(F.col("confidence") * 100).cast("int").alias("confidence_pct"), "album")


@query()
def source_detect(s, d):
    return spread_if_few(table(s, d, "concerts")).select("concert_id", source.detect(text.path_name(F.col("folder")), F.col("info_txt")).alias("source")).select("concert_id", "source.kind", F.array_join("source.mics", "|").alias("mics"))


ROUND = "FROM concerts c JOIN venue_ref v ON v.venue_id = 501 + c.concert_id % 200 WHERE regexp_full_match(show_date, '(19|20)\\d\\d-\\d\\d-\\d\\d') AND try_cast(show_date AS DATE) IS NOT NULL"


@query(f"SELECT concert_id, 'Some Player ' || chr(65 + (concert_id % 26)::INTEGER) AS n_artist, show_date AS n_date, upper(v.venue) AS n_venue, 'Springfield' AS n_city, 'Canada' AS n_region {ROUND}")
def notes_roundtrip(s, d):
    c = table(s, d, "concerts").where(F.col("show_date").rlike(r"^(19|20)\d\d-\d\d-\d\d$") & F.try_to_date("show_date", "yyyy-MM-dd").isNotNull()).select("concert_id", "show_date", (F.lit(501) + F.col("concert_id") % 200).alias("venue_id"))
    c = c.join(table(s, d, "venue_ref").select("venue_id", "venue"), "venue_id")
    who = F.concat(F.lit("Some Player "), F.char(65 + F.col("concert_id") % 26))
    body = F.concat_ws("\n", who, F.date_format(F.try_to_date("show_date", "yyyy-MM-dd"), "dd MMMM yyyy"), F.upper("venue"), F.lit("Springfield, Canada"), F.lit("SBD"), F.lit(""), F.lit("01. First Song"), F.lit("02. Second Song"))
    return notes.parse_notes(c.select("concert_id", body.alias("body"))).select("concert_id", "n_artist", "n_date", "n_venue", "n_city", "n_region")


TRACK_BODY = "FROM tracks WHERE title IS NOT NULL AND regexp_full_match(title, '\\p{L}[\\p{L}\\p{M}''’ ]*\\p{L}') AND NOT regexp_matches(title, '(?i)^\\s*(disc|cd|disk|set|encore|early|late|matinee|evening)')"


@query(f"SELECT concert_id AS doc, (row_number() OVER (PARTITION BY concert_id ORDER BY {KEYED}) - 1)::INTEGER AS pos, title {TRACK_BODY}")
def setlist_roundtrip(s, d):
    t = _tracks(s, d).where(F.col("title").rlike(r"^\p{L}[\p{L}\p{M}'’ ]*\p{L}$") & ~F.col("title").rlike(r"(?i)^\s*(disc|cd|disk|set|encore|early|late|matinee|evening)"))
    b = t.groupBy(F.col("concert_id").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("at", "title"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 3, "0"), F.lit(". "), x["title"], F.lit("  3:45"))), "\n")
    return setlist.setlist(b.select("doc", body.alias("body"))).select("doc", F.posexplode("raw").alias("pos", "x")).select("doc", "pos", "x.title")


_vectors("date_vectors", [("gd1977-05-08", "1977-05-08"), ("1977.5.8 x", "1977-05-08"), ("19770508", "1977-05-08"), ("SRV_1985.0725", "1985-07-25"), ("02/19/2010", "2010-02-19"), ("9 april 1978", "1978-04-09"), ("April 9th, 1978", "1978-04-09"), ("Sept 3, 1999", "1999-09-03"), ("11_10_23", "2023-11-10"), ("09-01-89", "1989-09-01"), ("91-11-03", "1991-11-03"), ("03-04-05", "2005-03-04"), ("1990-02-30 then 19900301", "1990-03-01"), ("hello", None), ("1985 tour", None), ("", None)], parse_date)
_vectors("artist_guess_vectors", [("gd67-08-05.sbd", "Grateful Dead"), ("Talking Heads 1980-08-27 NYC", "Talking Heads"), ("1999-01-01 - Phish - MSG", "Phish"), ("1969 Black Sabbath", None), ("bc1980-01-01", None), ("01 Godcaster 2020-01-02", "Godcaster"), ("Steel Pulse - The Palace 1983-01-02", "Steel Pulse"), ("", None)], artists.guess)
_vectors("artist_weak_vectors", [("1969 Black Sabbath", "Black Sabbath"), ("All Them Witches", "All Them Witches"), ("Boston MA", None), ("1999-01-01 Show A", None), ("20150515 U2 Vancouver", "U2 Vancouver"), ("a lower case name of many words", None), ("Master FLAC 24bit", None)], artists.weak)
_vectors("ancestor_artist_vectors", [("/Tapes/Black Sabbath/1969-01-01 Show", "Black Sabbath"), ("/Tapes/Eric Clapton and Dr. John - 1996-01-13 - London/x", "Eric Clapton and Dr. John"), ("/Tapes/Various Artists/U2", "Various Artists"), ("/Tapes/Bob Dylan 1978/CD1/x", "Bob Dylan"), ("/music/foo", None), ("/a/[x]/b", None), ("/Tapes/Frank Sinatra/Audio/CD1", "Frank Sinatra")], artists.trust_parent)
_vectors("source_vectors", [("sbd akg 414 AKG mk4", "[SBD Schoeps MK4 AKG 414]"), ("Pre-FM nak 300 > dat", "[Pre-FM Nak 300]"), ("AUD neumann", "[AUD Neumann]"), ("nothing", ""), ("FM broadcast", "[FM]"), ("zoom H4n", "[Zoom H4n]")], lambda c: source.label(source.detect(c)))
_vectors("disc_marker_vectors", [("Disc 1", "1:"), ("WHEN WE WERE KINGS [Disc 2]", "2:when we were kings"), ("Volume 4", "4:"), ("1st Set", "1:"), ("late show", "99:"), ("Early Show", "0:"), ("foo", None), ("x cd two", "2:x")], lambda c: F.concat(setlist.disc_of_name(c)["idx"].cast("string"), F.lit(":"), setlist.disc_of_name(c)["base"]))
_vectors("junk_name_vectors", [("CD 1", True), ("1999-01-02 x", True), ("[meta]", True), ("Archive Series", True), ("BOOTLEG", True), ("ABBA", False), ("Phish", False), ("", False), ("x", True), ("Remastered", True)], text.is_junk_name, "boolean", "BOOLEAN")
_vectors("release_artist_vectors", [("Some Artist - A Title", "Some Artist"), ("Some.Artist.Live.1999.FLAC", None), ("_x", None), ("Band 320k", "Band"), ("Band", "Band")], text.release_artist)
_vectors("human_bytes_vectors", [("512", "512.0 B"), ("1536", "1.5 KiB"), ("10485760", "10.0 MiB"), ("5368709120", "5.0 GiB")], lambda c: text.human_bytes(c.cast("double")))
_vectors("venue_line_vectors", [("THE FILLMORE", True), ("http://x.com", False), ("Lineage: a > b", False), ("12345678", False), ("mics on stand", False), ("ab", False), ("Recorded by X", False)], lines.is_venue, "boolean", "BOOLEAN")
_vectors("city_of_folder_vectors", [("x, Fillmore, San Francisco, CA", "San Francisco|CA"), ("1977 Ithaca NY", "Ithaca|NY"), ("a, Apollo, Manchester, England", "Manchester|England"), ("nothing", "")], lambda c: F.concat_ws("|", lines.city_of_folder(c)["city"], lines.city_of_folder(c)["region"]))
_vectors("file_kind_vectors", [("a.FLAC", "audio"), ("info", "info"), ("x.md5.txt", None), (".hidden.mp3", None), ("notes.txt", "info"), ("cover.jpg", None)], discover.file_kind)
_vectors("int_prefix_vectors", [("01/12", 1), ("7", 7), ("x", None), ("", None)], setlist.int_prefix, "int", "INTEGER")
_vectors("salvage_vectors", [("Taj MAHAL, Bologna-Italy, 9 april 1978, 2d gen SB", "Taj MAHAL"), ("no comma", None), ("mics 10 ft from stage, x", None), ("August 18, 2002", None)], artists.salvage)

_TREE = ["/lib/A/1999-01-01 Show/01.flac", "/lib/A/1999-01-01 Show/info.txt", "/lib/A/Big Show/Disc 1/a.flac", "/lib/A/Big Show/Disc 2/a.flac", "/lib/A/Big Show/info.txt", "/lib/B/show 2001 flac16/show 2001 flac16/t.mp3", "/lib/B/.hid/x.flac", "/lib/C/art/x.jpg", "/lib/D/one/x.mp3", "/lib/D/two/x.mp3", "/lib/E/2001-01-01/BOOKER T 1/a.ogg", "/lib/E/2001-01-01/BOOKER T 2/a.ogg"]


@query(_values([("/lib/A/1999-01-01 Show", "audio"), ("/lib/A/Big Show", "discs"), ("/lib/B/show 2001 flac16", "wrapper"), ("/lib/D/one", "audio"), ("/lib/D/two", "audio"), ("/lib/E/2001-01-01", "discs")], "dir, how"))
def candidate_folders(s, d):
    return discover.candidates(s.createDataFrame([(p,) for p in _TREE], "path string"), "/lib")


@query(_values([("Live 1999", "Live 1999", True), ("show one", "flac", True), ("abcdef show", "abcdef show [FLAC16]", True), ("Artist", "1977", False), ("show1", "show1 other", False)], "outer_name, inner_name, wraps"))
def unpack_wrappers(s, d):
    rows = [("Live 1999", "Live 1999"), ("show one", "flac"), ("abcdef show", "abcdef show [FLAC16]"), ("Artist", "1977"), ("show1", "show1 other")]
    return s.createDataFrame(rows, "outer_name string, inner_name string").withColumn("wraps", discover.is_wrapper(F.col("outer_name"), F.col("inner_name")))


#: In this library every folder with audio stands for itself: none wraps another or is a disc.
@query("SELECT DISTINCT folder AS dir, 'audio' AS how FROM folder_prints")
def library_candidates(s, d):
    f = table(s, d, "folder_prints").select(F.explode(F.transform("tracks", lambda t: F.concat("folder", F.lit("/"), t["path"]))).alias("path"))
    return discover.candidates(f.distinct(), "/tapes")


BLANK_SQL = "nullif(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '')"
ENRICH_SQL = f"""WITH c AS ({COUNTS_SQL}), best AS (SELECT parent, show_date, arg_min({{'venue': venue, 'city': city, 'region': region}}, {{'a': scanned_at, 'b': concert_id}}) AS e FROM c WHERE show_date IS NOT NULL AND venue IS NOT NULL AND parent IS NOT NULL GROUP BY 1, 2)
SELECT c.concert_id AS show_id, c.venue AS own_venue, c.city AS own_city, c.region AS own_region, e IS NOT NULL AS hit, coalesce({BLANK_SQL.format("c.venue")}, e.venue) AS venue, coalesce({BLANK_SQL.format("c.city")}, e.city) AS city, coalesce({BLANK_SQL.format("c.region")}, e.region) AS region, n_tracks AS tracks,
coalesce(s.n, 0) AS songs FROM c LEFT JOIN best ON best.parent = c.parent AND best.show_date = c.show_date LEFT JOIN (SELECT x.parent, x.show_date, count(*) AS n FROM tracks t JOIN (SELECT parent, show_date, arg_min(concert_id, {{'a': scanned_at, 'b': concert_id}}) AS concert_id FROM c WHERE show_date IS NOT NULL AND venue IS NOT NULL AND parent IS NOT NULL GROUP BY 1, 2) x USING (concert_id) WHERE t.title IS NOT NULL GROUP BY 1, 2) s ON s.parent = c.parent AND s.show_date = c.show_date"""


def _enriched(s, d):
    """Each show beside the first record of its artist's directory and date, as if that had been looked up."""
    c = _counted(s, d).select(F.col("concert_id").alias("show"), "parent", "show_date", "venue", "city", "region", F.col("n_tracks").alias("tracks"), "scanned_at")
    best = c.where("show_date is not null and venue is not null and parent is not null").groupBy("parent", "show_date").agg(F.min_by(F.struct("show", "venue", "city", "region"), F.struct("scanned_at", "show")).alias("e"))
    titles = table(s, d, "tracks").where("title is not null").groupBy(F.col("concert_id").alias("first")).agg(F.sort_array(F.collect_list("title")).alias("songs"))
    found = c.select("show", "parent", "show_date").join(best, ["parent", "show_date"]).select("show", F.col("e.show").alias("first"), "e.venue", "e.city", "e.region").join(titles, "first", "left")
    return c, found.select("show", "venue", "city", "region", F.coalesce("songs", F.array().cast("array<string>")).alias("songs"), F.lit(0).alias("rank"))


@query(f"""SELECT show_id, venue, city, region, tracks, songs::INTEGER AS songs, CASE WHEN songs = 0 THEN 'none' WHEN tracks = 0 THEN 'fill' WHEN tracks = songs THEN 'confirm' ELSE 'overwrite' END AS songs_action FROM ({ENRICH_SQL})""")
def enrichment(s, d):
    c, found = _enriched(s, d)
    return tags.enrich(c, found).withColumnRenamed("show", "show_id")


@query(f"""SELECT count(*) FILTER (hit) AS matched, count(*) FILTER (hit AND (({BLANK_SQL.format("own_venue")} IS NULL AND venue IS NOT NULL) OR ({BLANK_SQL.format("own_city")} IS NULL AND city IS NOT NULL) OR ({BLANK_SQL.format("own_region")} IS NULL AND region IS NOT NULL))) AS changed, count(*) FILTER (NOT hit) AS missed FROM ({ENRICH_SQL})""")
def enrichment_counts(s, d):
    c, found = _enriched(s, d)
    return tags.enrichment_counts(c, tags.enrich(c, found), found)


# --- mining --------------------------------------------------------------------------------------------------------


@query(f"SELECT value, count(*) AS n FROM (SELECT {FILLED.format('venue')} AS value FROM concerts) WHERE value IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 30")
def top_venues(s, d):
    return stats.top_values(table(s, d, "concerts"), "venue")


@query(f"SELECT parent, count(*) AS n FROM concerts WHERE {FILLED.format('artist')} IS NULL GROUP BY 1")
def unknown_by_parent(s, d):
    return stats.missing_by_parent(table(s, d, "concerts"))


@query()
def mined_mics(s, d):
    return stats.mine_mics(spread_if_few(table(s, d, "concerts").select(F.col("info_txt").alias("body"))))


@query()
def source_kinds(s, d):
    return stats.source_kinds(spread_if_few(table(s, d, "concerts").select(F.col("info_txt").alias("body"))))


@query("""WITH x AS (SELECT lower(substr(regexp_extract(parent, '([^/]*)$', 1), 1, 5)) AS prefix, artist, count(*) AS n FROM concerts WHERE artist IS NOT NULL GROUP BY 1, 2),
y AS (SELECT *, sum(n) OVER (PARTITION BY prefix) AS total, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, artist) AS r FROM x WHERE length(prefix) BETWEEN 2 AND 12)
SELECT concert_id, y.artist FROM concerts c JOIN y ON y.r = 1 AND y.n >= 2 AND y.n >= y.total * 0.8 AND y.prefix = lower(substr(regexp_extract(c.parent, '([^/]*)$', 1), 1, 5))""")
def prefix_artists(s, d):
    c = table(s, d, "concerts").withColumn("prefix", F.lower(F.substring(text.path_name(F.col("parent")), 1, 5)))
    return c.select("concert_id", "prefix").join(lexicon.prefix_dictionary(c.select("prefix", F.col("artist").alias("creator"))), "prefix").select("concert_id", "artist")


@query()
def ancestor_artists(s, d):
    return lexicon.from_ancestors(table(s, d, "concerts").select("folder"), _lex(s, d))


@query(f"""WITH f AS (SELECT DISTINCT folder, t.path AS name FROM (SELECT folder, unnest(tracks) AS t FROM folder_prints)), i AS (SELECT c.folder, c.info_name AS name, max(strlen(c.info_txt)) AS size FROM concerts c JOIN folder_prints p USING (concert_id)
 WHERE regexp_matches(lower(c.info_name), '\\.(txt|nfo|info|md|rtf)$|^(info|notes|setlist|tracks|readme|tracklist)$') AND NOT starts_with(c.info_name, '.') AND NOT regexp_matches(lower(c.info_name), '{"|".join(discover.CHECKSUM_HINTS)}') GROUP BY 1, 2)
SELECT folder, 'audio' AS how, count(*)::INTEGER AS files, folder || '/' || min(name) AS first, any_value(folder || '/' || best) AS info FROM f LEFT JOIN (SELECT folder, arg_min(name, {{'s': -coalesce(size, -1), 'n': name}}) AS best FROM i GROUP BY 1) USING (folder) GROUP BY 1""")
def library_folders(s, d):
    f = table(s, d, "folder_prints").select("concert_id", "folder", F.explode("tracks").alias("t")).select("concert_id", "folder", F.concat("folder", F.lit("/"), F.col("t.path")).alias("path"), F.lit(1).cast("bigint").alias("size"))
    i = table(s, d, "concerts").where("info_name is not null").join(f.select("concert_id").distinct(), "concert_id", "left_semi").select(F.concat("folder", F.lit("/"), "info_name").alias("path"), F.octet_length("info_txt").cast("bigint").alias("size"))
    x = discover.enumerate_folders(f.select("path", "size").distinct().unionAll(i.groupBy("path").agg(F.max("size").alias("size"))), "/tapes")
    return x.select("folder", "how", F.size("audio").alias("files"), F.try_element_at("audio", F.lit(1)).alias("first"), "info")

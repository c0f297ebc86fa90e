"""The queries of this subpackage and their SQL, by name. The first of each problem is its main result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canonical, language, mixing, mojibake, neardup, packing, survivor, variants

Q = Callable[[SparkSession, str], DataFrame]


def _t(s: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(s, d, n) for n in names]


def _codes(s: SparkSession, d: str) -> list[tuple[str, str]]:
    return sorted((r.lang, r.lang_name) for r in table(s, d, "lang_codes").collect())


def p3_groups(s: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(s, d, "folder_prints"))


def p4_replaced(s: SparkSession, d: str) -> DataFrame:
    """Of the values found, those with a replacement character: all that have one."""
    concerts, tracks = _t(s, d, "concerts", "tracks")
    lost = mojibake.values(concerts, tracks).where(F.col("text").contains("\ufffd")).select("table_name", "row_id", "field_name")
    return mojibake.found(concerts, tracks).join(lost, ["table_name", "row_id", "field_name"], "left_semi")


def p5_exact(s: SparkSession, d: str) -> DataFrame:
    """Venues typed exactly as in the list, which must come out with that entry."""
    found = canonical.found(*_t(s, d, "concerts", "lexicon", "starter_lexicon", "venue_ref", "city_ref"))
    c = table(s, d, "concerts").join(table(s, d, "venue_ref").select("venue"), "venue", "left_semi").select(F.col("concert_id").alias("row_id"))
    return found.where("table_name = 'concerts' and field_name = 'venue'").join(c, "row_id", "left_semi").select("row_id", "ref_id")


def p6_whole(s: SparkSession, d: str) -> DataFrame:
    """Per capacity: documents packed, containers that hold too much, parts that stand twice, containers with an undivided
    document split though it fits."""
    docs, caps = _t(s, d, "documents", "pack_sizes")
    made = packing.pack(docs, caps).join(F.broadcast(caps), "pack_id")
    size = made.groupBy("pack_id", "doc_id").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("parts"), F.countDistinct("part").alias("distinct"), F.first("capacity_tokens").alias("cap"))
    bad = size.groupBy("pack_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("parts") != F.col("distinct")).alias("repeated"), F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("cap"))).alias("split"))
    over = made.groupBy("pack_id", "bin").agg(F.sum("tokens").alias("n"), F.first("capacity_tokens").alias("cap")).groupBy("pack_id").agg(F.count_if(F.col("n") > F.col("cap")).alias("overfull"))
    return bad.join(over, "pack_id").select("pack_id", "documents", "repeated", "split", "overfull")


def p7_limits(s: SparkSession, d: str) -> DataFrame:
    """Per target source that is there: uses of a document beyond its limit, and positions that are not the next after another."""
    docs, targets = _t(s, d, "documents", "mix_targets")
    made = mixing.mix(docs, targets)
    uses = made.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(targets), "source").groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("beyond"))
    return uses.select("source", "beyond")


def p8_pieces(s: SparkSession, d: str) -> DataFrame:
    """Pieces of each document that were classified: all of them, none twice."""
    x = language.segments(table(s, d, "documents"), _codes(s, d))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("seg").alias("differing"), F.max("seg").alias("top"))


QUERIES: dict[str, Q] = {
    "p1_found": lambda s, d: variants.found(*_t(s, d, "concerts", "lexicon", "starter_lexicon")),
    "p1_entities": lambda s, d: variants.entities(variants.strings(*_t(s, d, "concerts", "lexicon", "starter_lexicon"))),
    "p2_found": lambda s, d: survivor.survivors(*_t(s, d, "folder_prints", "concerts", "origin_trust")).select("audio_signature", "field_name", "print_id"),
    "p2_majority": lambda s, d: survivor.survivors(*_t(s, d, "folder_prints", "concerts", "origin_trust"), vote=True),
    "p3_found": lambda s, d: neardup.found_pairs(table(s, d, "folder_prints")),
    "p3_groups": p3_groups,
    "p4_found": lambda s, d: mojibake.found(*_t(s, d, "concerts", "tracks")),
    "p4_replaced": p4_replaced,
    "p4_restored": lambda s, d: mojibake.restored(*_t(s, d, "concerts", "tracks")),
    "p5_found": lambda s, d: canonical.found(*_t(s, d, "concerts", "lexicon", "starter_lexicon", "venue_ref", "city_ref")),
    "p5_exact": p5_exact,
    "p6_packed": lambda s, d: packing.pack(*_t(s, d, "documents", "pack_sizes")),
    "p6_fill": lambda s, d: packing.report(*_t(s, d, "documents", "pack_sizes")),
    "p6_whole": p6_whole,
    "p7_mix": lambda s, d: mixing.mix(*_t(s, d, "documents", "mix_targets")),
    "p7_shares": lambda s, d: mixing.shares(*_t(s, d, "documents", "mix_targets")),
    "p7_limits": p7_limits,
    "p8_pieces": p8_pieces,
    "p8_found": lambda s, d: language.mislabelled(table(s, d, "documents"), _codes(s, d)),
    "p8_documents": lambda s, d: language.documents_language(table(s, d, "documents"), _codes(s, d)),
    "p8_segments": lambda s, d: language.segments(table(s, d, "documents"), _codes(s, d)).select("doc_id", "seg", "lang", F.round("confidence", 4).alias("confidence")),
}

FILLER_SQL = "(" + ", ".join(f"'{x}'" for x in survivor.FILLERS) + ")"
REAL_SQL = "coalesce(trim({0}) <> '' AND lower(trim({0})) NOT IN " + FILLER_SQL + ", false)"
#: The rule of the survivor: what is usable, then completeness, trust, recency, lowest id.
P2_SQL = f"""WITH p AS (SELECT f.*, coalesce(list_sum(list_transform(tracks, lambda t: coalesce(t.duration, 0))), 0) AS heard, lower(regexp_extract(tracks[1].path, '\\.([A-Za-z0-9]+)$', 1)) AS ext
 FROM folder_prints f WHERE audio_signature IS NOT NULL AND audio_signature IN (SELECT audio_signature FROM folder_prints GROUP BY 1 HAVING count(*) > 1)),
every AS (SELECT total_size / list_sum(list_transform(tracks, lambda t: t.duration)) AS rate, lower(regexp_extract(tracks[1].path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM folder_prints WHERE audio_signature IS NOT NULL AND total_size > 0),
usual AS (SELECT ext, median(rate) AS usual FROM every GROUP BY 1),
x AS (SELECT audio_signature, print_id, origin, scanned_at, 'total_size' AS field_name, 1 AS full_, total_size > 0 AND abs(total_size / (heard * usual) - 1) <= 0.2 AS ok FROM p JOIN usual USING (ext)
UNION ALL SELECT audio_signature, print_id, origin, scanned_at, 'total_duration', 1, NOT isnan(total_duration) AND total_duration > 0 AND abs(total_duration - heard) <= greatest(2.0, heard * 0.002) FROM p
UNION ALL SELECT audio_signature, print_id, p.origin, p.scanned_at, 'source', n, n > 0 FROM p JOIN (SELECT concert_id, {REAL_SQL.format("source.kind")}::INT + {REAL_SQL.format("source.taper")}::INT
 + (len(list_filter(coalesce(source.mics, []), lambda m: {REAL_SQL.format("m")})) > 0)::INT AS n FROM concerts) c USING (concert_id))
SELECT audio_signature, field_name, print_id FROM x LEFT JOIN (SELECT origin, field_name, max(trust) AS trust FROM origin_trust GROUP BY 1, 2) t USING (origin, field_name) WHERE ok
QUALIFY row_number() OVER (PARTITION BY audio_signature, field_name ORDER BY full_ DESC, coalesce(trust, -1) DESC, scanned_at DESC NULLS LAST, print_id) = 1"""
#: All pairs of tracks. Where no track has several counterparts that compete, as here, their distinct numbers are the matching.
P3_SQL = """WITH q AS MATERIALIZED (SELECT audio_signature AS sig, len(tracks) AS n, unnest(tracks) AS t, generate_subscripts(tracks, 1) AS i FROM (SELECT * FROM folder_prints WHERE audio_signature IS NOT NULL QUALIFY row_number() OVER (PARTITION BY audio_signature ORDER BY print_id) = 1)),
w AS MATERIALIZED (SELECT sig, n, i, t.duration AS d, floor(t.duration / 7)::BIGINT AS c, t.fp[1] AS a1, t.fp[2] AS a2, t.fp[3] AS a3, t.fp[4] AS a4, t.fp[5] AS a5, t.fp[6] AS a6 FROM q),
m AS (SELECT x.sig AS a, y.sig AS b, x.n AS n, y.n AS k, x.i AS i, y.i AS j FROM w x JOIN (SELECT w.* EXCLUDE (c), c + s AS c FROM w, (SELECT unnest([-1, 0, 1]) AS s)) y ON x.c = y.c AND x.sig < y.sig
 WHERE abs(x.d - y.d) <= 7 AND bit_count(xor(x.a1, y.a1)) + bit_count(xor(x.a2, y.a2)) + bit_count(xor(x.a3, y.a3)) + bit_count(xor(x.a4, y.a4)) + bit_count(xor(x.a5, y.a5)) + bit_count(xor(x.a6, y.a6)) <= 28)
SELECT a AS signature_a, b AS signature_b FROM m GROUP BY 1, 2 HAVING 5 * least(count(DISTINCT i), count(DISTINCT j)) >= 3 * greatest(any_value(n), any_value(k))"""

SQL: dict[str, str] = {
    "p2_found": P2_SQL,
    "p3_found": P3_SQL,
    "p3_groups": f"""WITH RECURSIVE e AS MATERIALIZED ({P3_SQL}), g AS (SELECT signature_a AS u, signature_b AS v FROM e UNION ALL SELECT signature_b, signature_a FROM e), r AS (SELECT u AS node, u AS m FROM g UNION SELECT g.v, r.m FROM r JOIN g ON g.u = r.node)
SELECT s AS audio_signature, coalesce(least(s, (SELECT min(m) FROM r WHERE node = s)), s) AS group_id, (SELECT count(*) FROM g WHERE u = s) AS links FROM (SELECT DISTINCT audio_signature AS s FROM folder_prints WHERE audio_signature IS NOT NULL)""",
    "p4_replaced": """SELECT 'concerts' AS table_name, concert_id AS row_id, 'folder' AS field_name FROM concerts WHERE contains(folder, chr(65533)) UNION ALL SELECT 'concerts', concert_id, 'info_txt' FROM concerts WHERE contains(info_txt, chr(65533))
UNION ALL SELECT 'tracks', track_id, 'title' FROM tracks WHERE contains(title, chr(65533))""",
    "p5_exact": "SELECT concert_id AS row_id, venue_id AS ref_id FROM concerts JOIN venue_ref USING (venue)",
    "p6_whole": "SELECT pack_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS documents, 0::BIGINT AS repeated, 0::BIGINT AS split, 0::BIGINT AS overfull FROM pack_sizes",
    "p7_limits": "SELECT source, 0::BIGINT AS beyond FROM mix_targets t WHERE target_share > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.text <> '')",
    "p8_pieces": "SELECT doc_id, n AS pieces, n AS differing, n - 1 AS top FROM (SELECT doc_id, len(string_split(text, chr(10) || chr(10))) AS n FROM documents WHERE text IS NOT NULL)",
}

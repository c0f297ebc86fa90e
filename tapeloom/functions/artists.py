"""Artist names told by folder names and the directories above them, as native expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import YEAR, first_date_end, first_date_position, parse_date, strip_date_suffix
from .lines import CITY, DISC, EMBEDDED_DATE, LABEL, LINEAGE, MIC_PLACE, NOISE, PERSONNEL, SENTENCE, SOURCE_CODE, TRACK, VENUE_WORD, is_city, venue_city_region
from .text import ancestors, filled, let, path_name, strip, strip_chars

#: Directories that organise a library and name nobody.
NOT_AN_ARTIST = ("tapes", "bootlegs", "concerts", "live", "shows", "downloads", "music", "archive", "archives", "audio", "recordings", "files", "sbd", "aud", "flac", "mp3", "shn", "wav", "cd", "dvd", "new", "unsorted", "misc", "various", "various artists", "library", "collection")
LIBRARY_ROOTS = ("tapes", "bootlegs", "concerts", "live", "shows", "downloads", "music", "archive", "archives", "library", "collection", "new", "unsorted", "misc")
FORMAT_DIRS = ("audio", "files", "recordings", "tracks", "music", "songs", "flac", "flac files", "mp3", "wav", "shn", "shnf", "cd", "cd1", "cd2", "cd3", "dvd", "disc", "disc 1", "disc 2", "sbd", "aud")
GENERIC_TAIL = ("show", "set", "concert", "live", "audio", "recording", "recordings", "tape", "tapes", "untitled", "unknown", "misc", "disc", "cd")
US_END = r"(?i)(?<!\w)(?:A[LKZR]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY])\.?\s*$"
CA_END = r"(?i)(?<!\w)(?:ON|QC|BC|AB|MB|SK|NS|NB|NL|PE|YT|NT|NU)\.?\s*$"
JUNK = r" \-,_()\[\]\t"
#: A few common abbreviations; a library passes its own table of any size as `prefixes`.
PREFIXES = {"gd": "Grateful Dead", "jgb": "Jerry Garcia Band", "ph": "Phish", "wsp": "Widespread Panic", "moe": "moe.", "sci": "String Cheese Incident", "um": "Umphrey's McGee", "abb": "Allman Brothers Band", "srv": "Stevie Ray Vaughan", "dmb": "Dave Matthews Band"}


def prefix_key(c: Column) -> Column:
    """The letters before the first digit of a folder name, null if it doesn't begin so."""
    k = F.regexp_extract(F.lower(c), r"^([a-z]+)\d", 1)
    return F.when(k != "", k)


def expand_prefix(c: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    m = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    return F.try_element_at(m, prefix_key(c))


def clean_candidate(c: Column) -> Column:
    t = F.regexp_replace(strip_chars(c, JUNK), r"^\d{1,3}\s+(?=[A-Za-z])", "")
    t = strip_chars(F.element_at(F.split(t, r"\s+-\s+|\s+\(", 2), 1), JUNK)
    return let(t, lambda x: F.when(x.rlike(r"\p{L}") & F.length(x).between(2, 60), x))


def guess(c: Column, prefixes: Mapping[str, str] = PREFIXES) -> Column:
    """Artist before a date, or a registered abbreviation; null unless the shape is clear."""
    leading = r"^(?:19|20)\d{2}[-.]\d{2}[-.]\d{2}\s*-\s*([^-]+?)\s*-"

    def before(head: Column) -> Column:
        short = strip_chars(head, JUNK)
        return F.when((F.length(short) > 3) | ((F.length(short) == 3) & (short != F.lower(short))), clean_candidate(head))

    early = let(first_date_position(c), lambda pos: F.when(pos > 0, let(F.substring(c, F.lit(1), pos), before)))
    return F.coalesce(expand_prefix(c, prefixes), F.when(c.rlike(leading), F.trim(F.regexp_extract(c, leading, 1))).otherwise(early))


def after_leading_date(c: Column) -> Column:
    cut = r" \-,_.()\t"

    def name(head: Column) -> Column:
        ws = F.transform(F.filter(F.split(head, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(F.lower(w), r"[.,]+$", ""))
        generic = F.forall(ws, lambda w: w.isin(*GENERIC_TAIL) | ((F.length(w) == 1) & ~w.rlike(r"^\d$")))
        ok = (head != "") & ~head.rlike(VENUE_WORD) & ~head.rlike(MIC_PLACE) & head.rlike("^[A-Z0-9]") & F.length(head).between(2, 60) & ~head.rlike(YEAR) & ~generic
        return F.when(ok, head)

    tail = strip_chars(F.substring(c, first_date_end(c) + 1, F.length(c)), cut)
    return let(strip_chars(F.element_at(F.split(tail, r"\s+-\s+|\s+\(", 2), 1), cut), name)


def bare_folder(c: Column) -> Column:
    return let(strip_chars(c, r" \-,_.()\[\]"), _bare)


def _bare(t: Column) -> Column:
    ws = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    caps = F.size(F.filter(ws, lambda w: w.rlike(r"^\p{Lu}")))
    ok = (
        F.length(t).between(2, 60) & t.rlike(r"^[A-Z]|^\d+\s+[A-Z]") & ~t.rlike(r"\b\d{4}\b") & ~t.rlike(r"\d{1,2}[-._/]\d{1,2}[-._/]\d{1,4}")
        & ~t.rlike(US_END) & ~t.rlike(CA_END) & ~t.rlike(VENUE_WORD) & ~t.rlike(MIC_PLACE) & ~t.rlike(SOURCE_CODE)
        & ~t.rlike(r"(?i)\b(?:flac|mp3|wav|shn|24bit|16bit|lossless|master(?:ed)?)\b") & ~t.rlike(CITY) & (F.size(ws) <= 5) & (caps * 2 >= F.size(ws))
    )
    return F.when(ok, t)


def weak(c: Column) -> Column:
    """Last resort: the name after a leading date, or the folder name itself."""
    return let(first_date_position(c), lambda pos: F.when(pos == 0, after_leading_date(c)).when(pos.isNull(), bare_folder(c)))


def in_various(path: Column) -> Column:
    return F.exists(ancestors(path), lambda a: F.lower(a).isin("various artists", "various"))


def candidates(name: Column) -> Column:
    """Ordered distinct spellings of a directory name to try: as is, without a number, cut at year, dash, bracket."""
    return let(F.regexp_replace(name, r"^\d{1,3}[\s._-]+", ""), lambda bare: _candidates(name, bare))


def _candidates(name: Column, bare: Column) -> Column:
    year = F.regexp_instr(bare, F.lit(r"\b(19|20)\d{2}\b"))
    head = F.substring_index(bare, "-", 1)
    raw = F.array(
        name, bare, F.when(year > 1, F.substring(bare, F.lit(1), year - 1)), F.when(bare.contains(" - "), F.substring_index(bare, " - ", 1)),
        F.when(bare.contains("-") & head.contains(" "), head), F.when(bare.contains("["), F.trim(F.substring_index(bare, "[", 1))), F.when(bare.contains("("), F.trim(F.substring_index(bare, "(", 1))),
    )
    return F.array_distinct(F.filter(F.transform(raw, lambda s: strip_chars(s, r" \-,_(\[{")), lambda s: s.isNotNull() & (s != "")))


def _year_or_dated(name: Column) -> Column:
    return F.trim(name).rlike(r"^(?:19|20)\d{2}$") | F.coalesce(first_date_position(name) == 0, F.lit(False))


def _trust_one(name: Column) -> Column:
    """struct(stop, artist) that one directory tells: neither means go on upwards."""
    low = F.lower(name)
    null = F.lit(None).cast("string")
    say = lambda stop, artist: F.struct(F.lit(stop).alias("stop"), artist.alias("artist"))
    head = F.trim(F.substring_index(name, " - ", 1))
    rest = F.substring(name, F.length(F.substring_index(name, " - ", 1)) + 4, F.length(name))
    dash_ok = let(rest, lambda r: (r != "") & (F.substring(r, 1, 30).rlike(YEAR) | first_date_position(r).isNotNull())) & F.length(head).between(2, 60) & head.rlike("^[A-Za-z0-9]") & ~head.rlike(YEAR)
    cands = F.filter(F.transform(candidates(name), lambda s: strip_chars(s, r" \-,_(\[{")), lambda s: (s != "") & (s != name) & ~s.contains(" - ") & ~s.rlike(YEAR) & ~s.rlike(r"[\[(]") & s.rlike("^[A-Za-z0-9]") & F.length(s).between(2, 60))
    before = strip_chars(F.substring(name, F.lit(1), F.regexp_instr(name, F.lit(YEAR)) - 1), r" \-_,.()\[\]")
    before = let(before, lambda b: F.when((b != "") & ~b.contains(" - ") & F.length(b).between(2, 60) & b.rlike("^[A-Za-z0-9]"), b))
    return let(first_date_position(name), lambda pos: (
        F.when(low.isin(*FORMAT_DIRS), say(False, null))
        .when(low.isin("various artists", "various"), say(True, F.lit("Various Artists")))
        .when(low.isin(*NOT_AN_ARTIST), say(True, null))
        .when(name.rlike(r"^[\[(_.]"), say(True, null))
        .when(F.trim(name).rlike(r"^(?:19|20)\d{2}$") | F.coalesce(pos == 0, F.lit(False)), say(False, null))
        .when(name.contains(" - "), say(False, F.when(dash_ok, head)))
        .when(name.rlike(YEAR), say(False, F.coalesce(F.try_element_at(cands, F.lit(1)), before)))
        .when(~name.rlike("^[A-Za-z0-9]"), say(True, null))
        .otherwise(say(False, F.when(F.length(name).between(2, 60), name)))
    ))


def trust_parent(path: Column) -> Column:
    """The nearest directory above that reads as an artist, unless a stop comes first."""
    told = F.filter(F.transform(ancestors(path), _trust_one), lambda x: x["stop"] | x["artist"].isNotNull())
    return F.when(~F.lower(path_name(path)).isin(*LIBRARY_ROOTS), F.try_element_at(told, F.lit(1))["artist"])


def ancestor_probes(path: Column) -> Column:
    """array of struct(depth, stop, various, candidates): what to look up in a lexicon, nearest first; a stop ends the walk."""
    up = ancestors(path)
    level = F.transform(up, lambda a, i: F.struct(
        i.alias("depth"), F.lower(a).isin(*NOT_AN_ARTIST).alias("stop"), F.lower(a).isin("various artists", "various").alias("various"),
        F.when(_year_or_dated(a), F.array().cast("array<string>")).otherwise(candidates(a)).alias("candidates"),
    ))
    return level


def salvage(line: Column) -> Column:
    """The artist before the first comma of `Artist, City, date, source`, if it reads as a name."""
    month = r"(?i)^(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Sept|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+\d{1,2}$"

    def name(head: Column) -> Column:
        ok = (
            (F.length(head) <= 60) & (F.regexp_count(head, F.lit(r"\p{L}")) >= 2) & ~head.rlike(month) & ~head.rlike(SENTENCE) & ~head.rlike(SOURCE_CODE)
            & ~head.rlike(EMBEDDED_DATE) & parse_date(head).isNull() & ~head.rlike(VENUE_WORD) & ~head.rlike(MIC_PLACE) & ~is_city(head)
        )
        return F.when(ok, head)

    head = let(strip_date_suffix(strip_chars(F.substring_index(line, ",", 1), r"*#=\-_ \t")), name)
    return F.when(line.contains(",") & ~line.rlike(MIC_PLACE) & ~line.rlike(LINEAGE), head)


def _artist_of_line(line: Column) -> Column:
    """struct(stop, artist) of one of the first lines of notes."""
    null = F.lit(None).cast("string")

    def by_name(s: Column) -> Column:
        plain = strip(F.regexp_replace(s, r"\s*\([^)]*\)\s*$", ""))
        return strip_date_suffix(let(plain, lambda p: F.when((p != s) & F.length(p).between(2, 60) & p.rlike("^[A-Z]"), p).otherwise(s)))

    def by_text(s: Column) -> Column:
        refused = s.rlike(SENTENCE) | s.rlike(LINEAGE) | s.rlike(LABEL) | s.rlike(PERSONNEL) | s.rlike('^["“][^"”]{2,80}["”][^"“]{1,5}["“]')
        place = s.rlike(VENUE_WORD) | s.rlike(MIC_PLACE) | is_city(s) | venue_city_region(s)["venue"].isNotNull()
        rich = (F.regexp_count(s, F.lit(r"\p{L}")) < 2) | (F.length(s) > 100)
        coded = ~refused & (s.rlike(SOURCE_CODE) | s.rlike(EMBEDDED_DATE))
        return F.when((s == "") | s.rlike(TRACK), null).when(rich | coded, salvage(s)).when(refused | place, null).otherwise(by_name(s))

    def go(dated: Column) -> Column:
        noise, stop = line.rlike(NOISE), line.rlike(DISC) & ~dated
        artist = F.when(noise | stop, null).when(dated, salvage(line)).otherwise(let(strip_chars(line, r"*#=\-_ \t"), by_text))
        return F.struct((stop & ~noise).alias("stop"), artist.alias("artist"))

    return let(parse_date(line).isNotNull(), go)


def first_artist_line(lines: Column) -> Column:
    """From the first six non-blank lines: the first that names the artist, before any disc marker."""
    none = F.struct(F.lit(False).alias("stop"), F.lit(None).cast("string").alias("artist"))
    told = F.aggregate(F.slice(lines, 1, 6), none, lambda s, x: F.when(s["stop"] | s["artist"].isNotNull(), s).otherwise(_artist_of_line(x)))  # no line is read after the one that decides
    return let(told["artist"], filled)

"""String building blocks with the semantics the rules need: Unicode-aware, null for blank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space at either end.
EDGE = r"(?U)^\s+|\s+$"
#: Phrases and shapes of names that are no artist.
JUNK_SHAPES = (
    r"(?i)^(?:cd|disc|disk|vol\.?|side|set|tape|part)\s*(?:\d{1,3}|[A-Z])\s*$",
    r"^\d{4}[-_/ ]?(?:\d{2}[-_/ ]?\d{0,2}|x{1,2}[-_]?x{0,2}|[A-Za-z])",
    r"^[\(\[\{;:,]",
    r"(?i)\b(?:files_from|tapetyrant|swissbird|naughtyknight|simplexsimplicissimus|prrp|krw_co|thir13en|archive series|fm[/\s]?soundboard|courtesy of|never buy or sell|christmas gift from|mystical mermaid|digital brother|nola benefit|cannabis cup|goody-?rdwm|speed[\s/]?pitch|generated on)\b",
    r"(?i)^re-?master(?:ed)?\s*$|^remix(?:ed)?\s*$|\bre-?master(?:ed)?\s*\*\b",
)
#: Words of a performance of somebody else's songs.
TRIBUTE = r"(?i)\b(?:tribute|salute|plays|sings|memorial|in memoriam|covers|covering|honor|honoring|honors|performs?|performing|interpret|interprets|interpreting|revisit(?:s|ed|ing)?|reimagine[ds]?|reimagining|songs of|music of|songbook|in the style of)\b"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once: keeps an expression that uses a long one many times from growing with every use."""
    return F.transform(F.array(c), lambda x: f(x))[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE, "")


def strip_chars(c: Column, chars: str) -> Column:
    """Any of `chars` (the inside of a character class) off both ends."""
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def filled(c: Column) -> Column:
    """The stripped text, null if blank."""
    s = strip(c)
    return F.when(s != "", s)


def normalize_name(c: Column) -> Column:
    """Key of a name for equality: lower case, no leading `the`, no punctuation, single spaces."""
    t = F.regexp_replace(F.lower(strip(c)), r"(?U)^the\s+", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def is_junk_name(c: Column) -> Column:
    """True for text that is no artist name; false for null and blank, which are handled elsewhere."""
    s = strip(c)
    shape = F.lit(False)
    for pattern in JUNK_SHAPES:
        shape = shape | s.rlike(pattern)
    shouted = (F.length(s) >= 6) & s.rlike(r"^\p{L}+$") & (s == F.upper(s)) & (s != F.lower(s))
    return F.coalesce(F.when(s == "", False).when(F.length(s) < 2, True).otherwise(shape | shouted), F.lit(False))


def sort_key(c: Column) -> Column:
    """A name without its leading article and outer blanks, for sorting; empty for null."""
    return F.coalesce(strip(F.regexp_replace(c, r"(?U)^[Tt]he\s+", "")), F.lit(""))


def human_bytes(c: Column) -> Column:
    """`1.5 KiB`: steps of 1024, one decimal, bytes too."""
    out = F.format_string("%.1f PiB", c / F.lit(float(1 << 50)))
    for k, unit in reversed(list(enumerate(("B", "KiB", "MiB", "GiB", "TiB")))):
        out = F.when(c < F.lit(float(1 << (10 * (k + 1)))), F.format_string(f"%.1f {unit}", c / F.lit(float(1 << (10 * k))))).otherwise(out)
    return out


def release_artist(c: Column) -> Column:
    """Artist of a release folder (`Artist - Title [tags]`): null for dotted scene names and marked folders."""
    head = strip(F.substring_index(c, " - ", 1))
    dotted = (F.length(head) - F.length(F.replace(head, F.lit("."), F.lit(""))) >= 3) & ~head.contains(" ")
    clean = strip(F.regexp_replace(head, r"(?i)\s*[\[(]?\d{2,3}\s*k(?:bps)?[\])]?\s*$", ""))
    return F.when(c.rlike(r"^[_.(\[]") | dotted | (clean == ""), F.lit(None).cast("string")).otherwise(clean)


def upper_share(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(r"\p{Lu}")) / letters).otherwise(F.lit(0.0))


def digit_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(r"\p{Nd}")) / F.length(c)).otherwise(F.lit(0.0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def path_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    """File name without its last extension; a leading dot alone is no extension."""
    return F.regexp_replace(path_name(c), r"(?<=.)\.[^.]*$", "")


def extension(c: Column) -> Column:
    """Lower-case extension with its dot, empty if none."""
    return F.lower(F.regexp_extract(path_name(c), r"(?<=.)(\.[^.]+)$", 1))


def ancestors(c: Column, depth: int = 8) -> Column:
    """Names of the directories above a path, nearest first, at most `depth`."""
    parts = F.filter(F.split(c, "/"), lambda p: p != "")
    up = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.slice(up, 1, depth)

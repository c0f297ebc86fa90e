"""Dates in noisy text: formats in a fixed order; the first hit of a format counts if the calendar has it, else the next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

_M, _D = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
_MON = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)[a-z]*\.?"
#: Fixed values, in order of precedence: name -> (pattern, groups of year, month, day). `y2` years are 19xx from 60 on.
FORMATS: dict[str, tuple[str, tuple[int, int, int]]] = {
    "iso": (rf"(?<!\d)((?:19|20)\d{{2}})[-._/]{_M}[-._/]{_D}(?!\d)", (1, 2, 3)),
    "compact": (r"(?<!\d)((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)", (1, 2, 3)),
    "split": (r"(?<!\d)((?:19|20)\d{2})[._](0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)", (1, 2, 3)),
    "us": (rf"(?<!\d){_M}[-._/]{_D}[-._/]((?:19|20)\d{{2}})(?!\d)", (3, 1, 2)),
    "prose": (rf"(?i)\b(?:{_MON}\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MON}[,\s]+(\d{{4}})", (4, 3, 2)),
    "month_day": (rf"(?i)\b{_MON}\s+(\d{{1,2}})(?:st|nd|rd|th)?[,\s]+(\d{{4}})", (3, 1, 2)),
    "us_y2": (rf"(?<!\d){_M}[-._/]{_D}[-._/](\d{{2}})(?!\d)", (3, 1, 2)),
    "y2": (rf"(?<!\d)(\d{{2}})[-._]{_M}[-._]{_D}(?!\d)", (1, 2, 3)),
}
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _number(c: Column) -> Column:
    """A month by number or name, as two digits."""
    m = F.lit(None).cast("int")
    for k, name in enumerate(MONTHS, 1):
        m = F.when(F.lower(F.substring(c, 1, 3)) == name, k).otherwise(m)
    return F.lpad(F.coalesce(m, F.expr("null").cast("int")).cast("string"), 2, "0")


def _one(c: Column, name: str) -> Column:
    pattern, (y, m, d) = FORMATS[name]
    g = lambda k: F.regexp_extract(c, pattern, k)
    year = g(y)
    if name.endswith("y2"):
        year = F.when(year >= "60", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    month = _number(g(m)) if name in ("prose", "month_day") else F.lpad(g(m), 2, "0")
    return F.when(c.rlike(pattern), F.date_format(F.try_to_date(F.concat_ws("-", year, month, F.lpad(g(d), 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd"))


def parse_date(c: Column) -> Column:
    """ISO date of the text or null. With a day-first and a month-first prose hit, day-first decides alone."""
    prose = F.when(c.rlike(FORMATS["prose"][0]), _one(c, "prose")).otherwise(_one(c, "month_day"))
    # each of the eight patterns needs four digits together, or three numbers with marks between: a cheap test before them
    return F.when(c.rlike(r"\d{4}|\d[-._/]\d{1,2}[-._/]\d"), F.coalesce(_one(c, "iso"), _one(c, "compact"), _one(c, "split"), _one(c, "us"), prose, _one(c, "us_y2"), _one(c, "y2")))


def has_date_shape(c: Column) -> Column:
    return c.rlike(r"(?:(?:19|20))?\d{2}[-._]?\d{2}[-._]?\d{2}")


def first_date_position(c: Column) -> Column:
    """0-based start of the first date-like or bare-year text, null if none."""
    at = [F.when(c.rlike(p), F.regexp_instr(c, F.lit(p))) for p, _ in FORMATS.values()] + [F.when(c.rlike(YEAR), F.regexp_instr(c, F.lit(YEAR)))]
    return F.least(*at) - 1


def first_date_end(c: Column) -> Column:
    """0-based end of the match that starts first; of two at one place the format listed first."""
    found = [F.when(c.rlike(p), F.struct((F.regexp_instr(c, F.lit(p)) - 1).alias("s"), F.lit(k).alias("k"), F.length(F.regexp_extract(c, p, 0)).alias("n"))) for k, p in enumerate([*(p for p, _ in FORMATS.values()), YEAR])]
    best = F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return best["s"] + best["n"]


def strip_date_suffix(c: Column) -> Column:
    """`Name - December 13` to `Name`: the tail after the first ` - ` goes if it begins like a date."""
    month = r"(?i)^\s*(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Sept|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b"

    def go(s: Column) -> Column:
        raw = F.substring_index(s, " - ", 1)
        tail = F.regexp_replace(F.substring(s, F.length(raw) + F.lit(4), F.length(s)), r"^[ \t\-_,.]+", "")
        dated = let(tail, lambda t: let(F.substring(t, 1, 40), lambda x: parse_date(x).isNotNull()) | t.rlike(month) | t.rlike(r"^\s*\d{1,4}[-./]") | t.rlike(r"^(?:19|20)\d{2}"))
        return F.when(s.contains(" - ") & (strip(raw) != "") & dated, strip(raw)).otherwise(s)

    return let(c, go)

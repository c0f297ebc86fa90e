"""Notes of a recording to fields: labels, the line that names the artist, and the first lines' venue and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.artists import first_artist_line
from ..functions.dates import parse_date
from ..functions.text import filled, let, strip, strip_chars
from .setlist import lines_of

BAD_ARTIST = r"(?i)^(?:venue|city|state|country|location|source|lineage)\s+"


def _value(body: Column, pattern: str, ok) -> Column:
    v = strip_chars(strip(F.regexp_extract(body, pattern, 1)), ",")
    return let(v, lambda x: F.when((x != "") & ok(x), x))


def _labels(body: Column) -> dict[str, Column]:
    low = F.lower(body)  # a plain search for the label's word comes before each pattern that needs it
    free = lambda x: F.lit(True)
    person = lambda x: ~x.rlike(L.MIC_PLACE)
    place = lambda x: ~x.rlike(L.MIC_PLACE) & ~x.rlike(L.LINEAGE) & ~x.rlike(L.NOT_VENUE_START)
    colon = lambda w, ok: F.when(low.contains(w), _value(body, rf"(?imd)^{w}\s*[:\-]\s*(.+)", ok))
    row = lambda w: rf"(?md)^[{w[0].upper()}{w[0]}]{w[1:]}\s+([A-Z][^\n]{{1,80}}?)\s*$"
    strong = F.lit(False)
    for w in ("artist", "band", "venue", "location"):
        strong = strong | (low.contains(w) & body.rlike(row(w)))
    spaced = lambda w, ok: F.when(low.contains(w), _value(body, row(w), ok))
    gated = lambda w: F.when(low.contains(w) & strong, spaced(w, free))
    return {
        "artist": F.coalesce(colon("band", person), colon("artist", person)), "artist_row": F.coalesce(spaced("artist", person), spaced("band", person)),
        "venue": F.coalesce(colon("location", place), colon("venue", place), spaced("venue", place), spaced("location", place)),
        "city": F.coalesce(colon("city", free), gated("city")), "region": F.coalesce(gated("state"), gated("country")),
    }


def _place_of_line(line: Column, artist: Column, no_venue: Column) -> Column:
    """What one of the first lines says of venue and place, and whether it ends the search; a venue alone only if `no_venue`."""
    own = F.coalesce(line == artist, F.lit(False))

    def told(x: Column) -> Column:
        live = ~x["stop"] & ~x["skip"]
        say = lambda c: F.when(live, c)  # noqa: E731  (nothing more is read of a line that doesn't count)
        three = let(L.venue_city_region(line), lambda t: F.when(t["venue"].isNotNull() & L.is_venue(t["venue"]), t))
        return F.struct(
            x["stop"], x["skip"], say(three).alias("three"), F.coalesce(say(L.is_city(line)), F.lit(False)).alias("city"),
            say(F.trim(F.element_at(F.split(line, ",", 2), 1))).alias("town"), say(F.trim(F.try_element_at(F.split(line, ",", 2), F.lit(2)))).alias("region"),
            say(F.when(no_venue & L.is_venue(line), strip_chars(line, ","))).alias("venue"),
        )

    def flags(dated: Column) -> Column:
        stop = ~own & ~dated & line.rlike(L.DISC)
        return F.struct(stop.alias("stop"), (own | dated | line.rlike(L.TRACK) | line.rlike(L.SENTENCE) | L.is_prose(line)).alias("skip"))

    return let(let(parse_date(line).isNotNull(), flags), told)


def parse_notes(docs: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``n_artist, n_date, n_venue, n_city, n_region``; all null for a null or empty body. Other columns stay."""
    b = F.coalesce(F.col(body), F.lit(""))
    d = docs.withColumn("_lines", F.filter(F.transform(lines_of(b), strip), lambda x: x != ""))
    d = d.withColumn("_first", first_artist_line(F.col("_lines")))
    lab = _labels(b)
    d = d.withColumns({f"_{k}": v for k, v in lab.items()})
    artist = F.coalesce("_artist", "_first", "_artist_row")
    d = d.withColumn("n_artist", let(artist, lambda a: F.when(~a.rlike(BAD_ARTIST), filled(a))))
    d = d.withColumn("n_date", parse_date(b))
    start = F.struct(F.col("_venue").alias("venue"), F.col("_city").alias("city"), F.col("_region").alias("region"), F.lit(False).alias("end"))

    def told(s: Column, x: Column) -> Column:
        end = s["end"] | x["stop"]
        live = ~end & ~x["skip"]
        v, c = s["venue"].isNull(), s["city"].isNull()
        use3 = live & (v | c) & x["three"].isNotNull()
        use_c = live & ~use3 & c & x["city"]
        use_v = live & ~use3 & ~use_c & v & x["venue"].isNotNull()
        return F.struct(
            F.when(use3, F.coalesce(s["venue"], x["three"]["venue"])).when(use_v, x["venue"]).otherwise(s["venue"]).alias("venue"),
            F.when(use3, F.coalesce(s["city"], x["three"]["city"])).when(use_c, x["town"]).otherwise(s["city"]).alias("city"),
            F.when(use3, F.coalesce(s["region"], x["three"]["region"])).when(use_c, F.coalesce(x["region"], s["region"])).otherwise(s["region"]).alias("region"),
            end.alias("end"),
        )

    def step(s: Column, line: Column) -> Column:  # no line is read after the one that decides
        done = s["end"] | (s["venue"].isNotNull() & s["city"].isNotNull())
        return F.when(done, s).otherwise(let(_place_of_line(line, F.col("_first"), s["venue"].isNull()), lambda x: told(s, x)))

    d = d.withColumn("_place", F.aggregate(F.slice("_lines", 1, 10), start, step))
    d = d.withColumns({f"n_{k}": filled(F.col("_place")[k]) for k in ("venue", "city", "region")})
    return d.drop("_lines", "_first", "_place", *[f"_{k}" for k in lab])

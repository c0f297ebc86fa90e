"""Classes of lines in notes about a recording. Every pattern is a fixed value; each function gives a boolean column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digit_share, upper_share, word_count

NOISE = r"(?i)^(?:no\s+errors?|errors?\s+found|\s*$|https?://|www\.|visit\s+(?:www\.|https?://|our\s+)|performer\s*[:\-]|\d+\s*(?:kbps|khz|bit|byte|mb|gb)|flac\s+fingerprint|md5|sha\d+|tracklist|setlist|recording\s+info|lineage|source|notes?|file\s*info|audiochecker|aucdtect|shntool|sbe(?:ok)?|ffp|checksum|(?:prrp|tsbf|evsd|jems)\s*(?:gs|sae|\d|http))"
SENTENCE = r"(?i)^(?:this\s+(?:is|was|recording|show|tape)|these\s+are|recorded|taped|taping|transferred|transfer\s+from|mastered|dedicated|thanks|thank\s+you|please|note|the\s+following|here\s+(?:is|are)|my\s+(?:cassette|tape|copy)|(?:all|most)\s+(?:song|track)s?|an?\s+(?:interesting|excellent|incredible|amazing|great|wonderful|awesome|fantastic|beautiful|nice|good|decent|solid|killer|classic|rare|unique|special|legendary|superb|fine)|we['’](?:re|ve|ll|d)|i['’](?:m|ve|ll|d)|you['’](?:re|ve|ll|d)|(?:what|where|when|why|how|who)\s+(?:i|we|you|they|the|this|that|is|was|are|were|to|do|did|can|could|should|would)|from\s+(?:bootleg|tape|cassette|cd|the|a)|audience\s+recording|complete\s+show|partial\s+show)\b"
SOURCE_CODE = r"(?i)\b(?:SBD|AUD|DAT|MTX|MATRIX|DAUD|ALD|FOB|ROIO|FLAC|SHN)\d*\b"
EMBEDDED_DATE = r"\b\d{1,4}[-._/]\d{1,2}[-._/]\d{1,4}\b"
VENUE_WORD = r"(?i)\b(?:arena|stadium|amphitheat(?:re|er)|coliseum|colosseum|cent(?:er|re)|theat(?:re|er)|auditorium|hall|club|pavilion|fairgrounds|civic|gardens|grounds|bowl|palace|rink|ballroom|casino|university|college|dome|forum|lounge|speedway|festival|tabernacle)\b"
MIC_PLACE = r"(?i)\b(?:FOB|DFC|OTS|ROC|DIN|ORTF|NOS|XY|AB|M/?S|PAS|mics?|capsules?|pair|clamped|stand|stands|stack|stacks|omni|omnis|cards?|cardioid|hypercard|subcard|\d+\s*(?:ft|feet|'|’|m|meters?)\s+(?:from|high|tall|up|back|off)|from\s+(?:the\s+)?(?:stage|soundboard|sbd|board)|(?:on|at)\s+(?:the\s+)?(?:stage|sbd|soundboard|board|rail)|row\s+[a-z]\b|right\s+of\s+center|left\s+of\s+center|right\s+stack|left\s+stack|balcony)\b"
LINEAGE = r"\s[>→]\s|\s->\s"
NOT_VENUE_START = r"(?i)^\s*(?:transfer(?:\s+info)?|recording(?:\s+info|\s+notes)?|the\s+recording|lineage|source(?:\s+info)?|tap(?:er|ed(?:\s+by)?)|transferred|mastered|setup|equipment|\(\s*[A-Za-z][A-Za-z0-9\-\s]{0,14}\s*\)[,\s])"
LABEL = r"(?i)^(?:[A-Z][^:\n]{0,40}\s+)?(?:source|transfer|lineage|recording|recorded|taper|taping|seeded|info|gear|equipment|quality|format|encode|encoded|ripped|playback|noise|track[\s-]*list|track\s*split|uploaded|shared|originally)[^:\n]{0,15}:\s"
PERSONNEL = r"""(?i)^[A-Z][\w\s.,'&"]+?\s*[—\-(]\s*(?:[a-z]+\s+){0,3}(?:guitars?|vocals?|drums?|bass|keyboards?|piano|organ|saxophone|sax|harmonica|violin|cello|mandolin|banjo|trumpet|trombone|percussion|backing|lead\s+vocals?|rhythm\s+guitar|lead\s+guitar)\b"""
CREDIT = r"(?i)^(?:taped|recorded|tracked|seeded|mastered|transferred|transfer|edited|mixed|engineered|produced|presented|uploaded|shared|posted|encoded|ripped)(?:\s*&\s*\w+)?\s+(?:by|on)\b"
PROSE_VERB = r"(?i)\b(?:is|was|are|were|be|been|being|has|have|had|came|comes|come|went|goes|going|did|does|done|doing|plays|played|playing|play|check|checked|checking|includes|included|including|include|recorded|recording|taped|taping|sounds|sounded|sound|appears|appeared|appearing)\b"
DISC = r"(?i)^\s*(?:(?:disc|cd|disk)\s*([0-9]+|one|two|three|four|five|six|seven|eight)\b|(?:set)\s*([0-9]+|i{1,3}|iv|v|one|two|three|four)\b|(encore)\b|(early\s*show)\b|(late\s*show)\b|(matinee(?:\s+show)?)\b|(evening(?:\s+show)?)\b)"
TRACK = r"(?i)^\s*(?:d\d+)?[ts]?(\d{1,3})(?:\s*[-.)_\s]\s*|:\s+)(.+?)\s*$"
VINYL = r"^\s*([A-H])\s*[-.]?\s*(\d{1,2})(?:\s*[-.)_\s]\s*|:\s+)(.+?)\s*$"
SKIP = r"(?i)^\s*\d+\.?\s*(?:md5|ffp|sha\d+|bytes?|samples?|kb|mb|gb)\b"
DURATION = r"\s+\d{0,3}:\d{2}\s*$"
HEADER = r"(?i)^\s*(?:set[\s-]*list|track[\s-]*list(?:ing)?|tracks|songs|songlist|playlist)\s*[:.\-]?\s*$"
CITY = r"^[A-Z][A-Za-z.'\- ]+,\s*[A-Za-z][A-Za-z.'\- ]{1,}$"
CHECKSUM_LINE = r"(?i)^(?:[a-f0-9]{16,}\s+[*?]?\S.*|\S+\.(?:flac|shn|wav|mp3):[a-f0-9]{16,})$"
STATES = tuple("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split())
COUNTRIES = ("England", "Scotland", "Wales", "Ireland", "Canada", "Germany", "France", "Netherlands", "Italy", "Spain", "Japan", "Australia", "UK", "USA", "Mexico", "Belgium", "Sweden", "Norway", "Denmark", "Switzerland", "Austria", "Finland", "Poland", "Greece", "Portugal", "Brazil", "Argentina", "Russia", "China", "India")


def is_city(c: Column) -> Column:
    return c.rlike(CITY)


def is_prose(c: Column) -> Column:
    """A sentence rather than a name: long, many words, a verb among five, or a shouted banner of four."""
    t = F.trim(c)
    return (F.length(t) > 60) | (word_count(t) >= 8) | ((word_count(t) >= 5) & t.rlike(PROSE_VERB)) | ((word_count(t) >= 4) & (upper_share(t) > 0.7))


def is_venue(c: Column) -> Column:
    low = F.lower(c)
    marks = F.lit(False)
    for m in ("http://", "https://", "@", "flac ", ".flac", ".shn", ".wav", "kbps", "khz"):
        marks = marks | low.contains(m)
    return (
        F.length(c).between(3, 120) & ~c.rlike(NOISE) & ~c.rlike(NOT_VENUE_START) & ~c.rlike(LINEAGE) & ~c.rlike(CREDIT) & ~c.rlike(PERSONNEL) & ~c.rlike(LABEL)
        & ~c.rlike(r"\d{5,}") & ~marks & (digit_share(c) <= 0.3) & ~c.rlike(MIC_PLACE) & c.rlike("[A-Z]")
    )


def venue_city_region(c: Column) -> Column:
    """struct(venue, city, region) of `Venue, City, ST` with a known state or country; nulls otherwise."""
    parts = F.transform(F.split(c, ","), lambda p: F.trim(p))
    n = F.size(parts)
    at = lambda k: F.try_element_at(parts, k)
    region, city = at(F.lit(-1)), at(F.lit(-2))
    venue = F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), ", ")
    ok = (n >= 3) & (venue != "") & (city != "") & region.isin(*STATES, *COUNTRIES)
    null = F.lit(None).cast("string")
    return F.struct(F.when(ok, venue).otherwise(null).alias("venue"), F.when(ok, city).otherwise(null).alias("city"), F.when(ok, region).otherwise(null).alias("region"))


def city_of_folder(c: Column) -> Column:
    """struct(city, region) told by a folder name: `, City, ST`, then `City ST`, then `, City, Country`."""
    comma = r",\s*([A-Z][A-Za-z.'\- ]+?),\s*([A-Z]{2})\b"
    bare = rf"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}})\s+({'|'.join(STATES)})\b"
    land = rf",\s*([A-Z][A-Za-z.'\- ]+?),\s*({'|'.join(COUNTRIES[:14])})\b"
    out = F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("region"))
    for p in (land, bare, comma):
        out = F.when(c.rlike(p), F.struct(F.trim(F.regexp_extract(c, p, 1)).alias("city"), F.regexp_extract(c, p, 2).alias("region"))).otherwise(out)
    return out

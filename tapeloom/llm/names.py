"""Reading names as people type them: folding, tokens, token and name comparison. Pure Python, used by problems 1 and 5."""

from __future__ import annotations

import itertools
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Fillers that name nothing.
FILLERS = frozenset(
    "unknown|unknown artist|various|various artists|va|v a|n a|na|none|null|tba|tbd|private|private party|venue unknown|unknown venue|unknown city|artist unknown|no artist|untitled|misc|anonymous|anon|not known|undefined|nil|x|xx|xxx|test|city unknown|unk".split("|")
)
#: Words that tell the kind of a venue, by their usual spellings; a phrase is one kind.
VENUE_TYPES = (
    "amphitheatre|amphitheater|arena|auditorium|ballroom|bar|cafe|casino|center|centre|civic|club|coliseum|colosseum|dome|fairgrounds|festival|field|forum|garden|gardens|grounds|gym|gymnasium|hall|house|lounge|memorial|music|opera|palace|park|pavilion|playhouse|pub|room|saal|salon|stadium|stage|tavern|teatro|theater|theatre|theatro|university|warehouse|auditorio|halle|palais|palacio|sala|salle|stadion|arts"
).split("|")
#: Short forms with letters left out of the middle.
SHORT = {"aud": "auditorium", "amph": "amphitheatre", "blrm": "ballroom", "bldg": "building", "ctr": "center", "cntr": "center", "cen": "center", "centre": "center", "theater": "theatre", "theatro": "teatro", "thtr": "theatre", "thr": "theatre", "fest": "festival", "gnds": "grounds", "grnds": "grounds", "gds": "grounds", "gym": "gymnasium", "hl": "hall", "hse": "house", "mem": "memorial", "meml": "memorial", "mus": "music", "op": "opera", "pav": "pavilion", "plc": "palace", "stad": "stadium", "stdm": "stadium", "tav": "tavern", "tvn": "tavern", "univ": "university", "u": "university", "whse": "warehouse", "wrhse": "warehouse", "playhse": "playhouse", "lnge": "lounge", "fairgr": "fairgrounds", "fairgnds": "fairgrounds", "amphitheater": "amphitheatre", "colosseum": "coliseum", "orch": "orchestra", "proj": "project", "co": "company", "bros": "brothers", "hwy": "highway", "riv": "river", "mtn": "mountain", "isl": "island", "jct": "junction", "stet": "quintet", "atet": "quartet", "stn": "station"}
#: Short forms in place names.
PLACE_SHORT = {"ft": "fort", "mt": "mount", "mnt": "mount", "st": "saint", "ste": "saint", "pt": "port", "prt": "port", "n": "north", "s": "san", "spgs": "springs", "sprgs": "springs", "fls": "falls", "no": "north", "nw": "new", "chat": "chateau"}
#: Given names and what they are called for short, as far as :func:`diminutive` does not tell.
NICKNAMES = {
    "albert": "al bert bertie", "alexander": "al sandy sasha xander lex", "alexandra": "sandra lexi", "andrew": "drew", "anthony": "tony", "catherine": "kate katie", "charles": "chuck", "christopher": "kit topher", "christine": "tina", "dmitri": "dima mitya", "dorothy": "dot dottie dolly", "edward": "ed eddie ted ned", "eleanor": "ellie nell nora", "elizabeth": "liz lizzie beth betty bess libby", "esther": "essie", "florence": "flossie", "frances": "frankie", "francis": "frank frankie", "gabriella": "ella", "george": "georgie", "gerald": "jerry", "harold": "hal", "henry": "hank harry", "ingrid": "inga", "jacob": "jake", "james": "jim jimmy", "john": "jack johnny", "joseph": "joe joey", "josephine": "jo", "lawrence": "larry laurie", "leonard": "len lenny", "leonora": "nora", "mabel": "mae may", "margaret": "maggie meg peggy greta", "michael": "mike", "nicole": "nikki", "odette": "etta", "olivia": "liv livvy", "oliver": "ollie", "patricia": "tricia", "patrick": "paddy", "pauline": "polly", "philippa": "pippa pip", "quentin": "quin", "rebecca": "becky becca", "richard": "dick", "robert": "bob bobby bert", "sebastian": "bas", "stephen": "steve", "susan": "sue", "theodore": "ted teddy", "theresa": "terry tess", "thomas": "tom tommy", "ursula": "ulla", "victoria": "tori", "virginia": "ginny", "william": "bill billy liam", "winifred": "fred",
}
FORMAL: dict[str, frozenset[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        FORMAL[_s] = FORMAL.get(_s, frozenset()) | {_full}
STOP = frozenset("the thee teh te of and at in und et de live from".split())
TRIBUTE = frozenset("tribute tributes trib homage".split())
OCR = str.maketrans("01345", "oleas")
#: Longer words are compared one by one.
IN_STEP = 32


def fold(s: str) -> str:
    """Lower case, no accents, look-alike digits inside words as letters, camel case and punctuation as breaks; dots stay."""
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("ł", "l")
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s)
    s = s.replace("&", " & ").lower()
    s = re.sub(r"[a-z0-9]+", lambda m: m[0].translate(OCR) if re.search(r"[a-z]", m[0]) and re.search(r"[0-9]", m[0]) else m[0], s)
    return re.sub(r"\s+", " ", s).strip()


def sound(t: str) -> str:
    """Spellings that sound alike become one: ph f, oo u, c k, w v, y i, z s; doubled letters single."""
    t = t.replace("ph", "f").replace("oo", "u").replace("ck", "k").replace("c", "k").replace("w", "v").replace("y", "i").replace("q", "k").replace("z", "s")
    return re.sub(r"(.)\1+", r"\1", t)


def is_filler(s: str | None) -> bool:
    if s is None:
        return True
    t = re.sub(r"[^\w]+", " ", fold(s)).strip()
    return not t or t in FILLERS


def words(s: str) -> list[tuple[str, bool]]:
    """(word, abbreviated): the words of a folded name. A dot right after marks an abbreviation; quotes and 's vanish."""
    return [(w.replace("'", "").replace("’", ""), bool(d)) for w, d in re.findall(r"([\w'’]+)(\.?)", s.replace("_", " "))]


@lru_cache(200_000)
def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein (adjacent swaps) within a band of `most`; most + 1 if larger."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if a == b:
        return 0
    if not n or not m:
        return n + m
    big = most + 1
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        new = [big] * (m + 1)
        new[0] = i
        best = big
        for j in range(lo, hi + 1):
            c = a[i - 1] != b[j - 1]
            d = min(row[j - 1] + c, row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and c and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            new[j] = d
            if d < best:
                best = d
        if best > most:
            return big
        before, row = row, new
    return min(row[m], big)


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """edits(x, y, k) <= k for each pair with its k of 0 to 3, the short ones in step: a column for each pair, a row for each
    diagonal of the band."""
    n, m = np.array([len(x) for x in a], int), np.array([len(x) for x in b], int)
    out = np.zeros(len(a), bool)
    near = np.abs(n - m) <= most
    for i in np.flatnonzero(near & (np.maximum(n, m) > IN_STEP)):
        out[i] = edits(a[i], b[i], int(most[i])) <= most[i]
    at = np.flatnonzero(near & (np.maximum(n, m) <= IN_STEP))
    if not len(at):
        return out
    n, m = n[at], m[at]
    rows, cols = max(1, n.max()), max(1, m.max())
    codes = lambda s, w: np.ascontiguousarray(np.array([s[i] for i in at], f"U{w}").view(np.uint32).reshape(len(at), w).T)
    x, y = codes(a, rows), codes(b, cols)
    big, end = np.full(len(at), 9, np.int8), np.full(len(at), 9, np.int8)
    row = {d: np.full(len(at), d, np.int8) if d >= 0 else big for d in range(-3, 4)}
    before, was = {}, {}
    for i in range(rows + 1):
        if i:
            new, differ = {-4: big}, {}
            for d in range(-3, 4):
                j = i + d
                if j < 1 or j > cols:
                    new[d] = np.full(len(at), i, np.int8) if not j else big
                    continue
                differ[d] = x[i - 1] != y[j - 1]
                v = np.minimum(row[d] + differ[d], np.minimum(row.get(d + 1, big), new[d - 1]) + np.int8(1))
                if d - 1 in differ and d + 1 in was:
                    v = np.where(differ[d - 1] | was[d + 1], v, np.minimum(v, before[d] + np.int8(1)))
                new[d] = v
            before, row, was = row, new, differ
        for d in range(-3, 4):
            done = (n == i) & (m == i + d)
            if done.any():
                end[done] = row[d][done]
    out[at] = end <= most[at]
    return out


def near_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Of each pair of words, are spellings or sounds within the edits that the shorter word may take?"""
    k = np.array([slack(min(len(x), len(y))) for x, y in zip(a, b)], int)
    heard = {w: sound(w) for w in {*a, *b}}
    out = within(a, b, k)
    rest = np.flatnonzero(~out & (k > 0))
    out[rest] = within([heard[a[i]] for i in rest], [heard[b[i]] for i in rest], k[rest])
    return out


def slack(n: int) -> int:
    """Edits that a word of n letters may take and still be the word."""
    return 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 8 else 3


def diminutive(short: str, full: str) -> bool:
    """May `short` be `full` cut off, perhaps with an ending: Herb, Ernie, Penny, Dave, Vicky of Herbert, Ernest, Penelope, ..."""
    return any(full.startswith(x) and len(full) >= len(x) + 2 for x in stems(short))


def stems(w: str) -> set[str]:
    """The beginnings of full names, of three letters or more, that a short form may come from."""
    out = {w}
    for end in ("ie", "ey", "y", "e", "i"):
        if w.endswith(end):
            out.add(w[: -len(end)])
    out |= {x[:-1] for x in out if len(x) > 3 and x[-1] == x[-2]} | {x[:-1] for x in out if x.endswith("ck")}
    return {x for x in out if len(x) >= 3}


NONE, WEAK, STRONG = 0, 1, 2


@lru_cache(400_000)
def same_word(a: str, a_dot: bool, b: str, b_dot: bool, given: bool = False, close: bool | None = None) -> int:
    """STRONG: the same word, spelled or typed otherwise; WEAK: one shortens the other. close: if the letters tell is known."""
    if a == b:
        return STRONG if len(a) > 1 else WEAK
    x, y = SHORT.get(a, a), SHORT.get(b, b)
    if x == y:
        return STRONG
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if long == short + "s" and len(short) > 2:
        return STRONG
    dot = a_dot if short is a else b_dot
    if len(short) == 1:
        return WEAK if long.startswith(short) else NONE
    if dot and len(long) > len(short) and (long.startswith(short) or edits(long[: len(short)], short, 1) <= (len(short) > 3)):
        return WEAK
    if given:
        fa, fb = FORMAL.get(a, frozenset()), FORMAL.get(b, frozenset())
        if b in fa or a in fb:
            return STRONG if len(fa | fb) == 1 else WEAK
    k = slack(min(len(a), len(b)))
    if close is None:
        close = k and min(edits(a, b, k), edits(sound(a), sound(b), k)) <= k
    if close:
        return STRONG
    return WEAK if given and diminutive(short, long) else NONE


@lru_cache(100_000)
def venue_type(w: str, dot: bool = False) -> str | None:
    """The kind-of-venue word that `w` stands for."""
    if w in SHORT and SHORT[w] in VENUE_TYPES:
        return SHORT[w]
    if w in VENUE_TYPES:
        return SHORT.get(w, w)
    if len(w) >= 3 and dot:
        for t in VENUE_TYPES:
            if t.startswith(w):
                return SHORT.get(t, t)
    if len(w) >= 5:
        best = None
        for t in VENUE_TYPES:
            if len(t) >= 5:
                k = min(slack(max(len(w), len(t))), 2)
                d = edits(w, t, k)
                if d <= k and (best is None or d < best[0]):
                    best = (d, t)
        if best:
            return SHORT.get(best[1], best[1])
    elif len(w) == 4 or len(w) == 3:
        for t in ("hall", "club", "saal", "room", "park", "house", "music", "opera", "arena"):
            if edits(w, t, 1) <= 1:
                return t
    return None


def split_type(w: str) -> list[tuple[str, bool]] | None:
    """A venue typed as one word, cut before its kind: `rodruwegrastheatre`."""
    for tail in sorted(VENUE_TYPES, key=len, reverse=True):
        if len(tail) >= 4 and w.endswith(tail) and len(w) - len(tail) >= 4:
            head = w[: -len(tail)]
            more = split_type(head)
            return (more or [(head, False)]) + [(tail, False)]
        if len(tail) >= 4 and w.startswith(tail) and len(w) - len(tail) >= 5 and tail in ("teatro", "theatro", "saal"):
            return [(tail, False), (w[len(tail) :], False)]
    return None


def letters(w: str) -> int:
    """Bits for the letters that stand in `w` once, and twice: k edits, swaps too, take away at most k of them."""
    out = 0
    for c in w:
        bit = 1 << ord(c) % 31
        out |= bit << 31 if out & bit else bit
    return out


class Name:
    """A parsed name: content words, marks of a tribute, and the squashed whole."""

    __slots__ = ("raw", "words", "tribute", "squash", "kind", "types", "core", "rest")

    def __init__(self, raw: str, kind: str):
        self.raw, self.kind = raw, kind
        s = fold(raw)
        s = re.sub(r"[\"“”„][^\"“”„]*[\"“”„]|(?<=\s)'[^']+'(?=\s)", " ", s)  # a nickname in quotes beside the name
        if kind == "venue":
            s = self._venue(s)
        ws = [(w, d) for w, d in words(s) if w]
        self.tribute = any(w in TRIBUTE or (len(w) > 5 and edits(w, "tribute", 1) <= 1) or (d and w in ("trib", "tr")) for w, d in ws)
        if self.tribute:
            ws = [(w, d) for w, d in ws if not (w in TRIBUTE or edits(w, "tribute", 1) <= 1 or (d and w in ("trib", "tr")))]
            if ws and ws[-1][0] == "band" and len(ws) > 2:
                ws = ws[:-1]
        out = []
        for k, (w, d) in enumerate(ws):
            if (w in STOP and not d) or w == "&" or (kind == "artist" and len(w) <= 4 and k == 0 and edits(w, "the", 1) <= 1 and not d):
                continue
            if len(w) <= 4 and kind == "artist" and len(ws) >= 3 and 0 < k < len(ws) - 1 and not d and w not in FORMAL and (edits(w, "of", 1) <= 1 or edits(w, "and", 1) <= 1 or edits(w, "the", 1) <= 1):
                continue
            out.append((w, d))
        if kind == "venue" and len(out) == 1 and len(out[0][0]) >= 10:
            out = split_type(out[0][0]) or out
        self.words = tuple(out)
        self.squash = re.sub(r"[^a-z0-9]", "", s.replace("&", "and")) if kind == "artist" else "".join(w for w, _ in out)
        self.types = tuple(t for w, d in out if (t := venue_type(w, d))) if kind == "venue" else ()
        self.rest = tuple((w, d) for w, d in out if not (kind == "venue" and venue_type(w, d)))
        self.core = None

    def marks(self) -> tuple:
        """(beginning, length, letters, letters of its sound) of a long word that is no short form; None for any other word."""
        return tuple(None if d or len(w) < 4 or w in FORMAL or w in SHORT else (w[:3], len(w), letters(w), letters(sound(w))) for w, d in self.words)

    @staticmethod
    def _venue(s: str) -> str:
        """Drops what is not the venue: `@`, and a place after a comma, dash or in brackets once the venue is complete."""
        s = re.sub(r"^\s*(?:@|at |live at )\s*", "", s)
        parts = [p for p in re.split(r"\s*[,;(\[]\s*|\s+[-–—|/]\s+|\s*[)\]]\s*", s) if p.strip()]
        if len(parts) < 2:
            return s
        head = words(parts[0])
        own = [w for w, d in head if w not in STOP and not venue_type(w, d)]
        kinds = [w for w, d in head if venue_type(w, d)]
        if own and kinds:
            return parts[0]
        if not own and kinds:  # `Tavern, Stupuhadim`
            return parts[1] + " " + parts[0]
        more = [w for w, d in words(parts[1]) if venue_type(w, d)]
        return parts[0] + " " + parts[1] if more else parts[0]


def _meets(x: tuple, marks: tuple) -> bool:
    begins, n, p, q = x
    for y in marks:
        if y is None or y[0] == begins:
            return True
        k = slack(min(n, y[1]))
        if (p & ~y[2]).bit_count() <= k and (y[2] & ~p).bit_count() <= k or (q & ~y[3]).bit_count() <= k and (y[3] & ~q).bit_count() <= k:
            return True
    return False


def may_be_same(a: Name, b: Name) -> bool:
    """False only where `same_name` is NONE: some long word has no like in the other name, by its letters and its beginning."""
    if a.tribute != b.tribute:
        return False
    if a.kind == "venue" or len(a.words) < 2 or len(b.words) < 2:
        return True
    p, q = a.marks(), b.marks()
    return all(x is None or _meets(x, q) for x in p) and all(y is None or _meets(y, p) for y in q)


def same_name(a: Name, b: Name) -> int:
    """STRONG: two spellings of one name. WEAK: one shortens the other, so it may also stand for a third."""
    if a.tribute != b.tribute:
        return NONE
    if a.kind == "venue":
        return _same_venue(a, b)
    x, y = list(a.words), list(b.words)
    one = min(len(x), len(y)) == 1
    if one or not x or not y:
        k = slack(min(len(a.squash), len(b.squash)))
        if min(len(a.squash), len(b.squash)) >= 6:
            for p in {a.squash, a.squash.removeprefix("the")}:
                for q in {b.squash, b.squash.removeprefix("the")} | {"".join(w for w, _ in b.words)} if len(y) != 1 else {b.squash, b.squash.removeprefix("the")}:
                    if min(edits(p, q, k), edits(sound(p), sound(q), k)) <= min(k, 2):
                        return STRONG
        if len(x) == len(y) == 1:
            return same_word(*x[0], *y[0])
        return NONE
    # middle initials do not count
    if len(x) > 2 and len(x) > len(y):
        x = [x[0], *[w for w in x[1:-1] if len(w[0]) > 1], x[-1]]
    if len(y) > 2 and len(y) > len(x):
        y = [y[0], *[w for w in y[1:-1] if len(w[0]) > 1], y[-1]]
    if len(x) != len(y):
        return NONE
    best = NONE

    orders = [tuple(range(len(y)))] + ([p for p in itertools.permutations(range(len(y))) if p != tuple(range(len(y)))] if len(y) <= 3 else [tuple(range(1, len(y))) + (0,), (len(y) - 1,) + tuple(range(len(y) - 1))])
    for p in orders:
        got = STRONG
        for (w, d), j in zip(x, p):
            got = min(got, same_word(w, d, *y[j], True))
            if not got:
                break
        best = max(best, got)
        if best == STRONG:
            break
    if best == WEAK and not any(same_word(w, d, v, e) == STRONG and len(w) > 3 for w, d in x for v, e in y):
        return NONE  # at least one word must be whole in both
    return best


def _same_venue(a: Name, b: Name) -> int:
    if not a.rest or not b.rest:
        return NONE
    if len(a.rest) != len(b.rest) or not all(any(same_word(w, d, v, e) for v, e in b.rest) for w, d in a.rest):
        s, t = "".join(w for w, _ in a.rest), "".join(w for w, _ in b.rest)
        k = slack(min(len(s), len(t)))
        if not k or edits(sound(s), sound(t), k) > k:
            return NONE
    if not a.types or not b.types:
        return STRONG if not a.types and not b.types else WEAK
    x, y = list(a.types), list(b.types)
    if sorted(x) == sorted(y):
        return STRONG
    if len(x) == len(y) and all(any(u == v or edits(u, v, slack(len(u))) <= min(2, slack(len(u))) for v in y) for u in x):
        return STRONG
    return WEAK if set(x) < set(y) or set(y) < set(x) else NONE

"""Personal information in free text, found by weak supervision and replaced by typed placeholders.

Broad patterns propose spans of each kind. Labelers vote on each span (yes, no, abstain): formats, gazetteer, cue
words, titles, numbers of digits, words that the corpus also writes in lower case, contexts and name words learned
from the whole corpus. Expectation-maximisation over the counts of all vote patterns estimates how reliable each
labeler is, and a final span classifier (logistic regression over votes, shape and context) is trained on the
resulting probabilities and decides. Where accepted spans overlap, the kinds with firmer formats and then the longer
spans win.

The patterns run over the texts once. What the labelers see of a span (its votes but for learned ones, hashes of its
context, shape and words) is kept as a few numbers; learning and deciding are array operations on these.

What is learned from the corpus has a fixed size: hashed tables of contexts and words, counts per vote pattern. The
classifier is trained on about SAMPLE spans per kind (those with a hash under a threshold set by their number); all
else covers all spans.

Defined results: null and empty texts have no spans and stay as they are; the same value twice in a document is one
case of p10_found and is replaced at both places; spans never overlap in the redacted text; rows with equal key and
text are redacted alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

KINDS = ("email", "address", "id_number", "phone", "name")
CELLS, WORD_CELLS = 1 << 18, 1 << 20
#: Spans per kind that the classifier is trained on, about; names that a gazetteer may have to be broadcast.
SAMPLE, MAX_NAMES = 20_000, 2_000_000
VOTES = 8
#: Share of the spans that stands behind the assumption that labelers are right more often than not.
TRUST = 0.005
#: Weight of an abstention, between none and that of a vote.
ABSTAINS = 0.2

# ---- proposals. Formats and words of the languages covered -------------------------------------------

_SP = "[ \u00a0\u202f\u2009]"
_UP, _LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŸŹŻŽ", "a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųźżž"
_WORD = f"(?:[OoDd]['’])?[{_UP}](?:[{_LOW}]{{2,}}|[{_UP}]{{2,}}|[{_LOW}]+[{_UP}][{_LOW}]+)"
_PART = f"(?:(?:van der|van den|van|von|de la|de|di|del|da|du|le|VAN|VON|DE|DI)(?={_SP}){_SP}|(?:al|el|AL|EL|Al|El)-)?"
_EMAIL = re.compile(
    r"[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)*"
    r"|[\w.+%\-]+ ?[\(\[\{](?:at|AT|ät)[\)\]\}] ?[\w\-]+(?: ?[\(\[\{](?:dot|DOT|punkt|punto|point)[\)\]\}] ?[\w\-]+|\.[\w\-]+)+"
    r"|[\w.+%\-]+ (?:AT|at) [\w\-]+(?: (?:DOT|dot) [\w\-]+)+"
)
_STRICT_EMAIL = re.compile(r"[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)+")
_DISGUISED = re.compile(r"[\(\[\{](?:at|AT|ät)[\)\]\}]| AT | DOT | dot ")
_NUMBER = re.compile(r"(?<![\w.,§+(\-])[+(]{0,2}\d[\d \u00a0().\-/]{4,20}\d(?![\w\-]|[.,]\d)")
_PHONE_FORMATS = re.compile(
    r"\+\d{1,3}[ \u00a0\-]?(?:\(\d{1,4}\)[ \u00a0])?\d[\d \u00a0\-]{4,12}\d|00\d{1,3}[ \u00a0]\d{2,5}[ \u00a0]\d{3,8}(?:[ \u00a0]\d{2,4})?|\(0\d{1,4}\)[ \u00a0]\d{3,4}[ \u00a0]\d{3,4}"
    r"|0\d{2,4}[ \u00a0]\d{3,6}[ \u00a0]\d{2,4}|\d{3}[.\-]\d{4}"
)
_ID = re.compile(
    r"(?<![\w.\-])(?:[A-Z]{2}-\d{4}-\d{4}|[A-Z]{2}\d{7}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}|\d{3}-\d{2}-\d{4}|\d{3} \d{3} \d{3} \d{3}|[A-Z]{1,3}\d{5,10}[A-Z]?|\d{6,12}[A-Z]?|[A-Z]{2,4}-\d{3,5}-\d{3,5})(?![\w\-]|[.,]\d)"
)
_ID_START = re.compile(r"[A-Z\d](?<![\w.\-][A-Z\d])(?=[A-Z]{0,3}[ .\-]?\d)")
_ID_FORMATS = re.compile(r"[A-Z]{2}-\d{4}-\d{4}|[A-Z]{2}\d{7}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}|\d{3}-\d{2}-\d{4}|\d{3} \d{3} \d{3} \d{3}")
_NUM = r"\d{1,4}[a-hA-H]?(?!\w)"
# patterns begin with a set of characters, which the search skips to, and look behind it afterwards
_ADDRESS = re.compile(
    rf"\d(?<![\w.\-]\d)\d{{0,3}}[a-hA-H]?(?!\w),?{_SP}(?:(?:[{_UP}][\w’'\-]*{_SP}){{1,4}}(?i:street|road|avenue|lane|close|row|drive|court|square|terrace|crescent|way|place|hill|rd|ave|ln|dr|blvd|st)\b(?:\.(?=[.,]| [{_LOW}])|(?<=[sS][tT])\.)?"
    rf"|(?P<fr>(?i:rue|avenue|av\.|chemin|bd|boulevard|place|allée|impasse|quai|route|cours|square))(?:{_SP}(?i:de la|de l’|de l'|des|de|du|d’|d'|le|la|les)(?:(?<=[’'])|(?={_SP})))?(?:{_SP}?[{_UP}][\w’'\-]*)(?:{_SP}[{_UP}][\w’'\-]*)*)"
)
_STREETS_ES = ("calle", "c/", "avda", "avenida", "paseo", "plaza", "camino", "carrera", "ronda")
_ADDRESS_ES = re.compile(
    rf"(?<!\w)(?i:calle|c/|avda\.?|avenida|paseo|plaza|camino|carrera|ronda)(?:{_SP}(?i:de la|de los|de las|del|de|la|los|las)(?={_SP}))?(?:{_SP}[{_UP}][\w’'\-]*)+(?:,{_SP}|{_SP}n\.?º\.?{_SP}|{_SP}núm\.{_SP}|{_SP}){_NUM}(?!\w)"
)
_STREETS_DE = ("straße", "strasse", "str.", "gasse", "allee", "weg", "platz", "ufer", "damm", "ring", "steig", "hof")
_ADDRESS_DE = re.compile(rf"(?<![\w])(?:[{_UP}][\w\-]*{_SP})?[{_UP}][\w\-]*(?i:{'|'.join(map(re.escape, _STREETS_DE))})(?<!{_SP}){_SP}{_NUM}(?!\w)")
_HOUSE = re.compile(rf"{_SP}\d")
_NAME = re.compile(
    rf"(?<![\w@.\-'’])(?=(?P<a>{_WORD}(?:-{_WORD})?{_SP}(?:[{_UP}]\.{_SP}?)?{_PART}{_WORD}(?:-{_WORD})?)(?![\w@]))?(?=(?P<b>{_PART}(?P<d>{_WORD}(?:-{_WORD})?,{_SP}{_WORD}(?:-{_WORD})?(?:{_SP}[{_UP}]\.)?))(?![\w@]))?(?=(?P<c>(?:[{_UP}]\.{_SP}?){{1,2}}{_PART}{_WORD}(?:-{_WORD})?)(?![\w@]))?"
    rf"(?=[{_UP}]|(?:van|von|de|di|del|da|du|le){_SP}[{_UP}]|[ae]l-[{_UP}])"
)
#: Where a name may begin: a capital that another one or a particle follows, or a particle before a capital.
_NAME_CAPITAL = re.compile(rf"[{_UP}](?<![\w@.\-'’][{_UP}])(?=[\w'’.\-]*,?{_SP}?(?:[{_UP}]|(?:van|von|de|di|del|da|du|le){_SP}|[ae]l-))")
_NAME_PARTICLE = re.compile(rf"[vdlae](?<![\w@.\-'’][vdlae])(?:(?:an|on|e|i|el|a|u){_SP}|l-)[{_UP}]")
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "mme", "mlle", "sr", "sra", "don", "doña", "señor", "señora", "monsieur", "madame", "doktor", "professor"}
_PARTICLES = {"al", "el", "van", "von", "der", "den", "de", "la", "di", "del", "da", "du", "le"}
_PREPOSITIONS = {"von", "di", "le", "du", "da"}
_ARTICLES = {"de", "la", "le", "les", "des", "du", "d’", "d'", "l’", "l'"}


def _cue(words: str) -> re.Pattern:
    """One of the words, perhaps with an ending, and at most three short words between it and the span."""
    return re.compile(rf"(?i)(?<!\w)(?:{words})\w*(?:\W+\w{{1,3}}){{0,3}}\W*$")


#: Words that announce a kind. What announces something else (a numbered item, a page) is learned as a context.
_CUES = {
    "email": _cue("e-?mail|mail|contact|kontakt|courriel|correo|write|schreib|écri|escrib"),
    "phone": _cue("tel|tél|phone|fax|mobil|móvil|handy|cell|call|anruf|ruf|appel|llam"),
    "id_number": _cue("id|identi|ssn|social security|passport|passeport|pasaporte|ausweis|pass|dni|nif|kennnummer|personal|personnel|nummer|number|numéro|número"),
    "address": _cue("address|anschrift|adresse|dirección|live|lived|wohn|habit|vive|vivi|home|house"),
}

#: Characters around a span that labelers look at.
_REACH = 40
_STREET_WORD = re.compile(r"(?i)(?:st(?:reet|\.)?|r(?:oad|d)|ave(?:nue)?|lane|close|row|straße|str\.|gasse|allee|weg|platz)\b|rue|chemin|bd|calle|c/|avda|paseo")
_SHAPES = {c: "A" if chr(c).isupper() else "a" if chr(c).islower() else "9" for c in range(0x250) if chr(c).isalpha() and (chr(c).isupper() or chr(c).islower()) or 48 <= c < 58}
_REPEATED = re.compile(r"(.)\1+")
_MARKS = re.compile(r"[^\W\d_]+|[^\w\s]|\n")


@lru_cache(1 << 16)
def _crc(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def cell(s: str) -> int:
    return _crc(s) & (CELLS - 1)


@dataclass
class Model:
    """What labelers and classifier know of the corpus."""

    given: frozenset = frozenset()
    family: frozenset = frozenset()
    lower: np.ndarray | None = None  # per word cell: written in lower case about as often as not
    seen: np.ndarray | None = None  # per context cell: spans, and those of a firm format
    firm: np.ndarray | None = None
    words: np.ndarray | None = None  # per word cell: the vote
    reliability: dict[str, tuple[float, np.ndarray, np.ndarray]] = field(default_factory=dict)
    weights: np.ndarray | None = None


_AT_SIGNS = tuple(a + c for a in ("at", "AT", "ät") for c in ")]}")


def _disguised(text: str) -> bool:
    return " dot " in text or " DOT " in text or " AT " in text or (any(x in text for x in _AT_SIGNS) and _DISGUISED.search(text) is not None)


def _emails(text: str):
    """Matches of _EMAIL. Most texts have no sign of an address; if @ is the only one, local parts are read back from it."""
    if _disguised(text):
        yield from _EMAIL.finditer(text)
        return
    at, to = text.find("@"), 0
    while at != -1:
        b = at
        while b > to and (text[b - 1].isalnum() or text[b - 1] in "_.+%-"):
            b -= 1
        if b < at and (m := _EMAIL.match(text, b)):
            to = m.end()
            yield m
        at = text.find("@", at + 1)


def _addresses(text: str):
    yield from _ADDRESS.finditer(text)
    low = text.lower()
    if any(w in low for w in _STREETS_ES):
        yield from _ADDRESS_ES.finditer(text)
    if any(low[max(0, m.start() - 7) : m.start()].endswith(_STREETS_DE) for m in _HOUSE.finditer(low)):
        yield from _ADDRESS_DE.finditer(text)


def propose(text: str) -> list[tuple[int, int, str]]:
    out = {(m.start(), m.end(), "email") for m in _emails(text)}
    for m in _addresses(text):
        e = _address_end(text, m)
        out.add((m.start(), e, "address"))
        # the words behind a street's name may belong to the next sentence
        while "fr" in m.re.groupindex and m["fr"] and (k := max(text.rfind(sp, m.start(), e) for sp in " \u00a0")) > m.end("fr"):
            e = k
            out.add((m.start(), e, "address"))
    to = 0
    for at in (m.start() for m in _ID_START.finditer(text)):
        if at >= to and (m := _ID.match(text, at)):
            to = m.end()
            out.add((at, to, "id_number"))
    for m in _NUMBER.finditer(text):
        s = m[0]
        b = m.start() + (1 if s.startswith("(") and ")" not in s else 0)
        out.add((b, m.end(), "phone"))
        # a shorter number may end before a further group of digits
        if f := _PHONE_FORMATS.match(text, b):
            out.add((b, f.end(), "phone"))
    for at in (m.start() for p in (_NAME_CAPITAL, _NAME_PARTICLE) for m in p.finditer(text)):
        m = _NAME.match(text, at)
        if not m:
            continue
        for g in "abcd":
            # d is b without a particle, which may be a preposition
            if m[g] and (g != "d" or m.start("d") > m.start("b")):
                e = m.start(g) + len(m[g])
                if _split_name(m[g]):
                    out.add((m.start(g), e, "name"))
    return sorted(out)


def _address_end(text: str, m: re.Match) -> int:
    """A final dot of St. is the sentence's, if a sentence goes before it and ends here."""
    e = m.end()
    if text[e - 1] == "." and text[e : e + 1] not in (".", ",") and not re.match(rf"{_SP}[{_LOW}]", text[e : e + 2]):
        label = text[: m.start()].rstrip().endswith(":")
        return e if label else e - 1
    return e


@lru_cache(1 << 16)
def _split_name(s: str) -> tuple[list[str], list[str]] | None:
    """Words of the given and the family name of a proposed span; None if a title or a lone particle is in it."""
    if "," in s:
        fam, giv = s.split(",", 1)
    else:
        toks = re.split(_SP, s)
        k = next((i for i, t in enumerate(toks[1:], 1) if t.lower() in _PARTICLES), len(toks) - 1)
        if toks[0].lower() in _PARTICLES:
            return None
        giv, fam = " ".join(toks[:k]), " ".join(toks[k:])
    words = lambda x: [w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", x) if len(w) > 1 and w.lower() not in _PARTICLES]
    g, f = words(giv), words(fam)
    if not f or any(w.lower() in _TITLES for w in g + f):
        return None
    return g, f


def _near(text: str, b: int, e: int, kind: str) -> tuple[str, str]:
    """Context keys: the last two words before, the next two after, with punctuation, without numbers."""
    left, right = _MARKS.findall(text[max(0, b - _REACH) : b])[-2:], _MARKS.findall(text[e : e + _REACH])[:2]
    if left and left[-1] == "." and kind == "name" and len(left) > 1 and left[0].lower() in _TITLES:
        left = ["<title>"]
    elif left and left[-1].lower() in _TITLES:
        left = ["<title>"]
    return kind + "<" + " ".join(left), kind + ">" + " ".join(right)


@dataclass(slots=True)
class Seen:
    """What the labelers see of a span: votes that need no learning, cells of its contexts and its shape, hashes of the
    unlisted words of a name, whether its format is firm, the words of an address that begins with its number."""

    kind: int
    votes: tuple[int, ...]
    left: int
    right: int
    shape: int
    strong: bool
    words: tuple[int, ...]
    street: str = ""


@lru_cache(1 << 17)
def _of_value(val: str, kind: str, given: frozenset, family: frozenset) -> tuple[tuple[int, ...], int, bool, tuple[int, ...], str]:
    """What the value by itself shows: votes, cell of its shape, whether its format is firm, hashes of the unlisted words
    of a name, the words of an address that begins with its number."""
    v = [0] * VOTES
    words: list[str] = []
    street = ""
    if kind == "name":
        g, f = _split_name(val)
        gl, fl = [w.casefold() for w in g], [w.casefold() for w in f]
        hit_g, hit_f = sum(w in given for w in gl), sum(w in family for w in fl)
        words = [w for w in gl if w not in given] + [w for w in fl if w not in family]
        v[0] = 1 if hit_f == len(fl) and hit_g == len(gl) else -1 if not hit_f and not hit_g and any(w in family for w in gl) else 0
        v[1] = 1 if hit_g or hit_f else 0
        caps = [w for w in g + f if w.isupper()]
        v[6] = -1 if caps and len(caps) < len(g + f) or any(w.isupper() and len(w) <= 5 and w.casefold() in words for w in caps) else 0
        particle = re.search(r"(?i)(?<!\w)(van|von|de|di|del|da|du|le|al|el)[ \u00a0-]", val)
        # a listed family name behind a particle and an unlisted word is rather a place; before an inverted name, a particle
        # that is an everyday preposition or article is rather that
        v[7] = -1 if particle and (hit_f == len(fl) and not hit_g or "," in val and (hit_f or particle[1].lower() in _PREPOSITIONS)) else 0
    else:
        digits = sum(c.isdigit() for c in val)
        if kind == "email":
            v[0] = 1 if _STRICT_EMAIL.fullmatch(val) else 0
            v[1] = 1 if "@" not in val and re.search(r"(?i)\bat\b", val) and re.search(r"(?i)\bdot\b", val) else 0
            v[2] = -1 if "@" in val and "." not in val.split("@", 1)[1] else 0
        elif kind == "phone":
            v[0] = 1 if _PHONE_FORMATS.fullmatch(val) else -1
            v[1] = 1 if 7 <= digits <= 15 else -1
            v[2] = -1 if _ID_FORMATS.fullmatch(val) else 0
        elif kind == "id_number":
            v[0] = 1 if _ID_FORMATS.fullmatch(val) else -1
            v[1] = 1 if 6 <= digits <= 14 else -1
        else:
            v[0] = 1
            v[1] = 1 if digits and _STREET_WORD.search(val) else 0
            street = _street(val)
    shape = _REPEATED.sub(r"\1", val.translate(_SHAPES))[:24]
    return tuple(v), cell(f"{kind} s{shape}"), v[0] == 1, tuple(_crc(w) for w in words), street


def look(text: str, b: int, e: int, kind: str, given: frozenset, family: frozenset) -> Seen:
    v, shape, strong, words, street = _of_value(text[b:e], kind, given, family)
    left, right = _near(text, b, e, kind)
    if left.endswith("<title>") if kind == "name" else _CUES[kind].search(text[max(0, b - _REACH) : b]):
        v = (*v[:3], 1, *v[4:])
    if street and re.match(rf"{_SP}[{_UP}]", text[e : e + 2]):
        street += "\n" + re.match(r"[\w’'\-]*", text[e + 1 : e + _REACH])[0].casefold()
    return Seen(KINDS.index(kind), v, cell(left), cell(right), shape, strong, words, street)


def _street(val: str) -> str:
    """The words of an address that begins with its number, without the number."""
    m = re.match(rf"{_NUM},?{_SP}(.*)", val, re.S)
    return " ".join(re.split(_SP, m[1].casefold())) if m else ""


def _named(words: list[str]) -> list[str]:
    """The words of a street's name, without its kind and the articles behind that."""
    at = next((i for i, w in enumerate(words) if i and w not in _ARTICLES), len(words))
    return words[at:]


def street_vote(street: str, seen: np.ndarray) -> int:
    """Whether the name of a street ends where few go on and goes on as long as most do."""
    street, _, more = street.partition("\n")
    name = _named(street.split())
    if not name:
        return -1
    n = [seen[cell("street " + " ".join(name[: i + 1]))] for i in range(len(name))]
    longer = seen[cell("street " + " ".join([*name, more]))] if more else 0
    torn = any(n[i] < 0.4 * n[i - 1] for i in range(1, len(n)))
    return -1 if torn or longer >= 0.4 * max(n[-1], 1) else 1


# ---- reliabilities and classifier -----------------------------------------------------------------------------------


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior and log P(vote | truth) of each labeler for yes and no, from counts of vote patterns (two-class EM). That a
    labeler abstains says little, since gazetteers and cue lists are incomplete: it counts by ABSTAINS."""
    pats = np.array(sorted(patterns), np.int64).reshape(len(patterns), -1)
    n = np.array([patterns[tuple(p)] for p in pats.tolist()], float)
    one_hot = np.stack([pats == x for x in (-1, 0, 1)], -1).astype(float)
    score, trust = pats.sum(1), max(1.0, TRUST * n.sum())
    post = np.where(score > 0, 0.9, np.where(score < 0, 0.05, 0.3))
    for _ in range(rounds):
        w1, w0 = n * post, n * (1 - post)
        prior = (w1.sum() + 1) / (n.sum() + 2)
        # pseudo counts keep a labeler's yes on the side of truth, also where nearly all spans of a kind are true
        p1 = np.einsum("p,plv->lv", w1, one_hot) + trust * np.array([0.5, 1.0, 2.0])
        p0 = np.einsum("p,plv->lv", w0, one_hot) + trust * np.array([2.0, 1.0, 0.5])
        l1, l0 = np.log(p1 / p1.sum(1, keepdims=True)), np.log(p0 / p0.sum(1, keepdims=True))
        l1[:, 1] *= ABSTAINS
        l0[:, 1] *= ABSTAINS
        logit = np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", one_hot, l1 - l0)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return float(prior), l1, l0


def posterior_logit(v: list[int], r: tuple[float, np.ndarray, np.ndarray]) -> float:
    prior, p1, p0 = r
    i = np.asarray(v) + 1
    k = np.arange(len(v))
    return float(np.log(prior / (1 - prior)) + (p1[k, i] - p0[k, i]).sum())


def pattern_cells(kind: str, v: list[int], logit: float) -> list[int]:
    """Features that hang on the votes alone."""
    return [cell(x) for x in [f"{kind} bias", f"{kind} p{max(-6, min(6, round(logit)))}", *(f"{kind} v{i}{x}" for i, x in enumerate(v))]]


def given_odds(logit: float) -> float:
    """What the aggregated votes add to the classifier's log-odds by themselves, whatever it has seen of such spans."""
    return 0.5 * max(-6.0, min(6.0, logit))


def train(rows: list[list[int]], offset: np.ndarray, target: np.ndarray, times: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic regression on hashed features, beside given log-odds, with probabilistic labels (adaptive
    gradient steps); times: how often each row occurs."""
    out = np.zeros(CELLS)
    if not rows:
        return out
    lens = np.array([len(r) for r in rows])
    # only cells that occur can change
    used, idx = np.unique(np.concatenate([np.asarray(r) for r in rows]), return_inverse=True)
    idx, seg = idx.reshape(-1), np.repeat(np.arange(len(rows)), lens)
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-6)
    for _ in range(rounds):
        z = offset + np.bincount(seg, w[idx], len(rows))
        err = times * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        g = np.bincount(idx, err[seg], len(used)) + 1e-3 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
    out[used] = w
    return out


# ---- the corpus side ------------------------------------------------------------------------------------------------

_POWERS = 3 ** np.arange(VOTES, dtype=np.int64)


def code(votes: np.ndarray) -> np.ndarray:
    """One number for each row of votes."""
    return (votes.astype(np.int64) + 1) @ _POWERS


def decode(c: int) -> list[int]:
    return [int(c) // 3**i % 3 - 1 for i in range(VOTES)]


class _Cases:
    """Per word cell: occurrences without and with a capital letter."""

    def __init__(self):
        self.low, self.cap, self.counts = np.zeros(WORD_CELLS, np.int64), np.zeros(WORD_CELLS, np.int64), Counter()

    def add(self, texts: list[str]) -> None:
        for t in texts:
            # names in disguised addresses stand in lower case
            self.counts.update((_EMAIL.sub(" ", t) if _disguised(t) else t).split())
        if len(self.counts) > 500_000:
            self.settle()

    def settle(self) -> None:
        for w, k in self.counts.items():
            w = w.strip(".,;:!?()[]‘’“”\"'«»")
            if w.isalpha():
                at = zlib.crc32(w.casefold().encode()) & (WORD_CELLS - 1)
                (self.low if w.islower() else self.cap)[at] += k
        self.counts.clear()


def gazetteer(names: DataFrame) -> tuple[frozenset, frozenset]:
    """Given and family names of a list (name, name_type), after a check of its size."""
    if names.count() > MAX_NAMES:
        raise ValueError(f"the gazetteer has more than {MAX_NAMES} names")
    listed = [(r[0].casefold(), r[1]) for r in names.filter(F.col("name") != "").select("name", "name_type").collect()]
    return frozenset(n for n, t in listed if t == "given"), frozenset(n for n, t in listed if t == "family")


#: Stands for the kind in rows that count the words of a cell: s the cell, e those in lower case, code the others.
WORDS = -1
#: Columns of a proposed span beside its row's key and digest.
_SPAN = {"s": "int", "e": "int", "kind": "int", "val": "string", "code": "int", "lc": "int", "rc": "int", "shape": "int", "strong": "boolean", "words": "array<long>", "street": "string"}


def _proposals(known):
    def run(batches):
        given, family = known.value
        cases, kinds = _Cases(), []
        for b in batches:
            rows, at, seen, vals = [], [], [], []
            texts = b.column("text").to_pylist()
            cases.add(texts)
            for i, t in enumerate(texts):
                for s, e, k in propose(t):
                    rows.append(i)
                    at.append((s, e))
                    vals.append(t[s:e])
                    seen.append(look(t, s, e, k, given, family))
            take = pa.array(rows, pa.int64())
            i32 = lambda x: pa.array(x, pa.int32())
            codes = code(np.array([x.votes for x in seen]).reshape(len(seen), VOTES)).astype(np.int32)
            cols = [b.column("_key").take(take), b.column("_digest").take(take), i32([x for x, _ in at]), i32([x for _, x in at]), i32([x.kind for x in seen]), pa.array(vals, pa.string()), pa.array(codes)]
            cols += [i32([getattr(x, f) for x in seen]) for f in ("left", "right", "shape")]
            cols += [pa.array([x.strong for x in seen], pa.bool_()), pa.array([x.words for x in seen], pa.list_(pa.int64())), pa.array([x.street for x in seen], pa.string())]
            kinds = [c.type for c in cols]
            yield pa.RecordBatch.from_arrays(cols, ["_key", "_digest", *_SPAN])
        cases.settle()
        at = np.flatnonzero(cases.low + cases.cap)
        if len(at):
            told = {"s": at, "e": cases.low[at], "code": cases.cap[at], "kind": np.full(len(at), WORDS)}
            cols = [pa.array(told[c].astype(np.int32)) if c in told else pa.nulls(len(at), k) for c, k in zip(["_key", "_digest", *_SPAN], kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["_key", "_digest", *_SPAN])

    return run


def proposed(docs: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """The proposed spans of all texts: _key, _digest of the text, begin, end, kind and what the labelers see of them.
    The patterns run over the texts once; all that is learned and decided later needs no more than this. Rows of kind
    WORDS count words, for fit alone."""
    known = docs.sparkSession.sparkContext.broadcast(gazetteer(names))
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64("text").alias("_digest"), "text").filter(F.col("text") != "")
    return cut(rows.mapInArrow(_proposals(known), f"_key {dict(rows.dtypes)['_key']}, _digest long, " + ", ".join(f"{c} {t}" for c, t in _SPAN.items())))


@dataclass
class Spans:
    """A batch of spans as arrays."""

    kind: np.ndarray
    votes: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shape: np.ndarray
    strong: np.ndarray
    of: np.ndarray  # per unlisted word: its span and its hash
    word: np.ndarray
    street: list[str]

    @classmethod
    def of_batch(cls, b) -> "Spans":
        col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        words = b.column("words").combine_chunks() if isinstance(b.column("words"), pa.ChunkedArray) else b.column("words")
        of = np.repeat(np.arange(len(words)), np.diff(np.asarray(words.offsets)))
        votes = np.stack([col("code") // 3**i % 3 - 1 for i in range(VOTES)], 1)
        return cls(col("kind"), votes, col("lc"), col("rc"), col("shape"), col("strong").astype(bool), of, np.asarray(words.flatten()), b.column("street").to_pylist())

    @classmethod
    def of_seen(cls, seen: list[Seen]) -> "Spans":
        arr = lambda f: np.array([getattr(x, f) for x in seen])
        of = np.repeat(np.arange(len(seen)), [len(x.words) for x in seen])
        return cls(arr("kind"), arr("votes").reshape(len(seen), VOTES), arr("left"), arr("right"), arr("shape"), arr("strong").astype(bool), of, np.array([w for x in seen for w in x.words], np.int64), [x.street for x in seen])

    def learned(self, m: Model) -> np.ndarray:
        """The votes with those that are learned: lower case words, contexts, words of names, names of streets."""
        v = self.votes.copy()
        if m.lower is not None:
            v[self.of[m.lower[self.word & (WORD_CELLS - 1)]], 2] = -1
        if m.seen is not None:
            # log-odds of both sides together; a context seen fewer than 5 times says nothing
            odds = np.zeros(len(v))
            for c in (self.left, self.right):
                n, p = m.seen[c], m.firm[c]
                odds += np.where(n >= 5, np.log((p + 0.5) / (n - p + 0.5)), 0)
            v[:, 4] = np.where(odds >= 1.1, 1, np.where(odds <= -2.2, -1, 0))
            for i in np.flatnonzero(self.kind == KINDS.index("address")):
                if self.street[i]:
                    v[i, 5] = street_vote(self.street[i], m.seen)
        if m.words is not None and len(self.of):
            low = np.full(len(v), 2, np.int64)
            np.minimum.at(low, self.of, m.words[self.word & (CELLS - 1)])
            v[:, 5] = np.where(low < 2, low, v[:, 5])
        return v


def _sparse(n: np.ndarray, p: np.ndarray):
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(p[at])], ["c", "n", "p"])


def _count_pass(model):
    """Per context cell: spans and firm ones, as sparse rows of the task; also how often names of streets begin so."""

    def run(batches):
        n, p = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for b in batches:
            x = Spans.of_batch(b)
            for c in (x.left, x.right):
                n += np.bincount(c, minlength=CELLS)
                p += np.bincount(c[x.strong], minlength=CELLS)
            for street in x.street:
                if name := _named(street.partition("\n")[0].split()):
                    n[cell("street " + " ".join(name))] += 1
        yield _sparse(n, p)

    return run


def _word_pass(model):
    """Per word cell: unlisted words of name spans, and those in contexts of names."""

    def run(batches):
        n, p = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for b in batches:
            x = Spans.of_batch(b)
            v = x.learned(model.value)
            c, good = x.word & (CELLS - 1), ((v[:, 4] == 1) & (v[:, 2] == 0) & (v[:, 6] == 0))[x.of]
            n += np.bincount(c, minlength=CELLS)
            p += np.bincount(c[good], minlength=CELLS)
        yield _sparse(n, p)

    return run


def _pattern_pass(model, under: dict[int, int]):
    """Counts of vote patterns, and (n null) the spans whose hash is under that of their kind."""

    def run(batches):
        counts = np.zeros((len(KINDS), 3**VOTES), np.int64)
        for b in batches:
            x = Spans.of_batch(b)
            c = code(x.learned(model.value))
            np.add.at(counts, (x.kind, c), 1)
            pick = np.flatnonzero(b.column("hash").to_numpy() < np.array([under.get(k, 0) for k in range(len(KINDS))], np.int64)[x.kind])
            none = pa.nulls(len(pick), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x.kind[pick].astype(np.int32)), pa.array(c[pick].astype(np.int32)), none, *(pa.array(f[pick].astype(np.int32)) for f in (x.shape, x.left, x.right))], _PATTERN_COLUMNS)
        k, c = np.nonzero(counts)
        none = pa.nulls(len(k), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(counts[k, c]), none, none, none], _PATTERN_COLUMNS)

    return run


_PATTERN_COLUMNS = ["kind", "code", "n", "shape", "lc", "rc"]


def fit(proposals: DataFrame, names: DataFrame) -> Model:
    """proposals: those of proposed(); names: name, name_type (given, family). Three passes over the spans, each
    aggregated in its tasks."""
    sc = proposals.sparkSession.sparkContext
    spans_of = proposals.filter(F.col("kind") != WORDS)
    m = Model(*gazetteer(names))
    # only cells of words that some text also begins with a capital letter
    low = (
        proposals.filter(F.col("kind") == WORDS)
        .groupBy(F.col("s").alias("c"))
        .agg(F.sum("e").alias("low"), F.sum("code").alias("cap"))
        .filter((F.col("cap") > 0) & (F.col("low") > 0.5 * F.col("cap")))
        .select("c")
        .toArrow()
    )
    m.lower = np.zeros(WORD_CELLS, bool)
    m.lower[low["c"].to_numpy()] = True

    def table(run, base):
        rows = spans_of.mapInArrow(run(sc.broadcast(base)), "c int, n long, p long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).toArrow()
        n, p = np.zeros(CELLS, np.float32), np.zeros(CELLS, np.float32)
        n[rows["c"].to_numpy()], p[rows["c"].to_numpy()] = rows["n"].to_numpy(), rows["p"].to_numpy()
        return n, p

    m.seen, m.firm = table(_count_pass, m)
    n, p = table(_word_pass, m)
    m.words = np.where((p >= 2) & (p >= 0.4 * n), 1, np.where((n >= 20) & (p < 0.05 * n), -1, 0)).astype(np.int8)
    sizes = {r["kind"]: r["n"] for r in spans_of.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    under = {k: min(2**31, 2**31 * SAMPLE // n) for k, n in sizes.items()}
    hashed = spans_of.withColumn("hash", F.pmod(F.xxhash64("_digest", "s", "e", "kind"), F.lit(2**31)))
    found = cut(hashed.mapInArrow(_pattern_pass(sc.broadcast(m), under), "kind int, code int, n long, shape int, lc int, rc int"))
    patterns = found.filter("n is not null").groupBy("kind", "code").agg(F.sum("n").alias("n")).collect()
    for k, name in enumerate(KINDS):
        own = {tuple(decode(r["code"])): r["n"] for r in patterns if r["kind"] == k}
        if own:
            m.reliability[name] = estimate(own)
    rows, offset, target, times = [], [], [], []
    # no more than SAMPLE and kinds say; equal ones together
    same = ["kind", "code", "shape", "lc", "rc"]
    for r in found.filter("n is null").groupBy(*same).agg(F.count("*").alias("times")).orderBy(*same).collect():
        kind, v = KINDS[r["kind"]], decode(r["code"])
        z = posterior_logit(v, m.reliability[kind])
        rows.append([*pattern_cells(kind, v, z), r["shape"], r["lc"], r["rc"]])
        times.append(r["times"])
        offset.append(given_odds(z))
        target.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    m.weights = train(rows, np.array(offset), np.array(target), np.array(times)).astype(np.float32)
    return m


def scores(x: Spans, v: np.ndarray, m: Model) -> np.ndarray:
    """The classifier's log-odds of each span; of kinds without model, minus infinity."""
    out = m.weights[x.shape] + m.weights[x.left] + m.weights[x.right]
    pats, back = np.unique(np.stack([x.kind.astype(np.int64), code(v)], 1), axis=0, return_inverse=True)
    part = np.full(len(pats), -np.inf)
    for i, (k, c) in enumerate(pats.tolist()):
        if KINDS[k] in m.reliability:
            vs = decode(c)
            z = posterior_logit(vs, m.reliability[KINDS[k]])
            part[i] = given_odds(z) + m.weights[pattern_cells(KINDS[k], vs, z)].sum()
    return out + part[back.reshape(-1)]


def choose(row: np.ndarray, s: np.ndarray, e: np.ndarray, x: Spans, m: Model) -> list[int]:
    """Accepted spans (their places in the arrays), without overlap within a row, in order; row: that of each span."""
    if not len(row):
        return []
    v = x.learned(m)
    z = scores(x, v, m)
    yes = np.flatnonzero(z > 0)
    # firmer kinds, then spans that fewer labelers reject, then longer ones
    order = np.where((v[:, 0] == 1) | (x.kind == KINDS.index("name")), x.kind, len(KINDS))
    against = (v == -1).sum(1)
    yes = yes[np.lexsort((x.kind[yes], e[yes], s[yes], -z[yes], (s - e)[yes], against[yes], order[yes], row[yes]))]
    out, last, taken = [], None, []
    for i in yes.tolist():
        if row[i] != last:
            last, taken = row[i], []
        if all(e[i] <= s2 or s[i] >= e2 for s2, e2 in taken):
            taken.append((s[i], e[i]))
            out.append(i)
    return sorted(out, key=lambda i: (row[i], s[i]))


def find(text: str | None, m: Model) -> list[tuple[int, int, str]]:
    """Accepted spans of a text."""
    got = propose(text) if text else []
    if not got:
        return []
    x = Spans.of_seen([look(text, s, e, k, m.given, m.family) for s, e, k in got])
    picked = choose(np.zeros(len(got), int), np.array([g[0] for g in got]), np.array([g[1] for g in got]), x, m)
    return [got[i] for i in picked]


def spans(spans_of: DataFrame, key: str, model: Model) -> DataFrame:
    """key, _digest, kind, val, begin, end of each accepted span, from the proposed ones. The spans of a row lie together, in
    one task, as proposed() gives them."""
    m = spans_of.sparkSession.sparkContext.broadcast(model)

    def settle(t: pa.Table):
        t = t.combine_chunks()
        b = t.to_batches()[0]
        row = _rows(b)
        i = pa.array(choose(row, b.column("s").to_numpy(), b.column("e").to_numpy(), Spans.of_batch(b), m.value), pa.int64())
        got = b.take(i)
        kinds = pa.array(KINDS, pa.string()).take(got.column("kind"))
        return pa.RecordBatch.from_arrays([got.column("_key"), got.column("_digest"), kinds, got.column("val"), got.column("s"), got.column("e")], ["_key", "_digest", "kind", "val", "begin", "end"])

    def run(batches):
        """The last row of a batch may go on in the next one."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            whole = t.combine_chunks().to_batches()[0]
            at = int(np.searchsorted(_rows(whole), _rows(whole)[-1]))
            held = t.slice(at)
            if at:
                yield settle(t.slice(0, at))
        if held is not None and held.num_rows:
            yield settle(held)

    kind = dict(spans_of.dtypes)["_key"]
    found = spans_of.filter(F.col("kind") != WORDS).mapInArrow(run, f"_key {kind}, _digest long, kind string, val string, begin int, end int")
    return found.withColumnRenamed("_key", key)


def _rows(b) -> np.ndarray:
    """Numbers of the rows that the spans of a batch belong to: proposals of a row are sorted, so a step back, or another
    key or text, begins another one."""
    new = np.ones(b.num_rows, bool)
    if b.num_rows > 1:
        d, s = b.column("_digest").to_numpy(), b.column("s").to_numpy()
        k = b.column("_key").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] < s[:-1]) | (k[1:] != k[:-1])
    return np.cumsum(new) - 1


def _replaced(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    out, at = [], 0
    for s, e, kind in found:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join([*out, text[at:]]) if out else text


def redact_text(text: str | None, m: Model) -> str | None:
    return _replaced(text, find(text, m))


def redacted(docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """key, text with each accepted span (found: those of spans()) replaced by the placeholder of its kind."""
    per = found.groupBy(F.col(key).alias("_key"), "_digest").agg(F.array_sort(F.collect_set(F.struct("begin", "end", "kind"))).alias("_found"))
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64("text").alias("_digest"), "text").join(per, ["_key", "_digest"], "left")

    def run(batches):
        for b in batches:
            texts = [_replaced(t, [(x["begin"], x["end"], x["kind"]) for x in f or []]) for t, f in zip(b.column("text").to_pylist(), b.column("_found").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(texts, pa.string())], ["_key", "text"])

    out = rows.select("_key", "text", "_found").mapInArrow(run, f"_key {dict(rows.dtypes)['_key']}, text string")
    return out.withColumnRenamed("_key", key)

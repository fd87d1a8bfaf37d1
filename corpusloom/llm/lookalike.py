"""Text that looks the same brought to one form.

Width variants, composed and decomposed accents, invisible characters, kinds of spaces and hyphens are folded
outright. Look-alike letters are repaired script by script: a token's dominant script is that of most of its letters
(that of the line, if the token has none of it). A token with letters of Cyrillic or Greek alone, all of whose Latin
letters look like letters of that script, is of that script; so is one wholly of look-alikes in a line of that script.
Letters of another script that look like one of the dominant script are replaced, but only in tokens of mixed script and only if the result occurs in the vocabulary of the corpus (or
results from repairs in two rows or more). The vocabulary is never collected: the candidates set bits in a bitmap of
fixed size, all tokens of the corpus are tested against it, and the few that hit are joined exactly.

Latin I in a Cyrillic word is taken for І, never for the palochka.

Defined results: null and empty texts give null and empty forms and are in no pair; equal texts are no pair; texts
that differ in case, accents or visible marks keep different forms.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Letters that look like a Latin (or IPA) letter. Fixed values.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ә": "ə", "ԛ": "q", "ӏ": "l",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԝ": "W", "Ӏ": "I", "Ԛ": "Q", "Ѵ": "V", "Ә": "Ə",
    # Greek
    "ο": "o", "ν": "v", "ε": "ɛ", "α": "ɑ", "ι": "ɩ", "υ": "ʋ", "γ": "ɣ", "ϳ": "j", "ρ": "p", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # variants within Latin and marks
    "ɡ": "g", "’": "ʼ", "꞊": "=", "ı": "i",
}
_TRANSLATE = str.maketrans(LOOKALIKES)
#: Letters that are composed of a look-alike and accents (Greek and Cyrillic blocks).
COMPOSED = frozenset(c for r in (range(0x370, 0x530), range(0x1F00, 0x2000)) for c in map(chr, r) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in LOOKALIKES)
_TEXT_LOOKALIKES = "".join([*LOOKALIKES, *sorted(COMPOSED)])
#: Script -> letters of the other scripts that look like one of it.
_OF = {k: unicodedata.name(k).split(" ", 1)[0] for k in LOOKALIKES}
BACK: dict[str, dict[str, str]] = {}
for _s in ("CYRILLIC", "GREEK"):
    _b: dict[str, str] = {}
    for _k, _v in LOOKALIKES.items():
        if _OF[_k] == _s:
            _b.setdefault(_v, _k)
    BACK[_s] = _b | {k: _b[v] for k, v in LOOKALIKES.items() if _OF[k] in ("CYRILLIC", "GREEK") and _OF[k] != _s and v in _b}
_BACK_TABLES = {s: str.maketrans(b) for s, b in BACK.items()}
#: Greek letters that phonetic (Latin) spellings hold too.
PHONETIC = "βθλφδ"
#: Letters that only Cyrillic or only Greek has.
_FOREIGN = re.compile("[" + "".join(c for c in map(chr, (*range(0x370, 0x530), *range(0x1F00, 0x2000))) if c.isalpha() and c not in LOOKALIKES and c not in COMPOSED and c not in PHONETIC) + "]")
_LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u1e00-\u1eff]")
#: Characters without any mark of their own.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]")
_WIDE = re.compile("[\u3000ﬀ-ﬆ！-￮]")
_SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_HYPHENS = re.compile("[‐‑˗﹣]")
#: Stands for an apostrophe that may be a letter while candidates are made.
_MARK = "\ue000"
_REPAIR = str.maketrans({k: v for k, v in LOOKALIKES.items() if k != "’"} | {_MARK: "ʼ"})
_SUSPECT = re.compile("[" + re.escape(_TEXT_LOOKALIKES.replace("’", _MARK)) + "]")
#: A text without such a character needs no letters replaced; one without such a one is its own form.
_ASKED = re.compile("[" + re.escape(_TEXT_LOOKALIKES.replace("’", "")) + "]|’(?=[^\\W\\d_])")
_CHANGES = re.compile("[^\\x00-\\x7e\u00a1-\u00ac\u00ae-\u02c1\u1e00-\u1eff\u2013-\u2019\u201c-\u201f\u2026\u2205]")
BITS = 1 << 23


def width_folded(s: str) -> str:
    return _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), s)


def to_latin(s: str) -> str:
    """All look-alikes as Latin letters, also those that carry accents."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(_TRANSLATE))


def plain_form(s: str) -> str:
    """Everything but look-alike letters."""
    s = width_folded(s)
    s = INVISIBLE.sub("", s)
    s = _HYPHENS.sub("-", _SPACES.sub(" ", s))
    return unicodedata.normalize("NFC", s)


def _script(ch: str) -> str:
    return unicodedata.name(ch, "").split(" ", 1)[0] if ch.isalpha() else ""


def _whole_script(token: str, line_script: str) -> str:
    """Cyrillic or Greek, if the token holds letters of that script alone (or stands in a line of it) and all its other
    letters look like letters of it."""
    letters = [ch for ch in unicodedata.normalize("NFD", token) if ch.isalpha()]
    own = {_script(m[0]) for m in _FOREIGN.finditer(token)}
    for s, back in BACK.items():
        if (s in own or (s == line_script and not own)) and all(ch in back or _script(ch) == s for ch in letters):
            return s
    return ""


def _back(token: str, script: str) -> str | None:
    """The token with all letters that look like letters of the script replaced by these."""
    token = token.replace(_MARK, "’")
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate(_BACK_TABLES[script]))
    return out if out != token else None


def candidate(token: str, line_script: str = "LATIN") -> str | None:
    """The token with its look-alikes replaced; None if nothing is to be repaired."""
    foreign = _FOREIGN.search(token)
    if foreign or line_script in BACK:
        whole = _whole_script(token, line_script)
        if whole:
            return _back(token, whole)
    if not foreign and not _SUSPECT.search(token):
        return None
    scripts: dict[str, int] = {}
    for ch in token:
        s = _script(ch)
        # a letter that looks Latin says less about the token than one that does not
        if s and not (s in ("CYRILLIC", "GREEK") and (ch in LOOKALIKES or ch in COMPOSED)):
            scripts[s] = scripts.get(s, 0) + 1
    dominant = max(scripts, key=lambda s: (scripts[s], s), default=line_script)
    if dominant in BACK and foreign:
        return _back(token, dominant)
    if dominant not in ("LATIN", "MODIFIER"):
        return None
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate(_REPAIR))
    return out if out != token else None


def _marked_apostrophes(text: str) -> str:
    """Marks each ’ that closes no ‘: it may stand for a letter."""
    if "’" not in text:
        return text
    out, opened = [], 0
    for i, ch in enumerate(text):
        if ch == "‘":
            opened += 1
        elif ch == "’":
            if not opened or text[i + 1 : i + 2].isalpha():
                ch = _MARK
            else:
                opened -= 1
        out.append(ch)
    return "".join(out)


def candidates(text: str) -> list[str]:
    """For each space-separated token its repaired form, or the token itself."""
    letters = Counter(s for c, n in Counter(text).items() if c not in LOOKALIKES and c not in COMPOSED and (s := _script(c)) for _ in range(n))
    line = max(letters, key=lambda s: (letters[s], s), default="LATIN")
    if line in BACK and not _FOREIGN.search(text):
        line = ""  # phonetic letters don't make a line Greek
    return [candidate(t, line) or t.replace(_MARK, "’") for t in _marked_apostrophes(text).split(" ")]


def asked(text: str) -> bool:
    """Whether letters may have to be replaced."""
    return _ASKED.search(text) is not None or _FOREIGN.search(text) is not None or ("’" in text and text.count("’") > text.count("‘"))


def _own_form(text: str) -> str:
    return plain_form(text) if _CHANGES.search(text) else text


def _md5(s: str) -> bytes:
    return hashlib.md5(s.encode("utf-8", "surrogatepass")).digest()


def _suspect(batches):
    """The rows in which letters may have to be replaced, with their tokens and the tokens' candidates."""
    for b in batches:
        text = b.column("text").to_pylist()
        rows = [i for i, t in enumerate(text) if asked(t)]
        norm = [plain_form(text[i]) for i in rows]
        at = pa.array(rows, pa.int64())
        words = pa.list_(pa.string())
        cols = [b.column("field").take(at), b.column("id").take(at), pa.array([_md5(text[i]) for i in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([x.split(" ") for x in norm], words), pa.array([candidates(x) for x in norm], words)], ["field", "id", "raw", "tok", "cand"])


def _settled(batches):
    """Digests of form and text of all other rows."""
    for b in batches:
        text = b.column("text").to_pylist()
        rows = [i for i, t in enumerate(text) if not asked(t)]
        raw, form = [], []
        for i in rows:
            t = text[i]
            raw.append(_md5(t))
            f = _own_form(t)
            form.append(raw[-1] if f is t or f == t else _md5(f))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("field").take(at), b.column("id").take(at), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], ["field", "id", "form", "raw"])


def _settled_text(batches):
    for b in batches:
        text = b.column("text").to_pylist()
        rows = [i for i, t in enumerate(text) if not asked(t)]
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("field").take(at), b.column("id").take(at), pa.array([_own_form(text[i]) for i in rows], pa.string())], ["field", "id", "form_text"])


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def token_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of each run of bytes other than space and zero: sums of bytes times powers, by prefix sums."""
    n = len(raw)
    gap = (raw == 32) | (raw == 0)
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return begin, end, np.zeros(0, np.uint64)
    powers = np.full(n + 1, _P, np.uint64)
    powers[0] = 1
    inverse = np.full(n + 1, _P_INVERSE, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    h = (sums[end] - sums[begin]) * inverse[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return begin, end, h ^ (h >> np.uint64(32))


def _buffer(texts: list[str]) -> np.ndarray:
    return np.frombuffer("\0".join(texts).encode("utf-8", "surrogatepass"), np.uint8)


def _marks(batches):
    """(word of the bitmap, its bits) for the candidates."""
    for b in batches:
        _, _, h = token_hashes(_buffer(b.column("cand").to_pylist()))
        at = h & np.uint64(BITS - 1)
        yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["w", "b"])


def _hits(bitmap):
    """Tokens of the texts that the bitmap holds, each once a batch; tokens that ask for repair don't count."""

    def run(batches):
        bits = bitmap.value
        for b in batches:
            found: set[str] = set()
            texts, size = [], 0
            for t in [*b.column("text").to_pylist(), None]:
                if t is not None:
                    texts.append(plain_form(t) if _CHANGES.search(t) else t)
                    size += len(t)
                if texts and (t is None or size > 1_000_000):
                    raw = _buffer(texts)
                    begin, end, h = token_hashes(raw)
                    at = h & np.uint64(BITS - 1)
                    hit = np.flatnonzero((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                    _, first = np.unique(h[hit], return_index=True)
                    found.update(raw[begin[k] : end[k]].tobytes().decode("utf-8", "surrogatepass") for k in hit[first])
                    texts, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([w for w in found if not _SUSPECT.search(w) or not _LATIN.search(w)], pa.string())], ["cand"])

    return run


def _bitmap(cands: DataFrame) -> np.ndarray:
    """Bitmap of the candidates' hashes; at most BITS / 64 rows come to the driver."""
    rows = cands.mapInArrow(_marks, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def consistent_forms(texts: DataFrame, with_text: bool = False) -> DataFrame:
    """texts: field, id, text. Gives field, id, form (digest of the consistent form) and raw (digest of the text) or,
    with_text, field, id and form_text. Rows with null or empty text are left out."""
    rows = texts.filter(F.col("text") != "").select("field", "id", "text")
    suspects = cut(rows.mapInArrow(_suspect, "field string, id long, raw binary, tok array<string>, cand array<string>"))
    pairs = suspects.select("field", "id", F.explode(F.arrays_zip("tok", "cand")).alias("e")).filter(F.col("e.tok") != F.col("e.cand"))
    found = cut(pairs.select("field", "id", F.col("e.cand").alias("cand")).distinct().groupBy("cand").agg(F.count("*").alias("n")))
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(found.select("cand")))
    known = rows.select("text").mapInArrow(_hits(bitmap), "cand string").distinct().withColumn("known", F.lit(True))
    accepted = found.join(known, "cand", "left").filter(F.col("known") | (F.col("n") > 1)).select("cand", F.lit(True).alias("ok"))
    # few rows: their tokens with the accepted repairs
    tok = suspects.select("field", "id", "raw", F.posexplode(F.arrays_zip("tok", "cand")).alias("pos", "e")).select("field", "id", "raw", "pos", F.col("e.tok").alias("tok"), F.col("e.cand").alias("c"))
    repaired = (
        tok.withColumn("cand", F.when(F.col("c") != F.col("tok"), F.col("c")))
        .join(accepted, "cand", "left")
        .groupBy("field", "id", "raw")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("ok"), F.col("cand")).otherwise(F.col("tok")).alias("t")))).alias("l"))
        .select("field", "id", F.array_join(F.transform("l", lambda e: e["t"]), " ").alias("form_text"), "raw")
    )
    if with_text:
        return rows.mapInArrow(_settled_text, "field string, id long, form_text string").unionByName(repaired.drop("raw"))
    settled = rows.mapInArrow(_settled, "field string, id long, form binary, raw binary")
    return settled.unionByName(repaired.select("field", "id", F.unhex(F.md5("form_text")).alias("form"), "raw"))


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """field, id_a, id_b (id_a < id_b): rows of one field with equal forms and different texts.

    Variants of a form are paired, not rows: a form that a third of the rows hold in one spelling is one variant. Rows
    join the variant pairs at the end.
    """
    forms = cut(consistent_forms(texts))
    variants = forms.groupBy("field", "form", "raw").agg(F.count("*").alias("n"))
    several = variants.groupBy("field", "form").agg(F.count("*").alias("v")).filter(F.col("v") > 1).select("field", "form")
    v = variants.join(several, ["field", "form"]).select("field", "form", "raw")
    vp = v.select("field", "form", F.col("raw").alias("r1")).join(v.select("field", "form", F.col("raw").alias("r2")), ["field", "form"]).filter(F.col("r1") < F.col("r2"))
    rows = forms.select("field", "id", "form", "raw")
    a = rows.select("field", "form", F.col("raw").alias("r1"), F.col("id").alias("i1"))
    b = rows.select("field", "form", F.col("raw").alias("r2"), F.col("id").alias("i2"))
    both = vp.join(a, ["field", "form", "r1"]).join(b, ["field", "form", "r2"])
    return both.select("field", F.least("i1", "i2").alias("id_a"), F.greatest("i1", "i2").alias("id_b"))

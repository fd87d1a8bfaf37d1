"""Freely written values mapped to a canonical list.

The list gives each canonical value and an alias (its meaning). A value is folded (width, look-alike letters, invisible
characters, case, outer punctuation) and resolved in this order:

1. the folded value, without separators, is a canonical name or alias, or the only one that begins so (4 letters on);
2. a multi-pattern automaton over all names and aliases finds those embedded at word limits; longest matches win
   without overlap, and decide when they cover the value but for punctuation and point to one canonical value;
3. similarity: the whole value one edit apart (names from 6 letters on), else token sets: the set of the value's words
   against that of each alias, words one edit apart counting as shared; the best canonical value wins if three quarters
   of the united words are shared.

Two canonical values that fit equally well leave a value unmatched, which is reported as the empty string. Each task
resolves a distinct value once and keeps the result (bounded cache); no shuffle is needed, so a value that a third of
the rows hold costs nothing extra. The list is broadcast after a check of its size.

Defined results: null and empty values are no values; values equal to a canonical one, character for character, are
not reported; repeated rows are reported each; an empty list leaves all values unmatched.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.lookalike import INVISIBLE, to_latin, width_folded

#: Rows and characters that a canonical list may have to be broadcast.
MAX_LIST_ROWS = 200_000
MAX_LIST_CHARS = 20_000_000
CACHE = 500_000
#: Shortest beginning that may stand for the whole, shortest word that may hold an edit, shortest name that may.
PREFIX, EDIT_WORD, EDIT_NAME = 4, 4, 6
#: Least share of its united words that a value has in common with an alias.
SIMILAR = 0.75
_SEP = re.compile(r"[\s._:\-/]+")
_OUTER = " \t\r\n\"'“”‘’[](){}<>.,;:?!-=~*_"


def fold(value: str) -> str:
    """Lower case, usual width, Latin letters for look-alikes, no invisible characters or outer punctuation."""
    s = INVISIBLE.sub("", unicodedata.normalize("NFC", width_folded(value)))
    s = to_latin(s)
    return " ".join(s.casefold().split()).strip(_OUTER)


def squash(folded: str) -> str:
    return _SEP.sub("", folded)


def within_one(a: str, b: str) -> bool:
    """One insertion, deletion, change or swap of neighbours, or none."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if len(a) == len(b):
        return x[1:] == y[1:] or (len(x) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])
    return x[1:] == y if len(a) > len(b) else x == y[1:]


class Resolver:
    """Resolves single values; entries are (canonical, alias) pairs."""

    def __init__(self, entries: list[tuple[str, str | None]]):
        import ahocorasick

        self.canonical = {c for c, _ in entries}
        # what a spelling stands for: canonical names win over aliases, and several values of one rank are kept apart
        self.names: dict[str, tuple[bool, set[str]]] = {}
        self.forms: list[tuple[str, frozenset[str], str, bool]] = []
        embedded: dict[str, tuple[bool, set[str]]] = {}
        for column, is_alias in ((0, False), (1, True)):
            for e in entries:
                f = fold(e[column]) if e[column] else ""
                if not f:
                    continue
                for known, spelling in ((self.names, squash(f)), (embedded, f)):
                    rank, values = known.setdefault(spelling, (is_alias, set()))
                    if rank == is_alias:
                        values.add(e[0])
                self.forms.append((f, frozenset(f.replace("_", " ").split()), e[0], is_alias))
        auto = ahocorasick.Automaton()
        for f, (_, values) in embedded.items():
            auto.add_word(f, (len(f), frozenset(values)))
        self.begins: dict[str, set[str]] = {}
        for f, _, c, is_alias in self.forms:
            if is_alias:
                k = squash(f)
                for n in range(PREFIX, len(k)):
                    self.begins.setdefault(k[:n], set()).add(c)
        self.deletes: dict[str, set[int]] = {}
        for i, (f, _, _, is_alias) in enumerate(self.forms):
            k = squash(f)
            if is_alias or len(k) >= EDIT_NAME:
                for v in self._deletes(k):
                    self.deletes.setdefault(v, set()).add(i)
        self.word_index: dict[str, set[int]] = {}
        for i, (_, ws, _, is_alias) in enumerate(self.forms):
            if is_alias:
                for w in ws:
                    for v in self._deletes(w) if len(w) >= EDIT_WORD else {w}:
                        self.word_index.setdefault(v, set()).add(i)
        if len(auto):
            auto.make_automaton()
        self.auto = auto

    @staticmethod
    def _deletes(w: str) -> set[str]:
        return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}

    def resolve(self, value: str) -> str:
        f = fold(value)
        if not f:
            return ""
        k = squash(f)
        if k in self.names:
            values = self.names[k][1]
            return next(iter(values)) if len(values) == 1 else ""
        if (b := self.begins.get(k)) and len(b) == 1:
            return next(iter(b))
        return self._embedded(f) or self._similar(f, k)

    def _embedded(self, f: str) -> str:
        """The canonical value of the longest non-overlapping mentions, if they cover the value and agree."""
        if not len(self.auto):
            return ""
        spans: list[tuple[int, int, int, frozenset]] = []
        for end, (n, c) in self.auto.iter(f):
            s = end - n + 1
            if (s == 0 or not f[s - 1].isalnum()) and (end + 1 == len(f) or not f[end + 1].isalnum()):
                spans.append((-n, s, end + 1, c))
        taken: list[tuple[int, int]] = []
        found: set[str] = set()
        for _, s, e, c in sorted(spans, key=lambda x: x[:3]):
            if all(e <= s2 or s >= e2 for s2, e2 in taken):
                taken.append((s, e))
                found |= c
        rest = "".join(ch for i, ch in enumerate(f) if not any(s <= i < e for s, e in taken))
        return found.pop() if len(found) == 1 and not any(ch.isalnum() for ch in rest) else ""

    def _similar(self, f: str, k: str) -> str:
        whole = {self.forms[i][2] for v in self._deletes(k) for i in self.deletes.get(v, ()) if within_one(k, squash(self.forms[i][0]))} if len(k) >= EDIT_WORD else set()
        if len(whole) == 1:
            return whole.pop()
        ws = frozenset(_SEP.sub(" ", f).split())
        near = {i for w in ws for v in (self._deletes(w) if len(w) >= EDIT_WORD else {w}) for i in self.word_index.get(v, ())}
        best: dict[str, tuple[float, int]] = {}
        for i in near:
            _, cs, c, _ = self.forms[i]
            got = self._likeness(ws, cs)
            if got and got < best.get(c, (0.0, 0)):
                best[c] = got
        low = [c for c, x in best.items() if x == min(best.values())]
        return low[0] if len(low) == 1 else ""

    @staticmethod
    def _likeness(ws: frozenset[str], cs: frozenset[str]) -> tuple[float, int] | None:
        """(minus the similarity of two sets of words, edits), words one edit apart counting as shared; None if fewer
        than two are shared, all of those are edited, or the similarity is under SIMILAR."""
        shared = ws & cs
        left, edits = set(cs - shared), 0
        for w in sorted(ws - shared):
            m = next((x for x in sorted(left) if min(len(w), len(x)) >= EDIT_WORD - 1 and max(len(w), len(x)) >= EDIT_WORD and within_one(w, x)), None)
            if m is not None:
                left.remove(m)
                edits += 1
        n = len(shared) + edits
        if n < 2 or edits > max(1, n - 1):
            return None
        similarity = n / (len(ws) + len(cs) - n)
        return (-similarity, edits) if similarity >= SIMILAR else None


def canonical_list(df: DataFrame, canonical: str, alias: str) -> list[tuple[str, str | None]]:
    """The list as Python values, after a check of its size."""
    n, chars = df.agg(F.count("*"), F.sum(F.length(canonical) + F.coalesce(F.length(alias), F.lit(0)))).first()
    if n > MAX_LIST_ROWS or (chars or 0) > MAX_LIST_CHARS:
        raise ValueError(f"the canonical list has {n} rows and {chars} characters; the bounds are {MAX_LIST_ROWS} and {MAX_LIST_CHARS}")
    return [(r[0], r[1]) for r in df.select(canonical, alias).filter(F.col(canonical) != "").orderBy(canonical, alias).collect()]


def map_to_list(values: DataFrame, entries: list[tuple[str, str | None]], value: str = "value") -> DataFrame:
    """The rows whose value is not written as in the list, with column canonical; the value column is dropped."""
    known = values.sparkSession.sparkContext.broadcast(entries)
    names = values.sparkSession.createDataFrame(sorted({(c,) for c, _ in entries}), "_name string")
    keys = [c for c in values.columns if c != value]
    irregular = values.filter(F.col(value) != "").join(F.broadcast(names), F.col(value) == F.col("_name"), "left_anti")

    def run(batches):
        r = Resolver(known.value)
        cache: dict[str, str] = {}
        for batch in batches:
            col = batch.column(value).dictionary_encode()
            out = []
            for v in col.dictionary.to_pylist():
                c = cache.get(v)
                if c is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    c = cache[v] = v if v in r.canonical else r.resolve(v)
                out.append(c)
            mapped = pa.array(out, pa.string()).take(col.indices)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column(value), mapped], [*keys, value, "canonical"])

    schema = ", ".join(f"`{n}` {t}" for n, t in irregular.select(*keys, value).dtypes)
    mapped = irregular.select(*keys, value).mapInArrow(run, schema + ", canonical string")
    return mapped.filter((F.col(value) != F.col("canonical"))).drop(value)

"""Several values packed in one field, split into one value per row.

A field is read into atoms and runs of separators. Quoted spans are atoms that nothing divides; whether a run between
two other atoms divides or belongs to a value is decided by a unigram model of values: expectation-maximisation over
the whole column learns how frequent values are and how often each kind of run divides, and Viterbi over the lattice
of all readings takes the likeliest. Value frequencies are kept in a count-min sketch of fixed size, so the model that
is broadcast doesn't grow with the data.

A value may hold any number of separators; readings are left out only if their share would be under a millionth.

Defined results: null and empty fields give no rows; empty values are dropped and take no position; a quote that opens
at the start of a value but never closes before a separator is an ordinary character; nested lists are read as one;
an unquoted null in a list is empty; repeated rows give their values under their own key; a column without any
separator gives each field as one value.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that may separate (a full stop never does), and pairs of quotes.
SEPARATORS = frozenset(" \t\r\n\x0b\x0c\u00a0\u2002\u2003\u2009\u202f\u3000;,|/、；，｜-=~+–—‐‑")
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "”", "‘": "’", "«": "»", "「": "」"}
#: Rows and cells per row of the sketch.
DEPTH, CELLS = 3, 1 << 19
#: Rounds of EM; share below which a reading counts for nothing, and the cost that this is.
ROUNDS, LEAST = 3, 1e-6
_FAR = -math.log(LEAST)
#: Costs of values that a task remembers.
REMEMBERED = 200_000
#: Marks, among the kinds of runs, the number of runs in a joined value.
_LONGEST = "\0"
_SPACE = frozenset(" \t\r\n\x0b\x0c\u00a0\u2002\u2003\u2009\u202f\u3000")


def _closing(text: str, i: int, stops: frozenset) -> tuple[int, str] | None:
    """End and content of the quoted span that opens at i; None if it doesn't close before a separator."""
    opening, closing = text[i], QUOTES[text[i]]
    out, j, depth, n = [], i + 1, 0, len(text)
    while j < n:
        ch = text[j]
        if ch == "\\" and j + 1 < n and text[j + 1] in (opening, closing, "\\"):
            out.append(text[j + 1])
            j += 2
            continue
        if ch == closing:
            if opening == closing and text[j + 1 : j + 2] == closing:
                out.append(closing)
                j += 2
                continue
            if depth == 0 and (j + 1 == n or text[j + 1] in stops):
                return j + 1, "".join(out)
            depth -= depth > 0
        elif ch == opening != closing:
            depth += 1
        out.append(ch)
        j += 1
    return None


_CLASS = re.escape("".join(sorted(SEPARATORS)))
_ATOM = re.compile(f"([^{_CLASS}]+)([{_CLASS}]*)")
_OPENS = re.compile("[\\[" + "".join(QUOTES) + "]")


def read(text: str) -> list[tuple[str, bool, str]]:
    """Atoms of a field: (text, quoted, the run of separators behind it)."""
    if not _OPENS.search(text):
        return [(a, False, run) for a, run in _ATOM.findall(text)]
    stops, body = SEPARATORS, text
    if text.lstrip()[:1] == "[":
        stops = SEPARATORS | frozenset("[]")
    atoms: list[tuple[str, bool, str]] = []
    i, n = 0, len(body)
    while i < n and body[i] in stops:
        i += 1
    while i < n:
        quoted = body[i] in QUOTES and _closing(body, i, stops)
        if quoted:
            j, value = quoted
        else:
            j = i
            while j < n and body[j] not in stops:
                j += 1
            value = body[i:j]
            if stops is not SEPARATORS and value in ("null", "None"):
                value = ""
        k = j
        while k < n and body[k] in stops:
            k += 1
        atoms.append((value, bool(quoted), body[j:k]))
        i = k
    return atoms


@lru_cache(1 << 12)
def run_kind(run: str) -> str:
    """Kind of a run of separators: its first character that is no space, else its space, else two."""
    visible = [c for c in run if c not in _SPACE]
    return visible[0] if visible else run if len(run) == 1 else "  "


@lru_cache(1 << 16)
def cells(value: str) -> tuple[int, ...]:
    """The value's cell in each row of the sketch."""
    raw = value.encode("utf-8", "surrogatepass")
    a, b = zlib.crc32(raw), zlib.adler32(raw, len(raw)) * 0x9E3779B1
    return tuple(i * CELLS + ((a + i * (b >> 7) + i * (a >> 16)) & (CELLS - 1)) for i in range(DEPTH))


@dataclass
class SplitModel:
    """Value frequencies by cell, their total, chance that a run of a kind divides, cost of an unseen character, runs in
    the longest joined value that was expected."""

    counts: np.ndarray = field(default_factory=lambda: np.zeros(DEPTH * CELLS, np.float32))
    total: float = 0.0
    divides: dict[str, float] = field(default_factory=dict)
    letters: float = math.log(30)
    end: float = math.log(6)
    longest: int = 0

    _costs: dict[str, float] = field(default_factory=dict, repr=False)
    _runs: dict[str, tuple[float, float]] = field(default_factory=dict, repr=False)

    def cost(self, value: str) -> float:
        """Description length: letter by letter for unseen values; for others that of their frequency, and their
        share of the letters that the list of values needs (else each field would explain itself as one value)."""
        letters = self.letters * len(value) + self.end
        # the first row of the sketch tells most unseen values
        if not self.total or self.counts.item(zlib.crc32(value.encode("utf-8", "surrogatepass")) & (CELLS - 1)) < 1.5:
            return letters
        got = self._costs.get(value)
        if got is None:
            seen = min(self.counts.item(c) for c in cells(value))
            got = letters if seen < 1.5 else min(letters, math.log(self.total / seen) + letters / seen)
            if len(self._costs) >= REMEMBERED:
                self._costs.clear()
            self._costs[value] = got
        return got

    def runs(self, run: str) -> tuple[float, float]:
        """Costs of dividing and of belonging to the value."""
        got = self._runs.get(run)
        if got is None:
            p = self.divides.get(run_kind(run), 0.95)
            got = -math.log(p), -math.log(1 - p)
            if len(self._runs) < REMEMBERED:
                self._runs[run] = got
        return got


def _stretches(atoms: list[tuple[str, bool, str]]):
    """Quoted atoms by themselves, runs of unquoted ones together."""
    at = 0
    while at < len(atoms):
        end = at + 1
        if not atoms[at][1]:
            while end < len(atoms) and not atoms[end][1]:
                end += 1
        yield atoms[at:end]
        at = end


def _arcs(atoms, m: SplitModel):
    """Arcs (i, j, value, cost) of the lattice of a stretch. An unseen value of several atoms costs at least the sum of
    its gaps more than its atoms by themselves; it is left out, and all longer ones, when that makes its share less
    than LEAST. No value with more runs than the longest one is a seen one."""
    n = len(atoms)
    costs = [m.runs(a[2]) if i + 1 < n else (0.0, 0.0) for i, a in enumerate(atoms)]
    gaps = [m.letters * len(a[2]) + keep - m.end - cut for a, (cut, keep) in zip(atoms[:-1], costs)]
    # what longer values may win back
    back = [0.0] * n
    for i in range(n - 2, -1, -1):
        back[i] = back[i + 1] + min(0.0, gaps[i])
    out, known = [], m._costs.get
    for i in range(n):
        value, kept, more, j = atoms[i][0], 0.0, 0.0, i
        while True:
            c = known(value)
            out.append((i, j + 1, value, (m.cost(value) if c is None else c) + kept + costs[j][0]))
            if j + 1 == n:
                break
            more += gaps[j]
            j += 1
            if j - i > m.longest and more + back[j] > _FAR:
                break
            value += atoms[j - 1][2] + atoms[j][0]
            kept += costs[j - 1][1]
    return out


def segment(text: str | None, m: SplitModel) -> list[str]:
    """The values of a field, by the likeliest reading."""
    out: list[str] = []
    for part in _stretches(read(text or "")):
        if len(part) == 1:
            out.append(part[0][0])
            continue
        n = len(part)
        best, back = [0.0] + [math.inf] * n, [None] * (n + 1)
        for i, j, value, c in _arcs(part, m):
            if best[i] + c < best[j]:
                best[j], back[j] = best[i] + c, (i, value)
        path, at = [], n
        while at:
            at, value = back[at]
            path.append(value)
        out += reversed(path)
    return [v for v in out if v]


def expected(text: str, m: SplitModel, values: dict[str, float], runs: dict[str, list[float]]) -> None:
    """Adds the field's expected counts of values and of dividing and other runs (forward-backward)."""
    for part in _stretches(read(text)):
        if len(part) == 1:
            v, quoted, _ = part[0]
            # a value that stands quoted because it holds a separator says nothing about unquoted text
            if not quoted or not any(c in SEPARATORS for c in v):
                values[v] = values.get(v, 0.0) + 1.0
            continue
        arcs, n = _arcs(part, m), len(part)
        if len(arcs) == n:
            # one reading
            for _, _, v, _ in arcs:
                values[v] = values.get(v, 0.0) + 1.0
            for a in part[:-1]:
                runs.setdefault(run_kind(a[2]), [0.0, 0.0])[0] += 1.0
            runs.setdefault(f"{_LONGEST}0", [0.0, 0.0])
            continue
        # chances relative to the reading that divides everywhere, so that they stay within range
        base = [0.0, *accumulate(m.cost(a[0]) + (m.runs(a[2])[0] if k + 1 < n else 0.0) for k, a in enumerate(part))]
        chance = [math.exp(min(_FAR * 20, base[j] - base[i] - c)) for i, j, _, c in arcs]
        fwd, bwd = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for (i, j, _, _), x in zip(arcs, chance):
            fwd[j] += fwd[i] * x
        for (i, j, _, _), x in zip(reversed(arcs), reversed(chance)):
            bwd[i] += bwd[j] * x
        if not math.isfinite(fwd[n]) or not fwd[n]:
            fwd, bwd, chance = _in_logs(arcs, n)
        cuts, longest = [0.0] * (n + 1), 0
        for (i, j, v, _), x in zip(arcs, chance):
            p = min(1.0, fwd[i] * x * bwd[j] / fwd[n])
            if p > LEAST:
                values[v] = values.get(v, 0.0) + p
                cuts[j] += p
                longest = max(longest, j - i - 1)
        for j in range(1, n):
            r = runs.setdefault(run_kind(part[j - 1][2]), [0.0, 0.0])
            r[0] += min(1.0, cuts[j])
            r[1] += max(0.0, 1.0 - cuts[j])
        runs.setdefault(f"{_LONGEST}{longest}", [0.0, 0.0])


def _in_logs(arcs, n: int) -> tuple[list[float], list[float], list[float]]:
    """The sums of forward-backward in logarithms, for stretches whose chances pass the range of numbers: scaled so
    that products over an arc give its share."""
    f, b = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, _, c in arcs:
        f[j] = float(np.logaddexp(f[j], f[i] - c))
    for i, j, _, c in reversed(arcs):
        b[i] = float(np.logaddexp(b[i], b[j] - c))
    return [1.0] * (n + 1), [1.0] * (n + 1), [math.exp(min(0.0, f[i] - c + b[j] - f[n])) for i, j, _, c in arcs]


def _pour(values: dict[str, float], acc: np.ndarray) -> None:
    for v, p in values.items():
        for c in cells(v):
            acc[c] += p


_WIDTH = DEPTH * CELLS


def _expect(models):
    """Expected counts of the task's fields, one column a field: by cell (kind null), and by kind of run (cell null)."""

    def run(batches):
        ms = models.value
        acc, runs, values = [np.zeros(_WIDTH) for _ in ms], [{} for _ in ms], [{} for _ in ms]
        for b in batches:
            for f, m in enumerate(ms):
                for t in b.column(f).to_pylist():
                    if t:
                        expected(t, m, values[f], runs[f])
                if len(values[f]) > 200_000:
                    _pour(values[f], acc[f])
                    values[f] = {}
        for f in range(len(ms)):
            _pour(values[f], acc[f])
            at = np.flatnonzero(acc[f])
            kinds = list(runs[f])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at) + len(kinds), f, np.int32)),
                    pa.array([*at.tolist(), *[None] * len(kinds)], pa.int32()),
                    pa.array([*[None] * len(at), *kinds], pa.string()),
                    pa.array([*acc[f][at].tolist(), *[runs[f][k][0] for k in kinds]], pa.float64()),
                    pa.array([*[0.0] * len(at), *[runs[f][k][1] for k in kinds]], pa.float64()),
                ],
                ["field", "cell", "kind", "yes", "no"],
            )

    return run


def learn_columns(columns: DataFrame, rounds: int = ROUNDS) -> list[SplitModel]:
    """EM over columns of packed fields, a model for each; every round is one pass over all of them."""
    ms = [SplitModel() for _ in columns.columns]
    some = F.coalesce(*[F.when(F.col(c) != "", True) for c in columns.columns], F.lit(False))
    texts = columns.filter(some)
    for _ in range(rounds):
        got = texts.mapInArrow(_expect(columns.sparkSession.sparkContext.broadcast(ms)), "field int, cell int, kind string, yes double, no double")
        rows = got.groupBy("field", "cell", "kind").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toArrow()
        ms = [_maximised(rows.filter(pc.equal(rows["field"], f))) for f in range(len(ms))]
    return ms


def _maximised(rows: pa.Table) -> SplitModel:
    m = SplitModel()
    of_cells = rows.filter(pc.is_null(rows["kind"]))
    m.counts[of_cells["cell"].to_numpy()] = of_cells["yes"].to_numpy()
    for r in rows.filter(pc.is_valid(rows["kind"])).to_pylist():
        if r["kind"].startswith(_LONGEST):
            m.longest = max(m.longest, int(r["kind"][1:]))
            continue
        # pseudo counts: a separator divides unless the column says otherwise
        m.divides[r["kind"]] = (r["yes"] + 9.5) / (r["yes"] + r["no"] + 10)
    m.total = float(m.counts[:CELLS].sum())
    return m


def learn(column: DataFrame, rounds: int = ROUNDS) -> SplitModel:
    """EM over a column of packed fields (the first of column)."""
    return learn_columns(column.select(column.columns[0]), rounds)[0]


def split_packed(df: DataFrame, key: str, fields: list[str], rounds: int = ROUNDS) -> DataFrame:
    """key, field, pos, val: the values of each packed field, in order."""
    sc = df.sparkSession.sparkContext
    models = sc.broadcast(dict(zip(fields, learn_columns(df.select(*fields), rounds))))
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            rows, fld, pos, val = [], [], [], []
            for f in fields:
                m = models.value[f]
                for i, t in enumerate(b.column(f).to_pylist()):
                    vs = segment(t, m) if t else []
                    rows += [i] * len(vs)
                    fld += [f] * len(vs)
                    pos += range(len(vs))
                    val += vs
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(fld, pa.string()), pa.array(pos, pa.int64()), pa.array(val, pa.string())], [key, "field", "pos", "val"])

    return df.select(key, *fields).mapInArrow(run, f"`{key}` {kind}, field string, pos long, val string")

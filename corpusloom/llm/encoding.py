"""Token ids of a whole corpus by a public byte-level BPE, with chunks shared across documents encoded once.

Texts are cut into content-defined chunks: a rolling hash over the last bytes decides where a cut falls, so that equal
passages give equal chunks wherever they stand. A worker encodes each distinct chunk once and keeps its ids, in a
memory of bounded size that lasts from task to task; copies of a text cost a look-up for each of their chunks.

A cut may fall anywhere, also inside a word, so the ids around a join are repaired: from a place before the join where
no later text can move the pre-tokens, the two chunks are split into pre-tokens anew until a pre-token begins where one
of the right chunk by itself begins. From there on both readings agree, since the split looks only forward; the stretch
between is encoded again. A right chunk without such a place joins the left one, and the repair goes on with the next.

No text is shuffled: on texts that have few passages in common, sharing chunks between workers too would cost several
times the input in exchanges of ids and save a few percent of the encoding.

Defined results: null and empty texts have the empty list; text that looks like a special token is plain text; equal
texts have equal ids; one row per row of the input.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-token pattern that belongs to the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes in the rolling hash (a power of two), mean and least bytes of a chunk.
WINDOW, MEAN, LEAST = 16, 1024, 64
#: Characters of the chunks that a worker remembers, twice at most.
MEMORY = 16_000_000
#: Characters before and behind a join that are looked at first.
REACH, AHEAD = 96, 40
#: Pre-tokens at the end of a text that text behind it may change.
LOOSE = 2
#: Fixed value: white space of the pattern. A text cut behind it would be read otherwise at its end.
_WHITE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: A space between ASCII letters or digits begins a pre-token whatever stands around.
_SURE = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken vocabulary file, one per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def cut_points(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes, behind WINDOW bytes and before the first byte of a character, that the hash selects."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    h, k, p = data.astype(np.uint32) * np.uint32(0x9E3779B1), 1, 0x01000193
    while k < WINDOW:
        # the hash of 2k bytes from those of two runs of k
        h = h[k:] + h[:-k] * np.uint32(p)
        k, p = 2 * k, p * p & 0xFFFFFFFF
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    at = np.flatnonzero((h[:-1] >> np.uint32(11)) % np.uint32(MEAN) == 0) + WINDOW
    return at[(data[at] & 0xC0) != 0x80]


def _spaced(cuts: list[int], begin: int) -> list[int]:
    """Cuts at least LEAST bytes behind each other."""
    out = []
    for c in cuts:
        if c - begin >= LEAST:
            out.append(c)
            begin = c
    return out


def chunks(text: str) -> list[str]:
    """The content-defined chunks of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [0, *_spaced(cut_points(np.frombuffer(raw, np.uint8)).tolist(), 0), len(raw)]
    return [raw[b:e].decode("utf-8", "surrogatepass") for b, e in zip(at, at[1:])]


class ChunkEncoder:
    """Encodes texts by their chunks; remembers the ids of chunks."""

    def __init__(self, enc, memory: int = MEMORY):
        import regex

        self.ids_of, self.starts_of = enc.encode_ordinary, regex.compile(PATTERN).finditer
        self.memory, self.new, self.old, self.size = memory, {}, {}, 0
        self.encoded = self.asked = 0

    def ids(self, chunk: str) -> list[int]:
        self.asked += len(chunk)
        got = self.new.get(chunk)
        if got is None:
            got = self.old.get(chunk)
            if got is None:
                got = self.ids_of(chunk)
                self.encoded += len(chunk)
            if self.size > self.memory:
                self.new, self.old, self.size = {}, self.new, 0
            self.new[chunk] = got
            self.size += len(chunk)
        return got

    def _open(self, text: str) -> int:
        """A place of the text, itself begun by a pre-token, where a pre-token begins and before which none can be
        changed by text behind it."""
        # the pre-tokens before a sure space are as they are, and LOOSE further ones lie behind it
        sure = [m.start() for m in _SURE.finditer(text, max(0, len(text) - REACH))]
        if len(sure) > LOOSE:
            return sure[-1 - LOOSE]
        at = [m.start() for m in self.starts_of(text)]
        return next((i for i in reversed(at[:-LOOSE]) if i and text[i - 1] not in _WHITE), 0)

    def _begins(self, text: str) -> set[int]:
        """The first places of a text where pre-tokens begin, without those that text behind may change, and without
        those behind white space, where a cut would change what is before."""
        size = AHEAD
        while True:
            at = [m.start() for m in self.starts_of(text[:size])][:-LOOSE]
            if len(at) > 2 or size >= len(text):
                return {i for i in at if not i or text[i - 1] not in _WHITE}
            size *= 4

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Lists of ids that, joined, are those of the joined parts."""
        out: list[list[int]] = []
        text, ids, due = parts[0], self.ids(parts[0]), 0
        for part in parts[1:]:
            if len(text) + len(part) < due:
                text, ids = text + part, None
                continue
            at = self._open(text)
            tail = text[at:]
            begins, n = self._begins(part), len(tail)
            both = tail + part
            meet = next((m.start() for m in self.starts_of(both) if m.start() >= n and m.start() - n in begins and both[m.start() - 1] not in _WHITE), None)
            if ids is None:
                out.append(self.ids_of(text[:at]))
            elif at:
                out.append(ids[: len(ids) - len(self.ids_of(tail))])
            if meet is None:
                # a pre-token over all of the part, or nearly so: looked at again when it has grown by half
                text, ids = both, None
                due = len(both) * 3 // 2 if len(both) > 8 * MEAN else 0
                continue
            out.append(self.ids_of(both[:meet]))
            own = self.ids(part)
            text, ids, due = both[meet:], own[len(self.ids_of(part[: meet - n])) :], 0
        out.append(self.ids_of(text) if ids is None else ids)
        return out


_CHUNKED: dict[str, ChunkEncoder] = {}


def _texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data if data is not None else b"", np.uint8)


def _encoded(path: str, key: str, lengths: bool):
    def run(batches):
        if path not in _CHUNKED:
            _CHUNKED[path] = ChunkEncoder(encoder(path))
        enc = _CHUNKED[path]
        for b in batches:
            off, data = _texts(b.column("text"))
            base = int(off[0])
            data = data[base : int(off[-1])]
            off = off - base
            cuts = cut_points(data)
            row = np.searchsorted(off, cuts, "right") - 1
            cuts = cuts[cuts - off[row] >= WINDOW]
            bounds, cuts, raw = np.searchsorted(cuts, off).tolist(), cuts.tolist(), data.tobytes()
            off = off.tolist()
            sizes, ids = [], []
            for i in range(len(off) - 1):
                s, e = off[i], off[i + 1]
                if s == e:
                    sizes.append(0)
                    continue
                at = [s, *_spaced(cuts[bounds[i] : bounds[i + 1]], s), e]
                got = enc.encode([raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(at, at[1:])])
                sizes.append(sum(map(len, got)))
                if not lengths:
                    ids += got
            if lengths:
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(sizes, pa.int32())], [key, "n_tokens"])
                continue
            flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(sizes))
            ends = np.cumsum(sizes, dtype=np.int64)
            # list offsets are 32-bit; rows are given out in runs that keep to them
            first = 0
            while first < len(sizes):
                start = int(ends[first - 1]) if first else 0
                to = max(first + 1, int(np.searchsorted(ends, start + 2**27, "right")))
                part = pa.ListArray.from_arrays(pa.array(np.r_[start, ends[first:to]].astype(np.int64) - start, pa.int32()), pa.array(flat[start : int(ends[to - 1])]))
                yield pa.RecordBatch.from_arrays([b.column(key).slice(first, to - first), part], [key, "ids"])
                first = to

    return run


def _apply(df: DataFrame, key: str, text: str, path: str, out: str, lengths: bool) -> DataFrame:
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    return docs.mapInArrow(_encoded(path, "_key", lengths), f"_key {dict(docs.dtypes)['_key']}, {out}").withColumnRenamed("_key", key)


def encode(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """key, ids: one row per row of df."""
    return _apply(df, key, text, f"{tokenizers}/{name}.tiktoken", "ids array<int>", False)


def token_counts(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """key, n_tokens: only the numbers of ids are given out."""
    return _apply(df, key, text, f"{tokenizers}/{name}.tiktoken", "n_tokens int", True)


def decode(df: DataFrame, key: str, ids: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """key, text: the text that ids stand for."""
    path = f"{tokenizers}/{name}.tiktoken"

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = [enc.decode_bytes(x or []).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(texts, pa.string())], ["_key", "text"])

    rows = df.select(F.col(key).alias("_key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"_key {dict(rows.dtypes)['_key']}, text string").withColumnRenamed("_key", key)

"""Look-alike repair, splitting, encoding and packing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import encoding, lookalike, splitting
from corpusloom.llm.packing import best_fit, pack

TXT = "field string, id long, text string, form string"


def texts(spark, *rows):
    return spark.createDataFrame([("f", i, t, "x") for i, t in enumerate(rows)], TXT)


def pairs(df):
    return sorted((r["id_a"], r["id_b"]) for r in lookalike.lookalike_pairs(df).collect())


def test_lookalikes(spark):
    base = "kaŋɛ-ta miʼo"
    df = texts(
        spark, base, "kаŋε-tа miʼo", "ka\u200bŋɛ‐ta\u00a0miʼo", "ｋaŋɛ-ta miʼo", "kaŋɛ-ta mi’o", base, "káŋɛ-ta miʼo", "káŋɛ-ta miʼo", "Kaŋɛ-ta miʼo", "kaŋɛ-ta", None, "",
        "kaŋɛ–ta miʼo",
    )
    want = [(a, b) for a in range(6) for b in range(a + 1, 6) if (a, b) != (0, 5)] + [(6, 7)]
    assert pairs(df) == sorted(want)


def test_accented_lookalikes(spark):
    """ε and о with accents have composed forms of their own."""
    df = texts(spark, "k\u025b\u0301m\u00f6l", "k\u03b5\u0301m\u043e\u0308l", "k\u03adm\u04e7l", "k\u025bm\u00f6l")
    assert pairs(df) == [(0, 1), (0, 2), (1, 2)]


def test_lookalikes_keep_other_scripts(spark):
    df = texts(spark, "пример без перевода", "text with сор", "text with cop", "о", "o")
    forms = {r["id"]: r["form_text"] for r in lookalike.consistent_forms(df, with_text=True).collect()}
    assert forms[0] == "пример без перевода" and forms[1] == forms[2] == "text with cop" and forms[3] == forms[4]
    assert pairs(texts(spark)) == [] and pairs(texts(spark, None, "", " ")) == []


def test_lookalikes_in_cyrillic_and_greek(spark):
    city, greek = "Москва", "τόπος"
    disguised = [f"над Mocквa б", f"над {city[0]}o{city[2:]} б"]
    rows = [f"над {city} б", *disguised, f"near {city} now", "near Мoсквa now", greek, "τóπoς", "кво", "квo"]
    df = texts(spark, *rows)
    forms = {r["id"]: r["form_text"] for r in lookalike.consistent_forms(df, with_text=True).collect()}
    assert forms == dict(enumerate([rows[0]] * 3 + [rows[3]] * 2 + [rows[5]] * 2 + [rows[7]] * 2))
    assert pairs(df) == [(0, 1), (0, 2), (1, 2), (3, 4), (5, 6), (7, 8)]


def test_phonetic_greek_stays_latin(spark):
    rows = ["βoβ oθo", "x βoβ oθo", "βоβ oθo"]
    assert [lookalike.candidates(t)[0] for t in rows[:2]] == ["βoβ", "x"]
    assert lookalike.consistent_forms(texts(spark, *rows[:2]), with_text=True).filter("form_text not in ('βoβ oθo', 'x βoβ oθo')").count() == 0


def test_quotes_stay(spark):
    df = texts(spark, "the ‘young aunt’ said mɔ’i", "the ‘young aunt’ said mɔʼi", "the ‘yоung aunt’ said mɔʼi")
    assert pairs(df) == [(0, 1), (0, 2), (1, 2)]


def _check_pieces(text, ps, limit, overlap):
    ps = sorted(ps)
    assert ps[0][0] == 0 and ps[-1][1] == len(text)
    for (b, e), (b2, e2) in zip(ps, ps[1:]):
        assert b < b2 <= e < e2
        assert abs((e - b2) - overlap) <= overlap
    assert all(0 < e - b <= limit for b, e in ps)


def test_overlap_is_the_nearest_boundary(spark):
    """Every word break counts, also those beside a better boundary."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 8)))
    text = "".join(word() + rnd.choice([" "] * 9 + ["\n\n", ". ", ", "]) for _ in range(20_000))
    starts = [i for i in range(1, len(text)) if text[i - 1].isspace() and not text[i].isspace()]
    df = spark.createDataFrame([(0, text)], "id long, text string")
    ps = sorted((r["begin"], r["end"]) for r in splitting.split_texts(df, ["id"], "text").collect())
    _check_pieces(text, ps, 2000, 200)
    for (b, e), (b2, _) in zip(ps, ps[1:]):
        assert b2 == min((p for p in starts if b < p < e), key=lambda p: (abs(p - (e - 200)), p))


def test_split_texts(spark):
    rnd = random.Random(4)
    para = lambda: " ".join("".join(rnd.choice("abc dé.") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 200)))
    rows = {0: None, 1: "", 2: "short", 3: "x" * 2000, 4: "y" * 5001, 5: "\n\n".join(para() for _ in range(30)), 6: "  \n" * 3000, 7: "word " * 260_000, 8: "z" * 1_200_000}
    df = spark.createDataFrame([(k, v, 5) for k, v in rows.items()], "id long, text string, begin long")
    got = {}
    for r in splitting.split_texts(df, ["id"], "text").collect():
        assert rows[r["id"]][r["begin"] : r["end"]] == r["text"]
        got.setdefault(r["id"], []).append((r["begin"], r["end"]))
    assert set(got) == {k for k, v in rows.items() if v and len(v) > 2000}
    for k, ps in got.items():
        _check_pieces(rows[k], ps, 2000, 200)
    every = splitting.split_offsets(df, ["id"], "text", oversized_only=False).select("id").distinct().count()
    assert every == 7
    assert splitting.split_texts(df.filter("false"), ["id"], "text").count() == 0


def test_natural_boundaries():
    text = "A sentence here. " * 100 + "\n\n" + "Another one follows. " * 100
    ps = splitting.stitch([(0, len(text), *list(splitting.ranges(text))[0][2:])], 0, True, 2000, 200)
    assert text[ps[0][1] :].startswith("Another") and all(text[b - 1] in " \n" for b, _ in ps[1:])


def test_split_files(spark, tmp_path):
    text = "Grüße aus Köln, ŋɛ. " * 40_000
    p = tmp_path / "big.txt"
    p.write_bytes(text.encode())
    (tmp_path / "none.txt").write_text("")
    rows = splitting.split_files(spark, [str(p), str(tmp_path / "none.txt")], range_bytes=50_001).orderBy("piece").collect()
    assert all(text[r["begin"] : r["end"]] == r["text"] for r in rows)
    _check_pieces(text, [(r["begin"], r["end"]) for r in rows], 2000, 200)


VOCAB = os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.tiktoken")
have_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")


@have_vocab
def test_encoding(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rnd = random.Random(5)
    pool = ["the", " ", "  ", "\n\n", "isn't", "ŋɛ", "12", "<|endoftext|>", "日本語", "😀", "\u00a0", "\t", "x" * 50, "=====", ".", "\x1c", "\u3000", "''s"]
    rows = ["".join(rnd.choice(pool) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 400))) for _ in range(150)]
    rows += [None, "", " ", "a" * 9000, "日本語" * 4000, "  " * 5000, "same text again and again " * 900, "same text again and again " * 900, "\n" * 9000 + "x"]
    df = spark.createDataFrame([(i, x, "pos") for i, x in enumerate(rows)], "id long, text string, pos string")
    got = {r["id"]: r["ids"] for r in encoding.encode(df, "id", "text").collect()}
    want = [e.ids for e in t.encode_batch([x or "" for x in rows], add_special_tokens=False)]
    assert [i for i in range(len(rows)) if got[i] != want[i]] == []
    n = {r["id"]: r["n_tokens"] for r in encoding.token_counts(df, "id", "text").collect()}
    assert n == {i: len(w) for i, w in enumerate(want)}
    assert encoding.encode(df.filter("false"), "id", "text").count() == 0


@have_vocab
def test_joins_are_repaired():
    """Cuts at any place, in words, white space and contractions, leave the ids as they are."""
    enc = encoding.encoder(VOCAB)
    chunked = encoding.ChunkEncoder(enc)
    rnd = random.Random(8)
    pool = ["the", " ", "  ", "\n\n", "isn't", "'", "l", "ŋɛ", "12", "<|endoftext|>", "日本語", "😀", "\u00a0", "\t", "x" * 50, "====", ".", "\x1c", "\u3000", "\x85", "s"]
    for _ in range(3000):
        text = "".join(rnd.choice(pool) + rnd.choice([" ", "", ""]) for _ in range(rnd.randint(1, 60)))
        at = sorted({0, len(text), *(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 12)))})
        assert sum(chunked.encode([text[a:b] for a, b in zip(at, at[1:])]), []) == enc.encode_ordinary(text)
    for text in ("a" * 50_000, "  " * 30_000, "ab " * 30_000, "日本語" * 20_000):
        assert sum(chunked.encode([text[i : i + 64] for i in range(0, len(text), 64)]), []) == enc.encode_ordinary(text)


@have_vocab
def test_chunks_are_shared():
    rnd = random.Random(2)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(n))
    a = words(4000)
    one, two = encoding.chunks(words(50) + a), encoding.chunks(words(90) + a)
    assert len(set(one) & set(two)) >= len(one) - 3 and len(one) > 5 and "".join(one[1:]) in "".join(encoding.chunks(a)) + a
    enc = encoding.ChunkEncoder(encoding.encoder(VOCAB))
    for text in [one, two] + [one] * 5:
        enc.encode(text)
    assert enc.encoded < 0.2 * enc.asked
    small = encoding.ChunkEncoder(encoding.encoder(VOCAB), memory=3000)
    assert sum(small.encode(one), []) == sum(enc.encode(one), []) and len(small.new) < 10


def test_best_fit():
    place, room = best_fit([6, 5, 4, 3, 2, 0], 10)
    assert place[:5] == [0, 1, 0, 1, 1] and room == [0, 0]


def test_packing(spark):
    rnd = random.Random(6)
    rows = [(i, int(rnd.lognormvariate(5, 1.2))) for i in range(6000)] + [(9001, 0), (9002, None), (9003, 5000), (9004, 2048), (9005, -3)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id long, n int, container string")
    out = pack(df, "id", "n", 2048, group_items=300).collect()
    used, parts = {}, {}
    for r in out:
        used[r["container"]] = used.get(r["container"], 0) + r["n"]
        parts.setdefault(r["id"], []).append((r["part"], r["n"]))
    assert max(used.values()) <= 2048 and {i: sum(n for _, n in p) for i, p in parts.items()} == {i: max(0, n or 0) for i, n in rows}
    assert sorted(parts[9003]) == [(0, 2048), (1, 2048), (2, 904)] and all(len(p) == 1 for i, p in parts.items() if dict(rows)[i] is None or dict(rows)[i] <= 2048)
    assert sum(used.values()) / 2048 / len(used) > 0.98
    again = {(r["id"], r["part"], r["container"]) for r in pack(df.repartition(7), "id", "n", 2048, group_items=300).collect()}
    assert again == {(r["id"], r["part"], r["container"]) for r in out}
    assert pack(df.filter("false"), "id", "n", 2048).count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "n", 0)
    assert {r["n"] for r in pack(df.withColumn("n", F.lit(0)), "id", "n", 5).collect()} == {0}

"""Personal information on a small corpus with known cases."""

import random

import numpy as np
import pytest

from corpusloom.llm import pii

GIVEN, FAMILY = ["Talera", "Orinos", "Vasunmo", "Kodaë"], ["Lofulomm", "Ålmareri", "Kerringumm", "Zabötend"]


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(1200):
        g, f = rnd.choice(GIVEN), rnd.choice(FAMILY)
        name = rnd.choice([f"{g} {f}", f"{f}, {g}", f"{g.upper()} {f.upper()}", f"{g[0]}. {f}", "Wreina van Nyrekin", f"{g} A. {f}"])
        rows.append(
            (
                i,
                rnd.choice(
                    [
                        f"Recorded with {name} at Three Wells. The suffix is rare.",
                        f"Many thanks to Mr {name}, who checked every form.",
                        f"Phone {rnd.choice(['+999 555 01', '01632 960 1'])}{rnd.randint(10, 99)} before visiting. Interval 0.220-0.180 s; F0 999-555.",
                        f"Social security {rnd.choice(['666-36-70', 'ZZ-4683-84'])}{rnd.randint(10, 99)}. See item SIT-2023-54{rnd.randint(10, 99)} of the archive.",
                        f"The family lives at {rnd.randint(1, 99)} {rnd.choice(['Quarry Road', 'Old Kiln St.', 'Heron Lane'])} near the market.",
                        f"e-mail: {g.lower()}{rnd.randint(1, 99)}@post.example.net Table 24 lists the forms.",
                        f"Write to {g.lower()} (at) mail (dot) example (dot) com for the files. The form 3SG@FOC is a slip.",
                        "The order of things is fixed, the speaker says. Older recordings differ. In 1987-1994, pp. 123-145.",
                    ]
                ),
                "v",
            )
        )
    docs = spark.createDataFrame([*rows, (5000, None, "v"), (5001, "", "v")], "kind long, text string, val string")
    names = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [(None, "given")], "name string, name_type string")
    props = pii.proposed(docs, "kind", names)
    return docs, props, pii.fit(props, names)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Recorded with Talera Zabötend at Three Wells.", {("name", "Talera Zabötend")}),
        ("Many thanks to Mr Zabötend, Talera, who checked every form.", {("name", "Zabötend, Talera")}),
        ("Recorded with Wreina van Nyrekin at Three Wells.", {("name", "Wreina van Nyrekin")}),
        ("Phone 01632 960 155 before visiting.", {("phone", "01632 960 155")}),
        ("Social security ZZ-4683-8471. See item SIT-2023-5418 of the archive.", {("id_number", "ZZ-4683-8471")}),
        ("The family lives at 61 Old Kiln St. near the market.", {("address", "61 Old Kiln St.")}),
        ("e-mail: a.b+rec@post.example.net", {("email", "a.b+rec@post.example.net")}),
        ("Write to talera (at) mail (dot) example (dot) com for the files.", {("email", "talera (at) mail (dot) example (dot) com")}),
        ("The form 3SG@FOC is a slip. Interval 0.220-0.180 s; F0 999-555. Table 24 lists the forms.", set()),
        ("", set()),
    ],
)
def test_found(model, text, want):
    m = model[2]
    assert {(k, text[s:e]) for s, e, k in pii.find(text, m)} == want


HELD_OUT = [
    ("Yesterday Talera Lofulomm sent the second tape.", "name", "Talera Lofulomm"),
    ("The list was drawn up by Orinos Kerringumm.", "name", "Orinos Kerringumm"),
    ("We owe this remark to Prof. Vasunmo Ålmareri of the mission.", "name", "Vasunmo Ålmareri"),
    ("Speaker: Kerringumm, Vasunmo (born 1951)", "name", "Kerringumm, Vasunmo"),
    ("Ask K. Lofulomm about the tone marks.", "name", "K. Lofulomm"),
    ("You can ring me on +999 555 0147 in the evening.", "phone", "+999 555 0147"),
    ("Our office: 01632 960 177, mornings only.", "phone", "01632 960 177"),
    ("The passport, number ZZ-4683-8455, was copied.", "id_number", "ZZ-4683-8455"),
    ("His SSN is 666-36-7033 according to the form.", "id_number", "666-36-7033"),
    ("Please send the box to 14 Heron Lane before June.", "address", "14 Heron Lane"),
    ("They moved to 7 Quarry Road in spring.", "address", "7 Quarry Road"),
    ("The files went to orinos.k@post.example.org last week.", "email", "orinos.k@post.example.org"),
    ("Reach her via kodae (at) post (dot) example (dot) net if needed.", "email", "kodae (at) post (dot) example (dot) net"),
]


def test_sentences_of_no_template(model):
    """Values of the known shapes in sentences that the corpus doesn't have."""
    got = [(kind, val) in {(k, text[s:e]) for s, e, k in pii.find(text, model[2])} for text, kind, val in HELD_OUT]
    assert sum(got) >= 0.9 * len(got), [h for h, g in zip(HELD_OUT, got) if not g]


def test_columns(spark, model):
    docs, props, m = model
    found = pii.spans(props, "doc", m).collect()
    by = {r["kind"]: r["text"] for r in docs.collect()}
    assert len(found) > 900 and all(by[r["doc"]][r["begin"] : r["end"]] == r["val"] for r in found)
    assert {r["kind"] for r in found} == set(pii.KINDS)
    red = {r["doc"]: r["text"] for r in pii.redacted(docs.withColumnRenamed("kind", "doc"), "doc", pii.spans(props, "doc", m)).collect()}
    assert red[5000] is None and red[5001] == "" and len(red) == len(by)
    assert not any("Zabötend" in t for t in red.values() if t) and any("[NAME]" in t for t in red.values() if t)


def test_long_text(model):
    m = model[2]
    t = "plain words go on and on " * 20_000 + "Recorded with Talera Zabötend at Three Wells."
    assert [k for _, _, k in pii.find(t, m)] == ["name"]


def test_estimate():
    """The aggregation trusts labelers that agree with the others."""
    rnd = np.random.default_rng(12)
    pats = {}
    for _ in range(4000):
        y = rnd.random() < 0.4
        good = [1 if (rnd.random() < 0.9) == y else -1 for _ in range(3)]
        p = (*good, int(rnd.choice([-1, 1])))
        pats[p] = pats.get(p, 0) + 1
    r = pii.estimate(pats)
    assert 0.3 < r[0] < 0.5 and r[1][0][2] > np.log(0.8) and abs(r[1][3][2] - r[2][3][2]) < 0.3
    assert pii.posterior_logit([1, 1, 1, -1], r) > 0 > pii.posterior_logit([-1, -1, 1, 1], r)

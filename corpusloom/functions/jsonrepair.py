"""JSON objects in the text of a model's answer, repaired where they break off."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)
#: Endings that are tried, in this order.
SUFFIXES = ['"}', '"]}', '"]}}', "]}", "]}}", "}", "}}"]
MODES = {"repair": (500, True), "truncate": (300, False), "strict": (0, False)}


def parse_object(text: str | None, mode: str = "repair") -> dict:
    """The object of an answer: fenced, else from the first { to the last }; a broken one is cut back to an earlier }
    (within the mode's reach) or, in mode repair, closed with one of the endings. Without any object: {}."""
    back, close = MODES[mode]
    text = text or ""
    if mode == "strict":
        m = re.search(r"\{.*\}", re.sub(r"```(?:json)?", "", text), re.S)
        body = m.group() if m else ""
    else:
        m = _FENCED.search(text)
        a, b = text.find("{"), text.rfind("}") + 1
        body = m.group(1) if m else text[a:b] if a != -1 and b > a else ""
    if not body:
        return {}
    tries = [body]
    tries += [body[: i + 1] for i in range(len(body) - 1, max(len(body) - back, 0), -1) if back and body[i] == "}"]
    tries += [body + s for s in SUFFIXES] if close else []
    for t in tries:
        try:
            got = json.loads(t)
        except ValueError:
            continue
        return got if isinstance(got, dict) else {}
    return {}


def repaired(column, mode: str = "repair"):
    """The object as canonical JSON text (keys sorted)."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json.dumps(parse_object(t, mode), sort_keys=True, ensure_ascii=False))

    return run(column)

"""The language model behind an interface, and the operator that applies it to rows.

A client is anything with generate(prompt, max_new_tokens, json_mode) -> text. Rows are sent in batches by partition;
the result is materialised before it is used, since a model's answer must not be computed twice.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.jsonrepair import parse_object, repaired
from corpusloom.session import cut

#: Tokens per purpose, and what stands in when the model fails.
BUDGETS = {
    "domains": 6144, "tags": 512, "feature_plan": 1536, "query_plan": 1024, "action": 512, "claims": 1024, "contradiction": 512, "conclusion": 3000,
    "answer": 4096, "audit": 768, "label": 256, "usage": 800, "structure": 900, "global_plan": 2048, "synthesis": 2048, "universal_plan": 2048,
    "universal_extract": 512, "universal_synthesis": 1536, "code": 8, "prose": 1000, "rescue": 1024,
}
DEFAULTS: dict[str, dict] = {"domains": {"domains": []}, "claims": {"claims": []}, "action": {"action": "conclude"}, "label": {"label": "?"}, "audit": {"verdict": "upheld"}, "code": {"code": "?"}}


class LanguageModel(Protocol):
    def generate(self, prompt: str, max_new_tokens: int = 512, json_mode: bool = False) -> str: ...


@dataclass
class RuleModel:
    """A deterministic stand-in: the first rule whose key is in the prompt answers; a pure function of the prompt."""

    rules: list[tuple[str, str]] = field(default_factory=list)
    otherwise: str = "{}"

    def generate(self, prompt: str, max_new_tokens: int = 512, json_mode: bool = False) -> str:
        return next((a for k, a in self.rules if k in prompt), self.otherwise)


@dataclass
class HttpModel:
    """A chat endpoint. Three tries with pauses of 2 and 4 seconds; the token budget is doubled, up to 8192."""

    url: str
    model: str
    key: str = ""
    timeout: float = 120.0

    def generate(self, prompt: str, max_new_tokens: int = 512, json_mode: bool = False) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0.1, "max_tokens": min(8192, 2 * max_new_tokens)}
        if json_mode:
            body["response_format"] = {"type": "json_object"}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for pause in (2, 4, None):
            try:
                req = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
                with urllib.request.urlopen(req, timeout=self.timeout) as r:
                    return json.load(r)["choices"][0]["message"]["content"] or ""
            except (OSError, ValueError, KeyError):
                if pause is None:
                    raise
                time.sleep(pause)
        return ""


@dataclass
class Usage:
    """Calls and characters, summed over rows by the caller."""

    calls: int = 0
    prompt_chars: int = 0
    answer_chars: int = 0

    def add(self, prompt: str, answer: str) -> None:
        self.calls += 1
        self.prompt_chars += len(prompt)
        self.answer_chars += len(answer)


def ask(model: LanguageModel, purpose: str, prompt: str, usage: Usage | None = None) -> dict:
    """An answer as an object, with the purpose's default if the model fails or says nothing usable."""
    try:
        text = model.generate(prompt, BUDGETS.get(purpose, 512), True)
    except Exception:  # noqa: BLE001 - a failing model must not end a run over a whole corpus
        text = ""
    if usage:
        usage.add(prompt, text)
    return parse_object(text) or dict(DEFAULTS.get(purpose, {}))


def answers(rows: DataFrame, factory: Callable[[], LanguageModel], purpose: str, prompt: str = "prompt") -> DataFrame:
    """Adds answer (text; empty if the model failed). The factory builds a client once per partition."""
    budget = BUDGETS.get(purpose, 512)

    def run(it):
        model = factory()
        for pdf in it:
            out = []
            for p in pdf[prompt]:
                try:
                    out.append(model.generate(p or "", budget, True))
                except Exception:  # noqa: BLE001
                    out.append("")
            yield pdf.assign(answer=out)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return cut(rows.mapInPandas(run, schema + ", answer string"))


def usage(answered: DataFrame, prompt: str = "prompt") -> DataFrame:
    """calls, prompt_chars and answer_chars of answered rows, in one row."""
    return answered.agg(F.count("*").alias("calls"), F.sum(F.char_length(prompt)).alias("prompt_chars"), F.sum(F.char_length("answer")).alias("answer_chars"))


def resolve_contradictions(claims: DataFrame, factory: Callable[[], LanguageModel]) -> DataFrame:
    """graph_id, seq_a, seq_b, resolved, resolution, confidence_a, confidence_b: each contradicting pair of claims is put to
    the model, which may resolve it and revise the confidences (evidence.revised applies them)."""
    from corpusloom.operators import evidence

    side = lambda s: claims.select("graph_id", F.col("seq").alias(f"seq_{s}"), F.col("text").alias(f"text_{s}"), F.col("source").alias(f"source_{s}"))
    pairs = evidence.contradictions(claims).select("graph_id", "seq_a", "seq_b").join(side("a"), ["graph_id", "seq_a"]).join(side("b"), ["graph_id", "seq_b"])
    asked = pairs.withColumn("prompt", F.concat_ws("\n", F.lit("CONTRADICTION"), "graph_id", "source_a", "text_a", "source_b", "text_b"))
    got = answers(asked.select("graph_id", "seq_a", "seq_b", "prompt"), factory, "contradiction").withColumn("o", repaired(F.col("answer")))
    value = lambda k: F.get_json_object("o", f"$.{k}")
    number = lambda k: F.expr(f"try_cast(get_json_object(o, '$.{k}') AS double)")
    return got.select(
        "graph_id", "seq_a", "seq_b", F.coalesce(value("resolved") == "true", F.lit(False)).alias("resolved"), F.coalesce(value("resolution"), F.lit("")).alias("resolution"),
        number("revised_confidence_a").alias("confidence_a"), number("revised_confidence_b").alias("confidence_b"),
    )

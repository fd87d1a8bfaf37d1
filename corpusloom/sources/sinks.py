"""Writers: result records as JSON, summaries as CSV, reports as Markdown."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a report, at most: reports are read by people and written by the driver.
MAX_REPORT_ROWS = 10_000


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Result records, one JSON object a line, partitioned for resuming by key."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def append_results(df: DataFrame, path: str, keys: list[str]) -> None:
    """Adds finished records; readers.pending leaves their keys out of the next run."""
    df.write.mode("append").partitionBy(*keys).parquet(path)


def _bounded(df: DataFrame) -> list[dict]:
    rows = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError(f"a report has at most {MAX_REPORT_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_pretty_json(df: DataFrame, path: str) -> None:
    """One pretty-printed file, for records that a person reads."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(_bounded(df), f, ensure_ascii=False, indent=2, default=str)


def coding_rows(results: DataFrame) -> DataFrame:
    """The columns of the coding summary, with its truncations."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return results.select("feature_id", "language", "label", "value", "confidence", "verdict", cut("label_reasoning", 200), cut("answer", 150))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_csv_row(path: str, columns: list[str], row: dict) -> None:
    """Adds a row and flushes it, so that a broken run keeps what it has."""
    import csv

    new = not os.path.exists(path)
    with open(path, "a", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, columns, extrasaction="ignore")
        if new:
            w.writeheader()
        w.writerow(row)
        f.flush()
        os.fsync(f.fileno())


def types_report(groups: DataFrame) -> str:
    """Markdown of value groups (question, rank, value, n, share, languages)."""
    out = []
    for r in _bounded(groups.orderBy("question", "rank")):
        if r["rank"] == 1:
            out += ["", f"## {r['question']}", "", "| Type | Languages | % | |", "|---|---|---|---|"]
        out.append(f"| {r['value']} | {r['n']} | {r['share']} | {r['languages']} |")
    return "\n".join(out).strip()


#: Fixed value: the order of assessments in a report.
ORDER = ["VALID_VIOLATION", "VALID_SUPPORT", "INSUFFICIENT", "ANTECEDENT_NA", "IRRELEVANT"]


def verdict_report(verdicts: DataFrame, labels: DataFrame) -> str:
    """Markdown of universal verdicts: a summary table, then for each its languages, by assessment, with what was found,
    the evidence of both sides, notes and the reviewer's reason."""
    out = ["| Universal | Verdict | Support | Violation | N/A | Confidence |", "|---|---|---|---|---|---|"]
    vs = _bounded(verdicts.orderBy("uid"))
    out += [f"| {v['uid']} | {v['verdict']} | {v['n_valid_support']} | {v['n_valid_violation']} | {v['n_antecedent_na']} | {v['mean_confidence']:.2f} |" for v in vs]
    by: dict[str, list[dict]] = {}
    for r in _bounded(labels):
        by.setdefault(r["uid"], []).append(r)
    told = {True: "holds", False: "does not hold", None: "unknown"}
    for v in vs:
        out += ["", f"### {v['uid']}: {v['verdict']}", ""]
        for r in sorted(by.get(v["uid"], []), key=lambda r: (ORDER.index(r["label"]), r["language"])):
            out.append(f"- {r['label']}: {r['language']}")
            if r.get("antecedent_evidence") or r.get("consequent_evidence"):
                out += [f"  - {side} {told[r.get(side + '_holds')]}: {r.get(side + '_evidence') or '-'}" for side in ("antecedent", "consequent")]
            out += [f"  - {k}: {r[k]}" for k in ("notes", "reason") if r.get(k)]
    return "\n".join(out)

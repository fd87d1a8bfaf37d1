"""Schemas of the records that sources read and operators exchange."""

from __future__ import annotations

CHUNK = (
    "ord bigint, chunk_id string, text string, chapter string, section string, subsection string, subsubsection string, "
    "label string, page int, level int, summary string"
)
IGT = (
    "ord bigint, example_id string, source string, morpheme string, gloss string, translation string, gloss_tags array<string>, "
    "chapter string, section string, subsection string, subsubsection string, tones string, label string, source_section string"
)
ABBREV = "ord bigint, tag string, meaning string"
UNIVERSAL = "id string, statement string, antecedent string, consequent string, logic string, domain string, source string"
CODING = "ID string, Query string, Coding string, Definition string, Grambank_ID_desc string"
CLAIM = (
    "graph_id string, seq bigint, claim_type string, text string, source string, confidence double, supports boolean, igt_examples array<string>"
)
LANGUAGE_VERDICT = (
    "uid string, language string, antecedent_holds boolean, consequent_holds boolean, violates boolean, confidence double, raw_answer string"
)

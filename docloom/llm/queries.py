"""Registered queries of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (module, function)
_QUERIES = {
    "op1_additive_ann": ("docloom.llm.additive_ann", "op1_additive_ann"),
    "op2_simhash": ("docloom.llm.simhash_index", "op2_simhash"),
    "op3_line_dedup": ("docloom.llm.line_dedup", "op3_line_dedup"),
    "op4_lm_automaton": ("docloom.llm.lm_automaton", "op4_lm_automaton"),
    "op5_mixing": ("docloom.llm.mixing", "op5_mixing"),
    "op6_token_file": ("docloom.llm.token_file", "op6_token_file"),
    "op7_sentencepiece": ("docloom.llm.piece_codec", "op7_sentencepiece"),
    "op8_language_id": ("docloom.llm.language_id", "op8_language_id"),
    "op9_quartile_digest": ("docloom.llm.quartile_digest", "op9_quartile_digest"),
    "pipeline": ("corpus_pipeline", "run"),
    "op10_toxicity": ("docloom.llm.toxicity", "op10_toxicity"),
    "op11_licence_scan": ("docloom.llm.licence_scan", "op11_licence_scan"),
    "op12_conversation_repair": ("docloom.llm.conversation_repair", "op12_conversation_repair"),
    "op13_token_alignment": ("docloom.llm.token_alignment", "op13_token_alignment"),
}


def _call(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(importlib.import_module(module), function)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _call(*where) for name, where in _QUERIES.items()}
    return out


#: The same windows over whole lines: one that begins, and one that ends, at every line that has words.
_OP3 = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS p, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, p, line, w, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS e FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l) WHERE w > 0),
f AS (SELECT doc_id, p AS first, max(p) OVER a AS last, list(line) OVER a AS ls, max(e) OVER a - (e - w) AS n FROM s WINDOW a AS (PARTITION BY doc_id ORDER BY e - w RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
b AS (SELECT doc_id, min(p) OVER a AS first, p AS last, list(line) OVER a AS ls, e - min(e - w) OVER a AS n FROM s WINDOW a AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
u AS (SELECT doc_id, first, last, array_to_string(ls, chr(10)) AS k FROM f WHERE n >= 50 UNION SELECT doc_id, first, last, array_to_string(ls, chr(10)) FROM b WHERE n >= 50),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS d0, min(first) OVER (PARTITION BY k, doc_id) AS f0 FROM u),
dead AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS p FROM m WHERE doc_id > d0 OR first > f0)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(dead.p)::BIGINT AS n_deleted, sha256(coalesce(string_agg(CASE WHEN dead.p IS NULL THEN line END, chr(10) ORDER BY l.p), '')) AS kept_sha256
FROM l LEFT JOIN dead ON l.doc_id = dead.doc_id AND l.p = dead.p GROUP BY l.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _OP3}

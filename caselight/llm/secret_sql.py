"""Operator 3 as DuckDB SQL, from the same rules."""

from __future__ import annotations

from caselight.llm.secret_rules import BASE_KINDS, RULES, Rule


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(rule: Rule, number: int) -> str:
    """List of {s, number, e} of the matches that count: lengths of matches and of what lies between give places."""
    # this engine's patterns have no bounds above 1000
    pattern = _literal(("(?i)" if rule.any_case else "") + rule.pattern.replace(",4096}", ",}"))
    hits, gaps = f"regexp_extract_all(t, {pattern}, 0)", f"string_split_regex(t, {pattern})"
    kept = f"regexp_extract_all(t, {pattern}, {rule.group})"
    return f"""CASE WHEN NOT regexp_matches(t, {pattern}) THEN [] ELSE (
      SELECT list({{s: before, number: {number}, e: before + n}} ORDER BY i) FROM (
        SELECT i, n, k, sum(g) OVER (ORDER BY i) + sum(n) OVER (ORDER BY i) - n AS before
        FROM (SELECT unnest(range(len({hits}))) AS i, unnest(list_transform({hits}, lambda x: length(x))) AS n,
                unnest(list_transform({kept}, lambda x: length(x))) AS k,
                unnest(list_transform({gaps}[1:len({hits})], lambda x: length(x))) AS g))
      WHERE k >= {rule.least}) END AS r{number}"""


def secret_scan_sql() -> str:
    names = "[" + ", ".join(_literal(r.kind) for r in RULES) + "]"
    every = " || ".join(f"coalesce(r{i}, [])" for i in range(len(RULES)))
    listed = lambda spans: (
        f"coalesce(array_to_string(list_transform({spans}, lambda x: concat({names}[x.number + 1], ':', "
        f"CAST(x.s AS BIGINT), ':', CAST(x.e AS BIGINT))), ','), '')")
    base = f"list_filter(found, lambda x: x.number < {len(BASE_KINDS)})"
    counts = ", ".join(
        f"len(list_filter(found, lambda x: x.number = {i})) AS n_{kind}" for i, kind in enumerate(BASE_KINDS))
    return f"""SELECT doc_id, {counts}, sha256({listed(base)}) AS base_sha256, {listed("found")} AS spans
      FROM (SELECT doc_id, list_sort({every}) AS found FROM (
        SELECT doc_id, {", ".join(_spans(r, i) for i, r in enumerate(RULES))}
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))"""

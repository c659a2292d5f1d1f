"""Positions of regular-expression matches in code points, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """A kind of finding. ``keep`` is a condition on (value, length of the match); ``needs`` a text that every match holds."""

    kind: str
    pattern: str
    group: int = 0
    keep: str = "true"
    needs: str = ""


def locate(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``df`` with one array of (start, end, value) per rule, named by its kind; end is exclusive, value is ``group``.

    Java splits a text at the very matches that ``regexp_extract_all`` lists, so a match starts where the gaps and matches
    before it end. A text without a match has an empty array. Working columns start with ``_m_``.
    """
    body = F.col(text)
    hits = {
        f"_m_{r.kind}": F.when(
            F.contains(body, F.lit(r.needs)) if r.needs else F.lit(True),
            F.regexp_extract_all(body, F.lit(r.pattern), F.lit(0)),
        )
        for r in rules
    }
    df = df.withColumns(hits)
    parts = {}
    for r in rules:
        some = F.size(f"_m_{r.kind}") > 0
        parts[f"_m_gap_{r.kind}"] = F.when(some, F.split(body, r.pattern, -1))
        parts[f"_m_val_{r.kind}"] = F.when(
            some, F.regexp_extract_all(body, F.lit(r.pattern), F.lit(r.group)) if r.group else F.col(f"_m_{r.kind}")
        )
    df = df.withColumns(parts)
    return df.withColumns({r.kind: _spans(r) for r in rules}).drop(*hits, *parts)


def running(values: str, step: str) -> str:
    """SQL of the running fold of an array by the associative SQL ``step`` of x and y: distances double, so n log n work."""
    return f"""
      aggregate(sequence(0, 30), {values}, (p, k) -> CASE WHEN size(p) <= shiftleft(1, k) THEN p ELSE
        transform(p, (x, i) -> CASE WHEN i < shiftleft(1, k) THEN x
          ELSE get(transform(array(get(p, i - shiftleft(1, k))), y -> {step}), 0) END) END)"""


def _spans(rule: Rule) -> Column:
    # the arrays are zipped, not looked up: what stands inside a lambda may be computed again for each element
    k = rule.kind
    ends = running(f"zip_with(_m_gap_{k}, _m_{k}, (gap, m) -> length(gap) + length(m))", "x + y")
    spans = f"""
      zip_with(zip_with({ends}, _m_{k}, (e, m) -> named_struct('start', e - length(m), 'end', e)), _m_val_{k},
        (s, v) -> named_struct('start', s.start, 'end', s.end, 'value', v))"""
    kept = f"filter({spans}, s -> s.end IS NOT NULL AND {rule.keep})"
    return F.expr(f"CASE WHEN size(_m_{k}) > 0 THEN {kept} ELSE CAST(array() AS array<{SPAN}>) END")


def listed(kinds: list[str], by_start: bool) -> Column:
    """All spans of the kinds as one array of (start, end, kind, value), by start and kind as listed, or kind and start."""
    first, second = ("start", "rank") if by_start else ("rank", "start")
    field = {"start": "s.start", "rank": ""}
    arrays = []
    for rank, kind in enumerate(kinds):
        field["rank"] = str(rank)
        arrays.append(
            f"transform({kind}, s -> named_struct('a', {field[first]}, 'b', {field[second]}, 'start', s.start, "
            f"'end', s.end, 'kind', '{kind}', 'value', s.value))"
        )
    return F.expr(
        f"transform(array_sort(concat({', '.join(arrays)})), "
        "x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'value', x.value))"
    )


def digest_text(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def replaced(text: str, spans: str, label: str) -> Column:
    """``text`` with each of the ``spans``, in order of start, replaced by the SQL ``label`` of s.

    Spans that overlap are replaced together, under the label of the first, so nothing of them is left. Pieces are taken from
    chunks of the text, so the work is in proportion to its length and the number of spans.
    """
    def piece(low: str, high: str) -> str:
        chunks = f"slice(t.chunks, {low} div {CHUNK} + 1, {high} div {CHUNK} - {low} div {CHUNK} + 1)"
        return f"substring(array_join({chunks}, ''), {low} % {CHUNK} + 1, {high} - {low})"

    reach = running(f"transform({spans}, s -> s.end)", "greatest(x, y)")
    kept = "filter(transform(t.spans, (s, i) -> named_struct('s', s, 'at', IF(i = 0, 0, get(t.reach, i - 1)))), b -> b.s.start >= b.at)"
    parts = f"transform({kept}, b -> concat({piece('b.at', 'b.s.start')}, get(transform(array(b.s), s -> {label}), 0)))"
    tail = piece("get(t.reach, size(t.reach) - 1)", f"length({text})")
    return F.expr(f"""
      CASE WHEN size({spans}) > 0 THEN get(transform(array(named_struct(
        'chunks', regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0), 'spans', {spans}, 'reach', {reach})),
        t -> concat(array_join({parts}, ''), {tail})), 0) ELSE {text} END""")

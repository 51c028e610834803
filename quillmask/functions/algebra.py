"""Span algebra on the spans of one cell: sort once, then one linear fold.

Cells hold few spans, but one huge cell may hold many thousands, so all pairs
are compared only of up to ``FEW`` spans, where that is cheaper than the fold; both
give the same. Every function takes and returns arrays.
"""

from __future__ import annotations

from quillmask.functions.folds import scan
from quillmask.functions.spans import FEW, slices
from quillmask.functions.sql import empty, let, struct, text as text_literal

SPANS = "array<struct<entity_type:string,start:int,end:int,score:double,text:string>>"
HULLS = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def _by_type(spans: str) -> str:
    """Order by type, start, longest first, best score first."""
    key = struct(
        entity_type="k.entity_type", start="k.start", back="-k.end", rank="-k.score", text="k.text"
    )
    return f"sort_array(transform({spans}, k -> {key}))"


def _lone_types(spans: str) -> str:
    """True if no two spans share a type, the usual case for short cells."""
    return f"(size({spans}) <= 1 or size(array_distinct(transform({spans}, k -> k.entity_type))) = size({spans}))"


def _hull(k: str) -> str:
    """A span from its sort key."""
    return struct(entity_type=f"{k}.entity_type", start=f"{k}.start", end=f"-{k}.back", score=f"-{k}.rank")


def report_order(spans: str) -> str:
    """Order by best score, then start, then longest; the order of report rows."""
    key = struct(
        rank="-k.score", start="k.start", back="-k.end", entity_type="k.entity_type", text="k.text"
    )
    row = struct(entity_type="k.entity_type", start="k.start", end="-k.back", score="-k.rank", text="k.text")
    return (
        f"if(size({spans}) <= 1, {spans}, "
        f"transform(sort_array(transform({spans}, k -> {key})), k -> {row}))"
    )


def drop_contained(spans: str) -> str:
    """Drop a span that lies inside a same-type span of at least its score.

    Walking by start, a span is contained exactly if an earlier one of its type
    reaches its end with no lower score. The state keeps, per score level, the
    furthest end seen; entries that another one dominates are dropped, so it
    never outgrows the number of distinct scores.
    """
    frontier = "array<struct<score:double,end:int>>"

    def step(st: str, x: str) -> tuple[str, str]:
        seen = f"if({st}.entity_type = {x}.entity_type, {st}.seen, {empty(frontier)})"
        inside = f"exists({seen}, f -> f.end >= -{x}.back and f.score >= -{x}.rank)"
        mine = struct(score=f"-{x}.rank", end=f"-{x}.back")
        kept = f"concat(filter({seen}, f -> f.end > -{x}.back or f.score > -{x}.rank), array({mine}))"
        row = struct(
            entity_type=f"{x}.entity_type",
            start=f"{x}.start",
            end=f"-{x}.back",
            score=f"-{x}.rank",
            text=f"{x}.text",
        )
        after = struct(entity_type=f"{x}.entity_type", seen=f"if({inside}, {seen}, {kept})")
        return after, f"if({inside}, {empty(SPANS)}, array({row}))"

    zero = struct(entity_type="''", seen=empty(frontier))
    covers = (
        "c.entity_type = k.entity_type and c.start <= k.start and c.end >= k.end and c.score >= k.score "
        "and (c.start < k.start or c.end > k.end or c.score > k.score)"
    )
    short = let("few", f"array_distinct({spans})", f"filter(few, k -> not exists(few, c -> {covers}))")
    walk = scan(_by_type(spans), zero, SPANS, step)
    return f"case when size({spans}) <= 1 then {spans} when size({spans}) <= {FEW} then {short} else {walk} end"


def drop_allowed(spans: str, allow_list) -> str:
    """Drop spans whose whole text is an allowed word."""
    if not allow_list:
        return spans
    words = ", ".join(text_literal(w) for w in allow_list)
    return f"filter({spans}, a -> a.text not in ({words}))"


def hull_row(k: str) -> str:
    return struct(entity_type=f"{k}.entity_type", start=f"{k}.start", end=f"{k}.end", score=f"{k}.score")


def hulls(spans: str) -> str:
    """Spans without their text."""
    return f"transform({spans}, k -> {hull_row('k')})"


def merge_overlaps(spans: str) -> str:
    """Join overlapping spans of one type into their hull, with the best score."""

    def step(st: str, x: str) -> tuple[str, str]:
        joins = f"({st}.entity_type = {x}.entity_type and {x}.start < {st}.end)"
        wider = struct(
            entity_type=f"{st}.entity_type",
            start=f"{st}.start",
            end=f"greatest({st}.end, -{x}.back)",
            score=f"greatest({st}.score, -{x}.rank)",
        )
        return f"if({joins}, {wider}, {_hull(x)})", f"if({joins}, {empty(HULLS)}, array({st}))"

    merged = let(
        "ks",
        _by_type(spans),
        scan("slice(ks, 2, size(ks))", _hull("get(ks, 0)"), HULLS, step, lambda st: f"array({st})"),
    )
    return f"if({_lone_types(spans)}, {hulls(spans)}, {merged})"


def resolve_conflicts(merged: str) -> str:
    """Drop a span that lies inside another; of equal spans the better score stays.

    Equal scores are settled by the smaller type name. In the order used, a
    span is contained exactly if an earlier one reaches its end.
    """
    key = struct(start="k.start", back="-k.end", rank="-k.score", entity_type="k.entity_type")
    ordered = f"sort_array(transform({merged}, k -> {key}))"

    def step(st: str, x: str) -> tuple[str, str]:
        keep = f"if(-{x}.back > {st}, array({_hull(x)}), {empty(HULLS)})"
        return f"greatest({st}, -{x}.back)", keep

    flipped = struct(start="k.start", end="k.end", score="k.score", entity_type="k.entity_type")
    inside = (
        "c.start <= k.start and c.end >= k.end and (c.start < k.start or c.end > k.end "
        "or c.score > k.score or (c.score = k.score and c.entity_type < k.entity_type))"
    )
    kept = f"sort_array(filter(few, k -> not exists(few, c -> {inside})))"
    short = let("few", f"array_distinct(transform({merged}, k -> {flipped}))", f"transform({kept}, k -> {hull_row('k')})")
    walk = scan(ordered, "-1", HULLS, step)
    return f"case when size({merged}) <= 1 then {merged} when size({merged}) <= {FEW} then {short} else {walk} end"


def _gaps_before(spans: str) -> str:
    """Per span the interval since the one before it; where they overlap it is empty."""
    gap = struct(start=f"least(coalesce(get({spans}, n - 1).end, k.start), k.start)", end="k.start")
    return f"transform({spans}, (k, n) -> {gap})"


def merge_adjacent(text: str, spans: str) -> str:
    """Join neighbours of one type with nothing but blanks between them.

    Takes spans in text order, none inside another.
    """
    items = (
        f"zip_with({spans}, {slices(text, _gaps_before(spans))}, "
        f"(k, g) -> {struct(span='k', blank=r'''(g rlike r'^ +\z')''')})"
    )

    def step(st: str, x: str) -> tuple[str, str]:
        joins = f"({st}.entity_type = {x}.span.entity_type and {x}.blank)"
        wider = struct(
            entity_type=f"{st}.entity_type",
            start=f"{st}.start",
            end=f"{x}.span.end",
            score=f"greatest({st}.score, {x}.span.score)",
        )
        return f"if({joins}, {wider}, {x}.span)", f"if({joins}, {empty(HULLS)}, array({st}))"

    joined = let(
        "its",
        items,
        scan("slice(its, 2, size(its))", "get(its, 0).span", HULLS, step, lambda st: f"array({st})"),
    )
    before = f"get({spans}, n - 1)"
    gap = f"substring({text}, {before}.end + 1, k.start - {before}.end)"
    touching = rf"n > 0 and {before}.entity_type = k.entity_type and k.start > {before}.end and {gap} rlike r'^ +\z'"
    apart = f"size({spans}) <= 1 or (size({spans}) <= {FEW} and size(filter({spans}, (k, n) -> {touching})) = 0)"
    return f"if({apart}, {spans}, {joined})"

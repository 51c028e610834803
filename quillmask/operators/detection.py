"""From the text of a cell to its scored spans."""

from __future__ import annotations

from collections.abc import Iterable

from quillmask.catalogue import DIGIT, MODEL_LABELS, MODEL_SCORE, Catalogue, Detector
from quillmask.functions.algebra import SPANS
from quillmask.functions.context import context_of, has_context
from quillmask.functions.spans import MATCHES, NEAR, ascii_pattern, find_matches, folded, if_found, is_plain, occurs, place, slices
from quillmask.functions.sql import empty, flat, let, regex, struct, text as text_literal, texts

ENTITIES = "array<struct<start:int,end:int,label:string,score:double>>"


def guard_of(pattern) -> tuple[str | None, tuple[str, ...]]:
    """What tells the guards of patterns apart."""
    return pattern.needs, pattern.needs_words


def guard_patterns(patterns: Iterable) -> list[tuple[str | None, tuple[str, ...]]]:
    """The distinct cheap guards of some detectors or residual patterns."""
    return sorted({guard_of(p) for p in patterns} - {(None, ())}, key=lambda g: (g[0] or "", g[1]))


HAS_DIGIT = "(?U)" + DIGIT


def has_digit(text: str, plain: str | None = None) -> str:
    return occurs(text, HAS_DIGIT, plain)


def guard(text: str, needs: str | None, words: tuple[str, ...] = (), digit: str | None = None, plain: str | None = None, low: str | None = None) -> str:
    """Cheap necessary condition. Words come first, as plain substrings are found fastest; guards that ask
    for digits then test for any digit, which settles most cells. ``digit``, ``plain`` and ``low`` name columns
    or variables with :func:`has_digit`, :func:`is_plain` and :func:`folded` of the text."""
    tests = [f"({' or '.join(f'contains({low or folded(text)}, {text_literal(w)})' for w in words)})"] if words else []
    if needs is not None and needs.startswith(DIGIT):
        tests.append(digit or has_digit(text, plain))
    if needs not in (None, DIGIT):
        quick = ascii_pattern("(?U)" + needs.replace(r"\p{L}", "[A-Za-z]"))
        own = f"{text} rlike {regex('(?U)' + needs)}"
        tests.append(own if quick is None else f"if({plain or is_plain(text)}, {text} rlike {regex(quick)}, {own})")
    return f"({' and '.join(tests)})"


def guard_tests(text: str, pattern, guards: dict | None = None) -> list[str]:
    """Cheap conditions that hold if the pattern occurs; ``guards`` names columns with guard results at hand."""
    tests = []
    if guard_of(pattern) != (None, ()):
        tests.append((guards or {}).get(guard_of(pattern)) or guard(text, *guard_of(pattern)))
    if pattern.needs_text is not None:
        tests.append(f"contains({text}, {text_literal(pattern.needs_text)})")
    return tests


def raw_matches(text: str, detector) -> str:
    """Matches of one pattern without any scoring."""
    tests, matches = guard_tests(text, detector), find_matches(text, detector.java_pattern)
    return f"if({' and '.join(tests)}, {matches}, {empty(MATCHES)})" if tests else matches


def hit_of(text: str, pattern, fields: dict[str, str], guards: dict | None, plain: str, extra: str | None = None) -> str:
    """A struct of the given fields and the parts that one pattern cuts a cell into; null if nothing matches."""
    tests = [*([] if extra is None else [extra]), *guard_tests(text, pattern, guards)]
    found = if_found(text, pattern.java_pattern, plain, lambda by_turns: struct(**fields, parts=by_turns))
    return f"if({' and '.join(tests)}, {found}, null)" if tests else found


def _hit(text: str, detector: Detector, guards: dict | None, plain: str) -> str:
    """What one detector found in a cell, with all that scoring needs; null if nothing."""
    lifts = detector.boosted_score > detector.score
    fields = {
        "entity_type": text_literal(detector.entity_type),
        "score": f"{float(detector.score)!r}D",
        "boosted": f"{float(detector.boosted_score)!r}D",
        "context": texts(detector.context_words if lifts else ()),
    }
    return hit_of(text, detector, fields, guards, plain)


def pattern_hits(text: str, detectors, guards: dict | None = None, plain: str | None = None) -> str:
    """Array of the hits of all detectors that found something; ``plain`` names a column with :func:`is_plain`."""
    given = guards is not None
    if not given:
        # one test each, by the names of variables: a regex that several detectors need is tried once
        needs = sorted({d.needs for d in detectors if d.needs not in (None, DIGIT)})
        shared = {n: f"need{i}" for i, n in enumerate(needs)}
        guards = {}
        for own, words in guard_patterns(detectors):
            tests = [guard(text, None, words, low="low")] if words else []
            guards[own, words] = " and ".join([*tests, *([] if own is None else [shared.get(own, "digit")])])
    hits = f"filter(array({', '.join(_hit(text, d, guards, plain or 'plain') for d in detectors)}), h -> h is not null)"
    if not given:
        for n, variable in shared.items():
            hits = let(variable, guard(text, n, (), "digit", "plain"), hits)
        hits = let("low", folded(text), let("digit", has_digit(text, "plain"), hits))
    return hits if plain else let("plain", is_plain(text), hits)


def spans_of_hits(text: str, hits: str, stopwords, threshold: float, lemmas=()) -> str:
    """Scored spans that reach the threshold.

    Cutting by score before duplicates are dropped is safe: a span below the
    threshold could only ever displace spans that score no higher. One
    expression serves all detectors, so the plan does not grow with them.
    """
    lifted = has_context(context_of(text, "m", stopwords, lemmas), "h.context")
    if not lemmas:
        # what directly precedes a match near the beginning is all there is: mostly no context word is in it
        near = let("low", "lower(concat(m.lead, chr(10), m.text))", "exists(h.context, w -> contains(low, w))")
        lifted = f"((m.start > {NEAR} or {near}) and {lifted})"
    span = struct(
        entity_type="h.entity_type",
        start="m.start",
        end="m.end",
        score=f"if(size(h.context) = 0, h.score, if({lifted}, h.boosted, h.score))",
        text="m.text",
    )
    scored = f"transform({place('h.parts')}, m -> {span})"
    kept = f"filter({scored}, a -> a.score >= {float(threshold)!r}D)"
    return flat(f"transform({hits}, h -> {kept})")


def entity_spans(text: str, entities: str, entity_types, threshold: float) -> str:
    """Spans from an annotation column, labels mapped to entity types.

    Texts are cut in start order, so neighbouring spans share a segment.
    """
    cases = " ".join(f"when {text_literal(k)} then {text_literal(v)}" for k, v in MODEL_LABELS.items())
    row = struct(
        start="cast(e.start as int)",
        end="cast(e.end as int)",
        entity_type=f"case upper(e.label) {cases} end",
        score=f"coalesce(e.score, {MODEL_SCORE!r}D)",
    )
    wanted = ", ".join(text_literal(t) for t in entity_types)
    rows = (
        f"sort_array(filter(transform({entities}, e -> {row}), "
        f"e -> e.entity_type in ({wanted}) and e.score >= {float(threshold)!r}D))"
    )
    span = struct(entity_type="e.entity_type", start="e.start", end="e.end", score="e.score", text="t")
    ends = f"transform(es, e -> {struct(start='e.start', end='e.end')})"
    spans = let("es", rows, f"zip_with(es, {slices(text, ends)}, (e, t) -> {span})")
    return f"if({entities} is null or size({entities}) = 0, {empty(SPANS)}, {spans})"


def candidates(
    text: str,
    detectors,
    catalogue: Catalogue,
    entity_types,
    threshold: float,
    guards: dict | None = None,
    entities: str | None = None,
    plain: str | None = None,
) -> str:
    """All spans of the wanted types that reach the threshold, duplicates included."""
    given = []
    if detectors:
        spans = spans_of_hits(text, "hs", catalogue.stopwords, threshold, catalogue.lemmas)
        given.append(let("hs", pattern_hits(text, detectors, guards, plain), f"if(size(hs) = 0, {empty(SPANS)}, {spans})"))
    if entities is not None:
        given.append(entity_spans(text, entities, entity_types, threshold))
    return f"concat({', '.join(given)})" if len(given) > 1 else given[0] if given else empty(SPANS)

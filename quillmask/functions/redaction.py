"""Replace spans by tags."""

from __future__ import annotations

from quillmask.catalogue import GENERIC_TAG
from quillmask.functions.spans import slices
from quillmask.functions.sql import let, struct, text as text_literal


def is_generic(style: str) -> bool:
    return style.startswith("Generic")


def tag_for(entity_type: str, style: str, tags: dict[str, str]) -> str:
    """The replacement of one span: one tag for all, or a tag per type."""
    other = text_literal(GENERIC_TAG)
    if is_generic(style) or not tags:
        return other
    cases = " ".join(f"when {text_literal(k)} then {text_literal(v)}" for k, v in tags.items())
    return f"case {entity_type} {cases} else {other} end"


def splice(text: str, spans: str, style: str, tags: dict[str, str]) -> str:
    """Rebuild the text with a tag in place of each span.

    Spans come in text order, none inside another. Where two spans overlap in
    part, the earlier one ends at the start of the later one.
    """
    # Untouched stretches: before each span, and after the last one.
    stretch = struct(start=f"least(coalesce(get({spans}, n - 1).end, 0), k.start)", end="k.start")
    rest = struct(start=f"get({spans}, size({spans}) - 1).end", end=f"length({text})")
    kept = f"concat(transform({spans}, (k, n) -> {stretch}), array({rest}))"
    tagged = f"transform({spans}, (k, n) -> concat(get(pieces, n), {tag_for('k.entity_type', style, tags)}))"
    rebuilt = let(
        "pieces",
        slices(text, kept),
        f"concat(array_join({tagged}, ''), get(pieces, size(pieces) - 1))",
    )
    only = let(
        "k",
        f"get({spans}, 0)",
        f"concat(substring({text}, 1, k.start), {tag_for('k.entity_type', style, tags)}, substring({text}, k.end + 1))",
    )
    return f"case when size({spans}) = 0 then {text} when size({spans}) = 1 then {only} else {rebuilt} end"

"""Leftovers in redacted text."""

from __future__ import annotations

import re

from quillmask.catalogue import GENERIC_TAG, REDACTION_TAG, Catalogue
from quillmask.functions.redaction import is_generic
from quillmask.functions.spans import is_plain, place
from quillmask.functions.sql import empty, flat, let, regex, struct, text as text_literal
from quillmask.operators.detection import hit_of

FINDINGS = "array<struct<start:int,end:int,text:string,label:string,scope:string>>"

# A match that is one tag and nothing else (blanks aside) is no leftover.
_ONLY_A_TAG = r"(?U)^\s*" + REDACTION_TAG[1:-1] + r"\s*$"


def findings_of(text: str, patterns, guards=None, only_if: dict[str, str] | None = None, plain: str | None = None) -> str:
    """Findings of some residual patterns, in pattern order, then text order.

    ``only_if`` holds an extra condition for some labels; ``plain`` names a column that is true only for plain texts.
    """

    def hit(p) -> str:
        return hit_of(text, p, {"label": text_literal(p.label)}, guards, plain or "plain", (only_if or {}).get(p.label))

    row = struct(start="m.start", end="m.end", text="m.text", label="h.label", scope="'output'")
    rows = (
        f"transform(filter({place('h.parts')}, m -> not (m.text rlike {regex(_ONLY_A_TAG)})), "
        f"m -> {row})"
    )
    hits = f"filter(array({', '.join(hit(p) for p in patterns)}), h -> h is not null)"
    hits = hits if plain else let("plain", is_plain(text), hits)
    return let("hs", hits, f"if(size(hs) = 0, {empty(FINDINGS)}, {flat(f'transform(hs, h -> {rows})')})")


def residual_findings(
    text: str,
    catalogue: Catalogue,
    changed: str | None = None,
    entity_types=(),
    threshold: float = 1.0,
    style: str = "",
    guards: dict | None = None,
    plain: str | None = None,
) -> str:
    """Findings of all residual patterns.

    ``changed`` tells whether anything was found in the cell, allowed or not. If
    a detector that was on has the pattern of a leftover, a cell in which
    nothing was found cannot hold that leftover and is not scanned again. ``guards`` are guard results
    on the original text, ``plain`` tells whether it is plain; they carry over as long as tags hold no digits.
    """
    on = [d for d in catalogue.active(entity_types, threshold) if d.score >= threshold]

    def covered(p) -> bool:
        return any(d.pattern == p.pattern and (d.ignore_case or not p.ignore_case) for d in on)

    tags = [GENERIC_TAG] if is_generic(style) else [GENERIC_TAG, *catalogue.tag_map.values()]
    plain_tags = all(re.match(REDACTION_TAG, t) for t in tags)
    only_if = {p.label: changed for p in catalogue.residual_patterns if changed and covered(p)}
    if not catalogue.residual_patterns:
        return empty(FINDINGS)
    return findings_of(text, catalogue.residual_patterns, guards if plain_tags else None, only_if, plain if plain_tags else None)

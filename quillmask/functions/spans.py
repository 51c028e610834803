"""Find every match of a pattern with its code-point offsets."""

from __future__ import annotations

import re
from collections.abc import Callable

from quillmask.functions.folds import scan
from quillmask.functions.sql import empty, flat, let, regex, struct

# Text kept before each match for the context check; longer look-backs are only
# taken when these characters hold too few words.
NEAR = 120
# Up to so many spans of a cell are placed, cut or compared one by one.
FEW = 8

INTERVALS = "array<struct<start:int,end:int>>"
MATCHES = "array<struct<start:int,end:int,text:string,lead:string>>"


# Escapes and flags by which a pattern of plain letters may yet mean or fold to other characters.
_BEYOND_ASCII = re.compile(r"\\[0xucNpPX]|\(\?[a-zA-Z]*[uU]")


def ascii_pattern(java_pattern: str) -> str | None:
    """The pattern without its Unicode flag, which finds the same in texts of plain ASCII and
    is tested much faster; None if that is not certain."""
    for flags, plain in (("(?iU)", "(?i)"), ("(?U)", "")):
        rest = java_pattern.removeprefix(flags)
        if rest != java_pattern:
            return plain + rest if rest.isascii() and not _BEYOND_ASCII.search(rest) else None
    return None


def folded(text: str) -> str:
    """The text in lower case, with every character that a case-insensitive pattern takes for an ASCII letter as that letter."""
    return f"if(octet_length({text}) = length({text}), lower({text}), lower(translate({text}, 'ſıİ\u212a', 'siik')))"


def is_plain(text: str) -> str:
    """True for texts of ASCII without the character that marks matches."""
    return f"(octet_length({text}) = length({text}) and not contains({text}, chr(0)))"


def occurs(text: str, java_pattern: str, plain: str | None = None, quick: str | None = None) -> str:
    """True if the pattern occurs. ``plain`` names a variable with :func:`is_plain`, ``quick`` is a pattern
    that finds the same in such texts, by default :func:`ascii_pattern`."""
    quick, whole = quick or ascii_pattern(java_pattern), f"{text} rlike {regex(java_pattern)}"
    return whole if quick is None else f"if({plain or is_plain(text)}, {text} rlike {regex(quick)}, {whole})"


def _marked(text: str, pattern: str, mark: str) -> str:
    return f"regexp_replace({text}, {regex(pattern)}, concat({mark}, '$0', {mark}))"


def _whole_parts(text: str, java_pattern: str) -> str:
    own = f"concat(chr(1), md5({text}), chr(2))"
    mark = f"if(contains({text}, chr(0)), {own}, chr(0))"
    return let("mk", mark, f"split({_marked(text, java_pattern, 'mk')}, mk, -1)")


def parts(text: str, java_pattern: str, plain: str | None = None, quick: str | None = None) -> str:
    """The text between matches and the matches by turns; only the text if nothing matches.

    One search marks all matches, and splitting at one plain character is cheap,
    where splitting at a regex compiles it per row. A text that holds that
    character gets a mark of its own, its digest, which it cannot hold.
    """
    quick, whole = quick or ascii_pattern(java_pattern), _whole_parts(text, java_pattern)
    if quick is None:
        return whole
    return f"if({plain or is_plain(text)}, split({_marked(text, quick, 'chr(0)')}, chr(0), -1), {whole})"


def if_found(text: str, java_pattern: str, plain: str, found: Callable[[str], str]) -> str:
    """``found`` of the :func:`parts` of a text, null if nothing matches. A plain text is searched once."""
    quick = ascii_pattern(java_pattern)
    whole = f"if({text} rlike {regex(java_pattern)}, {found(_whole_parts(text, java_pattern))}, null)"
    if quick is None:
        return whole
    once = let("mk", _marked(text, quick, "chr(0)"), f"if(contains(mk, chr(0)), {found('split(mk, chr(0), -1)')}, null)")
    return f"if({plain}, {once}, {whole})"


def place(by_turns: str) -> str:
    """Matches as ``array<struct<start,end,text,lead>>`` in text order, from :func:`parts`.

    Offsets are running lengths of matches and the texts between them, so no
    position is searched for. ``lead`` is what directly precedes the match.
    """
    only = struct(
        start="length(get(pt, 0))",
        end="length(get(pt, 0)) + length(get(pt, 1))",
        text="get(pt, 1)",
        lead=f"right(get(pt, 0), {NEAR})",
    )
    pair = struct(
        text="get(pt, i)", gap="length(get(pt, i - 1))", len="length(get(pt, i))", near=f"right(get(pt, i - 1), {NEAR})"
    )
    pairs = f"transform(sequence(1, size(pt) - 2, 2), i -> {pair})"

    def step(st: str, x: str) -> tuple[str, str]:
        start = f"{st}.pos + {x}.gap"
        end = f"{start} + {x}.len"
        row = struct(
            start=start, end=end, text=f"{x}.text", lead=f"right(concat({st}.tail, {x}.near), {NEAR})"
        )
        tail = f"right(concat({st}.tail, {x}.near, {x}.text), {NEAR})"
        return struct(pos=end, tail=tail), f"array({row})"

    several = scan(pairs, struct(pos="0", tail="''"), MATCHES, step)
    one = struct(start="length(pre)", end="length(pre) + length(get(pt, i))", text="get(pt, i)", lead=f"right(pre, {NEAR})")
    few = f"transform(sequence(1, size(pt) - 2, 2), i -> {let('pre', 'array_join(slice(pt, 1, i), ' + chr(39) * 2 + ')', one)})"
    return let("pt", by_turns, f"case when size(pt) = 3 then array({only}) when size(pt) <= {2 * FEW + 1} then {few} else {several} end")


def find_matches(text: str, java_pattern: str, plain: str | None = None, quick: str | None = None) -> str:
    """All matches of one pattern in a text."""
    search = (text, java_pattern, plain, quick)
    return f"if({occurs(*search)}, {place(parts(*search))}, {empty(MATCHES)})"


def slices(text: str, intervals: str) -> str:
    """Texts of many intervals in start order.

    ``substring`` walks the text from its beginning, so slicing a long text n
    times would be quadratic. Cutting one segment per block of intervals first
    keeps the walk inside a segment short.
    """
    per = 64
    segment = struct(
        base="get(ch, 0).start",
        text=f"substring({text}, get(ch, 0).start + 1, array_max(transform(ch, q -> q.end)) - get(ch, 0).start)",
    )
    cut = let(
        "sg",
        segment,
        "transform(ch, q -> substring(sg.text, q.start - sg.base + 1, greatest(q.end - q.start, 0)))",
    )
    per_block = let("ch", f"slice(iv, c * {per} + 1, {per})", cut)
    every = flat(f"transform(sequence(0, cast((size(iv) - 1) div {per} as int)), c -> {per_block})")
    one = f"transform(iv, q -> substring({text}, q.start + 1, greatest(q.end - q.start, 0)))"
    return let("iv", intervals, f"if(size(iv) <= {FEW}, {one}, {every})")

"""Proper nouns of the original text that no redacted span covers."""

from __future__ import annotations

from quillmask.catalogue import MISSED_NAME_LABEL, WORD
from quillmask.functions.folds import scan
from quillmask.functions.spans import FEW, INTERVALS, NEAR, find_matches, slices
from quillmask.functions.sql import empty, let, regex, struct, text as text_literal
from quillmask.operators.residual import FINDINGS

TOKENS = "array<struct<start:int,end:int,text:string,pos:string>>"

_W = WORD[1:-2]
_GAP = rf"[^{_W}.!?\r\n]"
# Without a tagger a capitalised word counts as a proper noun unless a sentence
# starts with it: some word must precede it with no sentence end in between.
# The search looks for capitals and then back over at most four characters;
# longer gaps are settled afterwards on the text before the word.
CAPITALISED = rf"\p{{Lu}}(?<=[{_W}]{_GAP}{{1,3}}\p{{Lu}}|{_GAP}{{4}}\p{{Lu}})[{_W}]*"
# The same for texts of plain ASCII.
ASCII_CAPITALISED = CAPITALISED.replace(_W, "A-Za-z0-9_").replace(r"\p{Lu}", "[A-Z]")
_MID_SENTENCE = rf"[{_W}]{_GAP}+\z"


_CAPITAL = regex(r"^\p{Lu}")


def _name_like(word: str, allow_list) -> str:
    """Is no longer all-capital word and not allowed."""
    lower = regex(r"[\p{Ll}\p{Lt}]")
    shape = f"(length({word}) = 1 or {word} rlike {lower})"
    if not allow_list:
        return f"({shape})"
    words = ", ".join(text_literal(w) for w in allow_list)
    return f"({shape} and {word} not in ({words}))"


def guessed_tokens(text: str, allow_list, plain: str | None = None) -> str:
    """Name-like words by capitalisation alone; the pronoun "I" is left out."""
    mid, only_gap = regex(_MID_SENTENCE), regex(rf"^{_GAP}*\z")
    within = (
        f"(right(t.lead, 4) rlike {mid} or t.lead rlike {mid} or (t.start > {NEAR} and t.lead rlike {only_gap} "
        f"and substring({text}, 1, t.start) rlike {mid}))"
    )
    return (
        f"filter({find_matches(text, CAPITALISED, plain, ASCII_CAPITALISED)}, "
        f"t -> t.text <> 'I' and {_name_like('t.text', allow_list)} and {within})"
    )


def tagged_tokens(tokens: str, allow_list) -> str:
    """Name-like words among the proper nouns of an annotation column."""
    return (
        f"filter(coalesce({tokens}, {empty(TOKENS)}), "
        f"t -> t.pos = 'PROPN' and t.text rlike {_CAPITAL} and {_name_like('t.text', allow_list)})"
    )


def uncovered_runs(names: str, targets: str) -> str:
    """Intervals of neighbouring names that lie inside no target.

    One sorted walk over targets and names: a name is covered exactly if some
    target that starts no later reaches its end; a few are compared with one another first. Uncovered names at most one
    character apart are joined.
    """
    few = f"size({names}) * size({targets}) <= {FEW * FEW}"
    open_ = f"filter({names}, n -> not exists({targets}, k -> k.start <= n.start and k.end >= n.end))"
    lone = struct(start="cast(get(left, 0).start as int)", end="cast(get(left, 0).end as int)")
    short = f"case when size(left) = 0 then {empty(INTERVALS)} when size(left) = 1 then array({lone}) else {_runs('left', empty(INTERVALS))} end"
    return f"if({few}, {let('left', open_, short)}, {_runs(names, targets)})"


def _runs(names: str, targets: str) -> str:
    """:func:`uncovered_runs` by the walk."""
    target = struct(start="k.start", kind="0", end="k.end")
    mark = struct(start="cast(k.start as int)", kind="1", end="cast(k.end as int)")
    marks = f"sort_array(concat(transform({targets}, k -> {target}), transform({names}, k -> {mark})))"

    def pending(st: str) -> str:
        run = struct(start=f"{st}.since", end=f"{st}.upto")
        return f"if({st}.since >= 0, array({run}), {empty(INTERVALS)})"

    def step(st: str, x: str) -> tuple[str, str]:
        idle = f"({x}.kind = 0 or {x}.end <= {st}.reach)"
        joins = f"({st}.since >= 0 and {x}.start - {st}.upto <= 1)"
        after = struct(
            reach=f"if({x}.kind = 0, greatest({st}.reach, {x}.end), {st}.reach)",
            since=f"if({idle} or {joins}, {st}.since, {x}.start)",
            upto=f"if({idle}, {st}.upto, {x}.end)",
        )
        return after, f"if({idle} or {joins}, {empty(INTERVALS)}, {pending(st)})"

    return scan(marks, struct(reach="-1", since="-1", upto="-1"), INTERVALS, step, pending)


def model_labels(runs: str, entities: str) -> str:
    """Per run the label of the annotation with exactly its span, if any.

    Of several annotations with one span, the greatest label counts.
    """
    entity = struct(start="cast(k.start as int)", end="cast(k.end as int)", kind="0", label="k.label")
    run = struct(start="k.start", end="k.end", kind="1", label="cast(null as string)")
    marks = (
        f"sort_array(concat(transform(coalesce({entities}, "
        f"{empty('array<struct<start:int,end:int,label:string,score:double>>')}), k -> {entity}), "
        f"transform({runs}, k -> {run})))"
    )

    def step(st: str, x: str) -> tuple[str, str]:
        same = f"({st}.start = {x}.start and {st}.end = {x}.end)"
        after = f"if({x}.kind = 0, {struct(start=f'{x}.start', end=f'{x}.end', label=f'{x}.label')}, {st})"
        return after, f"if({x}.kind = 1, array(if({same}, {st}.label, null)), {empty('array<string>')})"

    zero = struct(start="-1", end="-1", label="cast(null as string)")
    return scan(marks, zero, "array<string>", step)


def missed_names(
    text: str, targets: str, allow_list, tokens: str | None = None, entities: str | None = None, plain: str | None = None
) -> str:
    """Findings for names outside all redacted spans; offsets refer to the original text."""
    names = guessed_tokens(text, allow_list, plain) if tokens is None else tagged_tokens(tokens, allow_list)
    plain = text_literal(MISSED_NAME_LABEL)
    if entities is None:
        labels = f"transform(runs, k -> {plain})"
    else:
        labels = (
            f"transform({model_labels('runs', entities)}, "
            f"k -> if(k is null, {plain}, concat({plain}, ' (model tagged ', k, ')')))"
        )
    row = struct(start="z.runs.start", end="z.runs.end", text="z.said", label="z.tagged", scope="'input'")
    rows = let(
        "said",
        slices(text, "runs"),
        let("tagged", labels, f"transform(arrays_zip(runs, said, tagged), z -> {row})"),
    )
    found = let("runs", uncovered_runs("ns", targets), rows)
    return let("ns", names, f"if(size(ns) = 0, {empty(FINDINGS)}, {found})")

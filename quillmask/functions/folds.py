"""Linear-time folds over arrays, as built-in higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from quillmask.functions.sql import empty, flat, let, struct

# A fold copies its whole accumulator at every step, so collecting n results in
# one fold is quadratic. Output is therefore collected per block only.
BLOCK = 64


def blocks(items: str, size: int = BLOCK) -> str:
    """Cut an array into consecutive arrays of at most ``size`` elements."""
    return (
        f"transform(sequence(0, cast((greatest(size({items}), 1) - 1) div {size} as int)), "
        f"b -> slice({items}, b * {size} + 1, {size}))"
    )


def scan(
    items: str,
    state: str,
    out_type: str,
    step: Callable[[str, str], tuple[str, str]],
    finish: Callable[[str], str] | None = None,
) -> str:
    """Left fold that collects output.

    ``step(state, item)`` gives the next state and an array of rows to emit;
    ``finish(state)`` may emit a last array. The result has type ``out_type``.
    """
    next_state, emitted = step("acc.state", "x")
    one = f"(acc, x) -> {struct(state=next_state, out=f'concat(acc.out, {emitted})')}"

    def ending(st: str) -> list[str]:
        return [] if finish is None else [finish(st)]

    short_end = f"concat({', '.join(['acc.out', *ending('acc.state')])})"
    short = f"aggregate(it, {struct(state=state, out=empty(out_type))}, {one}, acc -> {short_end})"

    # Long arrays take two passes: the state at the start of every block, then
    # the output of each block from its state.
    skip = f"aggregate(block, get(sts, size(sts) - 1), (st, x) -> {step('st', 'x')[0]})"
    states = f"aggregate({blocks('it')}, array({state}), (sts, block) -> concat(sts, array({skip})))"
    block_out = f"aggregate(block, {struct(state='s0', out=empty(out_type))}, {one}, acc -> acc.out)"
    outs = flat(f"zip_with({blocks('it')}, slice(sts, 1, size(sts) - 1), (block, s0) -> {block_out})")
    long = let("sts", states, f"concat({', '.join([outs, *ending('get(sts, size(sts) - 1)')])})")
    return let("it", items, f"if(size(it) <= {BLOCK}, {short}, {long})")

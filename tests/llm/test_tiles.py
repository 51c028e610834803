"""Blocks meet in tiles, each pair once; searches that are bounded by what was met before."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmask.llm import blocks, topk
from quillmask.llm.common import Scratch


def packed_rows(spark, per_block, n=300):
    rows = [(i, i, "abc"[i % 3], [i % 7, 1] if i % 10 else [i], 2 if i % 10 else 1) for i in range(n)]
    df = spark.createDataFrame(rows, "row long, vec_id long, label string, v array<long>, dim int")
    scratch = Scratch(spark)
    return scratch.stored(blocks.packed(blocks.in_lots(df, df.selectExpr("dim", "2 AS lots").distinct()), per_block)), rows


@pytest.mark.parametrize("same_lot", [False, True])
@pytest.mark.parametrize("across,down", [(1, 1), (3, 2), (99, 99)])
def test_every_pair_meets_once(spark, monkeypatch, same_lot, across, down):
    monkeypatch.setattr(blocks, "TILE_QUERIES", across)
    monkeypatch.setattr(blocks, "TILE_BLOCKS", down)
    monkeypatch.setattr(blocks, "WAVES", 1e-9)  # tiles as large as they may be
    lists, rows = packed_rows(spark, 16)
    queries, _ = packed_rows(spark, 5)

    def read(asked, there):
        for block in there:
            for own in asked:
                yield pa.RecordBatch.from_pydict({"q": np.repeat(own.row, len(block.row)), "r": np.tile(block.row, len(own.row))})

    met = blocks.meetings(queries, lists, read, "q bigint, r bigint", same_lot)
    found = Counter((r.q, r.r) for r in met.collect())
    label, dim = {r[0]: r[2] for r in rows}, {r[0]: r[4] for r in rows}
    lot = {r.label: r.lot for r in blocks.in_lots(spark.createDataFrame(rows, "row long, vec_id long, label string, v array<long>, dim int"), spark.createDataFrame([(1, 2), (2, 2)], "dim int, lots int")).collect()}
    want = Counter((a, b) for a in dim for b in dim if dim[a] == dim[b] and (not same_lot or lot[label[a]] == lot[label[b]]))
    assert found == want
    tiles = blocks.tiles(queries, lists, same_lot)
    if across == 99:  # a block is copied for each group it meets, not for each block
        assert tiles.count() == queries.count() + lists.count()
    plan = tiles._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "tile" in plan


def test_the_best_of_each_group():
    random = np.random.default_rng(5)
    best, every = blocks.Best(6, 4), []
    for _ in range(9):
        group, vec_id, score = random.integers(0, 5, 20), random.integers(0, 50, 20), random.integers(-3, 4, 20)
        best.add(group, vec_id, score)
        every += list(zip(group.tolist(), (-score).tolist(), vec_id.tolist()))
        want = [r for g in range(6) for r in sorted(x for x in every if x[0] == g)[:4]]
        assert list(zip(best.group.tolist(), (-best.score).tolist(), best.vec_id.tolist())) == want
        for g in range(6):
            own = [-r[1] for r in want if r[0] == g]
            assert best.bar[g] == (own[3] if len(own) == 4 else -np.inf)


@pytest.mark.parametrize("scale", [1, 2**10, 2**24, 2**27])
@pytest.mark.parametrize("step", [8, 64, 9999])
def test_bounds_of_earlier_blocks_lose_no_neighbour(scale, step):
    """Ties across blocks, clusters, and values exact in short, in long or in no floating point."""
    random = np.random.default_rng(6)
    x = random.integers(-9, 9, (900, 6)) * scale + random.integers(0, 2, (900, 6))
    x[100:160], x[400:460] = x[0], x[0]

    def block(rows):
        ids = np.asarray(rows, np.int64)
        return blocks.Block(6, len(ids), ids.tobytes(), ids.tobytes(), [""] * len(ids), None, "<i8", x[ids].astype(np.int64).tobytes())

    own = block(range(0, 900, 45))
    best = blocks.Best(len(own.row), 20)
    for i in range(0, 900, 300):
        best.add(*topk.Lists(block(range(i, i + 300))).found(own, 20, best.bar, step))
    for g, i in enumerate(own.row):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(900) if j != i)[:20]
        at = best.group == g
        assert list(zip((-best.score[at]).tolist(), best.vec_id[at].tolist())) == want

"""Tiled accumulation and labelling against plain walks and floods, with tiles from tiny to larger than the grid."""

import numpy as np
import pytest

from cellscape.operators import grid, tiles

STEPS8 = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def flooded(cells, steps):
    zone = {}
    for start in sorted(cells):
        if start not in zone:
            zone[start], todo = start[0] * tiles.WIDE + start[1], [start]
            while todo:
                r, c = todo.pop()
                for dr, dc in steps:
                    n = (r + dr, c + dc)
                    if n in cells and n not in zone:
                        zone[n] = zone[start]
                        todo.append(n)
    return zone


@pytest.mark.parametrize(("tile", "connectivity"), [(4, 8), (5, 4), (64, 8)])
def test_zones_equal_a_flood(spark, tile, connectivity):
    rng = np.random.default_rng(tile)
    cells = {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((23, 31)) < 0.45), strict=True)} | {(r, 30 if r % 4 else c) for r in range(40, 60) for c in range(31)}
    df = spark.createDataFrame([(r, c, f"k{r}", c) for r, c in sorted(cells)], "row int, col int, k string, zone_rank int").repartition(3)
    for local in (None, 0):
        got = {(r.row, r.col): r.zone for r in tiles.zones(df, connectivity, ["k"], tile, local).collect()}
        assert got == flooded(cells, STEPS8 if connectivity == 8 else [(0, 1), (1, 0), (0, -1), (-1, 0)])
    assert tiles.zones(df.limit(0), connectivity, ["k"], tile).count() == 0


def walked(to):
    acc = dict.fromkeys(to, 0)
    for at in to:
        while at is not None:
            acc[at] += 1
            at = to[at]
    return acc


@pytest.mark.parametrize(("tile", "local_nodes"), [(3, 0), (3, 10**6), (8, 10**6), (300, 10**6)])
def test_accumulation_equals_walks(spark, tile, local_nodes):
    rng = np.random.default_rng(1)
    elevation = rng.random((19, 26))
    to = {}
    for r in range(19):
        for c in range(26):
            lower = [(elevation[r + a, c + b], (r + a, c + b)) for a, b in STEPS8 if 0 <= r + a < 19 and 0 <= c + b < 26 and elevation[r + a, c + b] < elevation[r, c]]
            to[(r, c)] = min(lower)[1] if lower and rng.random() < 0.97 else None
    snake = [(r, c if r % 2 else 20 - c) for r in range(30, 40) for c in range(21)]  # one path through many tiles, back and forth
    to |= dict(zip(snake, [*snake[1:], None], strict=True))
    df = spark.createDataFrame([(r, c, *(t or (None, None))) for (r, c), t in to.items()], "row int, col int, to_row int, to_col int").repartition(4)
    assert {(r.row, r.col): r.acc for r in tiles.flow_accumulation(df, tile, local_nodes).collect()} == walked(to)


def test_accumulation_of_nothing_and_of_a_cycle(spark):
    schema = "row int, col int, to_row int, to_col int"
    assert tiles.flow_accumulation(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="cycle"):
        tiles.flow_accumulation(spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 0)], schema)).collect()


def test_weights_of_pointers(spark):
    got = grid.flow_accumulation(spark.createDataFrame([(1, 2, 5), (2, 3, 7), (3, None, 1), (4, 3, 10)], "id long, to long, acc long"))
    assert {r.id: r.acc for r in got.collect()} == {1: 5, 2: 12, 3: 23, 4: 10}

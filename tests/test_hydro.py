"""Drainage against NumPy and heap versions."""

import heapq

import numpy as np
import pytest
from test_terrain import cells, grid_of

from oroflow.operators import channels, graph, grid, hydro
from oroflow.plans.scratch import written


def flood(z):
    rows, cols = z.shape
    out, heap, done = np.full(z.shape, np.inf), [], np.zeros(z.shape, bool)
    for r in range(rows):
        for c in range(cols):
            if r in (0, rows - 1) or c in (0, cols - 1):
                heapq.heappush(heap, (z[r, c], r, c))
                out[r, c] = z[r, c]
    while heap:
        v, r, c = heapq.heappop(heap)
        if done[r, c]:
            continue
        done[r, c] = True
        for dr, dc in grid.D8_STEPS:
            a, b = r + dr, c + dc
            if 0 <= a < rows and 0 <= b < cols and max(v, z[a, b]) < out[a, b]:
                out[a, b] = max(v, z[a, b])
                heapq.heappush(heap, (out[a, b], a, b))
    return out


def test_fill(spark):
    z = np.random.default_rng(1).integers(0, 12, (14, 12)).astype(float)
    assert np.array_equal(grid_of(hydro.fill_depressions(cells(spark, z)), "z", z.shape), flood(z))


@pytest.fixture(params=[(8, 3), (2, 1)])
def blocks(request, monkeypatch):
    """One block, and blocks of 4 x 4 cells in groups of 2 x 2."""
    monkeypatch.setattr(graph, "BLOCK_BITS", request.param[0])
    monkeypatch.setattr(hydro, "GROUP_BITS", request.param[1])


def test_fill_across_blocks(spark, blocks):
    z = np.random.default_rng(7).integers(0, 15, (21, 23)).astype(float)
    assert np.array_equal(grid_of(hydro.fill_depressions(cells(spark, z)), "z", z.shape), flood(z))
    z[3:6, 3:6] = np.nan  # a ring of walls around one cell
    z[4, 4] = 1.0
    got = grid_of(hydro.fill_depressions(cells(spark, z)), "z", z.shape)
    assert got[4, 4] == 1.0 and (got[~np.isnan(z)] >= z[~np.isnan(z)]).all()


def test_ways_and_areas_across_blocks(spark, blocks):
    rng = np.random.default_rng(8)
    z = rng.permutation(18 * 19).reshape(18, 19).astype(float)
    directed = hydro.d8(cells(spark, z))
    code = grid_of(directed, "d8", z.shape).astype(int)
    acc, longest = np.ones(z.shape), np.zeros(z.shape)
    root, down = {}, {}
    for r, c in sorted(np.ndindex(z.shape), key=lambda p: -z[p]):
        if code[r, c] >= 0:
            dr, dc = grid.D8_STEPS[code[r, c]]
            acc[r + dr, c + dc] += acc[r, c]
            longest[r + dr, c + dc] = max(longest[r + dr, c + dc], longest[r, c] + np.hypot(dr, dc))
    for r, c in sorted(np.ndindex(z.shape), key=lambda p: z[p]):
        if code[r, c] < 0:
            root[r, c], down[r, c] = (r, c), 0.0
        else:
            dr, dc = grid.D8_STEPS[code[r, c]]
            root[r, c], down[r, c] = root[r + dr, c + dc], down[r + dr, c + dc] + np.hypot(dr, dc)
    assert np.array_equal(grid_of(hydro.flow_accumulation(directed), "accumulation", z.shape), acc)
    for x in hydro.flow_length(directed).collect():
        at = x["r"], x["c"]
        assert (x["root_r"], x["root_c"]) == root[at] and abs(x["downslope"] - down[at] * hydro.CELL) < 1e-3 and abs(x["upslope"] - longest[at] * hydro.CELL) < 1e-3
    starts = [(i, int(r), int(c)) for i, (r, c) in enumerate(rng.integers(0, 18, (6, 2)))]
    got = {(x["p"], x["step"]): (x["r"], x["c"], x["distance_m"]) for x in hydro.trace(directed, cells(spark, z), spark.createDataFrame(starts, "p int, r int, c int")).collect()}
    want = {}
    for p, r, c in starts:
        d, step = 0.0, 0
        while True:
            want[p, step] = (r, c, round(d * hydro.CELL, 4))
            if code[r, c] < 0:
                break
            dr, dc = grid.D8_STEPS[code[r, c]]
            r, c, d, step = r + dr, c + dc, d + np.hypot(dr, dc), step + 1
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    kinds = rng.integers(0, 2, z.shape)
    label = {}
    for at in np.ndindex(z.shape):
        if at not in label:
            todo = [at]
            while todo:
                x = todo.pop()
                if x in label:
                    continue
                label[x] = at
                todo += [(x[0] + a, x[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= x[0] + a < 18 and 0 <= x[1] + b < 19 and kinds[x[0] + a, x[1] + b] == kinds[x]]
    found = hydro.clump(cells(spark, kinds * 100.0)).collect()
    assert {(x["r"], x["c"]): x["comp"] for x in found} == {k: (v[0] << 32) + v[1] for k, v in label.items()}


def test_costs_across_blocks(spark, blocks):
    z = np.random.default_rng(9).integers(0, 30, (13, 17)).astype(float)
    best = np.full(z.shape, np.inf)
    heap = [(0.0, 2, 3), (0.0, 11, 15)]
    while heap:
        d, r, c = heapq.heappop(heap)
        if d >= best[r, c]:
            continue
        best[r, c] = d
        for dr, dc in grid.D8_STEPS:
            a, b = r + dr, c + dc
            if 0 <= a < 13 and 0 <= b < 17:
                heapq.heappush(heap, (d + abs(z[r, c] - z[a, b]) * np.hypot(dr, dc), a, b))
    got = grid_of(hydro.cost_distance(cells(spark, z), spark.createDataFrame([(2, 3), (11, 15)], "r int, c int")), "cost", z.shape)
    assert np.allclose(got, best, atol=1e-3)


def test_accumulation_of_a_plane(spark):
    z = np.array([[(6 - r) * 10 + (5 - c) * 1.0 for c in range(6)] for r in range(7)])
    directed = hydro.d8(cells(spark, z))
    acc = grid_of(hydro.flow_accumulation(directed), "accumulation", z.shape)
    code = grid_of(directed, "d8", z.shape).astype(int)
    want = np.ones(z.shape)
    for r, c in sorted(np.ndindex(z.shape), key=lambda p: -z[p]):
        if code[r, c] >= 0:
            dr, dc = grid.D8_STEPS[code[r, c]]
            want[r + dr, c + dc] += want[r, c]
    assert np.array_equal(acc, want) and acc[code < 0].sum() == z.size


def test_strahler(spark):
    edges = [(1, 5), (2, 5), (3, 6), (4, 6), (5, 7), (6, 7), (7, 8), (9, 8), (8, None)]
    n_in = {b: sum(y == b for _, y in edges) for _, b in edges}
    net = spark.createDataFrame([(a, b, 1.0, n_in.get(a, 0)) for a, b in edges], "id long, parent long, len double, n_in int")
    got = {r["c"]: r["stream_order"] for r in hydro.stream_order(net).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 3, 9: 1, 8: 3}


def test_descend_and_components(spark):
    edges = spark.createDataFrame([(i, i + 1 if i < 20 else None, 2.0) for i in range(21)], "id long, parent long, len double")
    got = {r["id"]: (r["root"], r["distance"]) for r in graph.descend(edges).collect()}
    assert got == {i: (20, 2.0 * (20 - i)) for i in range(21)}
    comp = graph.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"), spark.range(0, 12)).collect()
    assert {r["id"]: r["comp"] for r in comp} == {i: 0 if i < 10 else i for i in range(12)}


def test_cost_and_sinks(spark):
    z = np.full((5, 5), 10.0)
    out = grid_of(hydro.cost_distance(cells(spark, z), spark.createDataFrame([(0, 0)], "r int, c int"), by_slope=False), "cost", z.shape)
    assert abs(out[4, 4] - 4 * 2**0.5) < 1e-3 and out[0, 3] == 3
    z[2, 2] = 4
    sinks = hydro.depression_stats(cells(spark, z)).collect()
    assert [(r["sink_r"], r["sink_c"], r["n_cells"], r["max_depth"], r["spill"]) for r in sinks] == [(2, 2, 1, 6.0, 10.0)]


def test_breached_terrain_drains_and_is_carved_only(spark):
    z = np.random.default_rng(5).integers(0, 9, (8, 9)).astype(float)
    got = grid_of(channels.breach_depressions(cells(spark, z), max_depth=100.0), "z", z.shape)
    assert (got <= z).all() and np.array_equal(flood(got), got)


def test_breached_flats_against_brute_force(spark, monkeypatch):
    """Wide flats over several blocks: ways, and so the carved heights, cell by cell."""
    monkeypatch.setattr("oroflow.operators.graph.BLOCK_BITS", 2)
    z = np.random.default_rng(6).integers(0, 3, (11, 13)).astype(float)
    z[4:8, 3:10] = 0.0
    filled, steps, parent = flood(z), {}, {}
    inside = lambda r, c: 0 <= r < z.shape[0] and 0 <= c < z.shape[1]
    around = lambda r, c: [(k, (r + dr, c + dc)) for k, (dr, dc) in enumerate(grid.D8_STEPS) if inside(r + dr, c + dc)]
    for at in np.ndindex(z.shape):
        falls = [((filled[at] - filled[to]) / (1.0 if k % 2 == 0 else 2**0.5), -k, to) for k, to in around(*at) if filled[to] < filled[at]]
        if falls:
            parent[at] = max(falls)[2]
        if falls or 0 in at or at[0] == z.shape[0] - 1 or at[1] == z.shape[1] - 1:
            steps[at] = 0
    for n in range(z.size):
        for at in np.ndindex(z.shape):
            if at not in steps and (to := [x for _, x in around(*at) if steps.get(x) == n and filled[x] == filled[at]]):
                steps[at], parent[at] = n + 1, to[0]
    assert len(steps) == z.size and max(steps.values()) > 2
    low = z.copy()
    for start in np.ndindex(z.shape):
        at = start
        while at in parent:
            at = parent[at]
            low[at] = min(low[at], z[start])
    got = grid_of(channels.breach_depressions(cells(spark, z), max_depth=1.0), "z", z.shape)
    assert np.array_equal(got, np.maximum(low, z - 1.0))


def test_section_and_burnt_stream(spark):
    z = np.array([[9.0, 5.0, 1.0, 4.0, 9.0]] * 5) + np.arange(5)[:, None] * -0.1
    directed = hydro.d8(cells(spark, z))
    row = channels.cross_sections(cells(spark, z), directed, spark.createDataFrame([(1, 2, 2)], "p int, r int, c int"), 2).first()
    assert (row["left"], row["right"], round(row["bank_z"], 6)) in {(-1, 1, 3.8)} and row["max_depth"] > 2.9
    streams = channels.stream_cells(cells(spark, z), hydro.flow_accumulation(directed), 5)
    burnt = grid_of(channels.burn_streams(cells(spark, z), streams), "z", z.shape)
    assert burnt[:, 2].min() == z[:, 2].min() and (burnt <= z).all()


def broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_rasters_are_not_broadcast(spark):
    """Files of cells are small beside what they hold; an index joins two whole rasters."""
    z = np.random.default_rng(8).integers(0, 50, (9, 9)).astype(float)
    ground = cells(spark, z)
    acc = written(hydro.flow_accumulation(hydro.d8(ground)), "acc")
    assert not any(broadcasts(hydro.index(ground, acc, name)) for name in hydro.INDICES)
    assert not broadcasts(acc.join(ground, ["r", "c"]))


def test_breached_terrain_is_not_broadcast(spark):
    z = np.random.default_rng(9).integers(0, 5, (6, 6)).astype(float)
    assert not broadcasts(channels.breach_depressions(cells(spark, z)))


def test_costs_down_a_strip_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "BLOCK_BITS", 2)
    monkeypatch.setattr(hydro, "written", lambda df, name, *by: rounds.append(name) or written(df, name, *by))
    z = np.repeat(np.arange(160.0)[:, None], 4, axis=1)
    got = grid_of(hydro.cost_distance(cells(spark, z), spark.createDataFrame([(0, 1)], "r int, c int")), "cost", z.shape)
    assert np.array_equal(got, z) and rounds.count("cost") <= 6

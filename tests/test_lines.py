"""Lines and rings against small fixtures, with blocks made small so that lines cross many."""

import random

import pytest

from oroflow.operators import graph, grid, hydro, lines
from oroflow.plans.scratch import written


@pytest.fixture(params=[2])
def bits(request, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_BITS", request.param)
    return request.param


def walk(nxt, k):
    """Lines of pieces {e: nxt} by hand: {e: (line, seq, n, closed)}."""
    out, targets = {}, set(nxt.values())
    for start in [e for e in sorted(nxt) if e not in targets] + sorted(nxt):
        if (k, start) in out:
            continue
        way = [start]
        while nxt[way[-1]] in nxt and nxt[way[-1]] != start:
            way.append(nxt[way[-1]])
        closed = nxt[way[-1]] == start
        out |= {(k, e): (start, i, len(way), closed) for i, e in enumerate(way)}
    return out


def test_chain_of_paths_and_rings(spark, bits):
    """Random paths and rings of all lengths, their pieces strewn over blocks."""
    rng = random.Random(4)
    rows, expected, e = [], {}, 0
    for k in (0, -3, 7):
        nxt = {}
        for n in [1, 1, 2, 3, 5, 8, 40, 41, 64, 150]:
            ids = rng.sample(range(e, e + n), n)
            e += n
            ring = rng.random() < 0.5
            nxt |= dict(zip(ids, ids[1:] + ([ids[0]] if ring else [10**9 + e]), strict=True))
        expected |= walk(nxt, k)
        rows += [(k, a, b, rng.randrange(bits * 3), rng.randrange(2)) for a, b in nxt.items()]
    rng.shuffle(rows)
    got = lines.chain(spark.createDataFrame(rows, "k long, e long, nxt long, br int, bc int"))
    assert {(r["k"], r["e"]): (r["line"], r["seq"], r["n_pieces"], r["closed"]) for r in got.collect()} == expected
    assert lines.chain(spark.createDataFrame([], "k long, e long, nxt long, br int, bc int")).count() == 0


def cone(spark, n):
    rows = [(r, c, 100.0 - 10 * max(abs(r - n // 2), abs(c - n // 2))) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "r int, c int, z double")


def test_contours_of_a_cone_are_rings(spark, bits):
    got = written(lines.contour_lines(cone(spark, 21), 24.0), "cone")
    strings = {r["level"]: r for r in lines.line_strings(got).collect()}
    assert sorted(strings) == [24.0, 48.0, 72.0, 96.0] and got.filter("not closed").isEmpty() and got.select("line").distinct().count() == 4
    areas = []
    for level, r in sorted(strings.items()):
        at = [(p["y"], p["x"]) for p in r["coordinates"]]
        assert at[0] == at[-1] and len(at) == 1 + got.filter(f"level = {level}").count()
        areas.append(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(at, at[1:], strict=False)) / 2)
    reach = [(100 - level) / 10 for level in sorted(strings)]  # squares but for their cut corners
    assert all(abs(abs(a) - 4 * d * d) < 4 and a * areas[0] > 0 for a, d in zip(areas, reach, strict=True))


def test_contours_meet_end_to_end(spark, bits):
    """On noise with gaps, at levels that corners have exactly: consecutive segments share their ends, every segment is in
    one line once."""
    rng = random.Random(9)
    rows = [(r, c, float(rng.randrange(0, 5) * 10)) for r in range(17) for c in range(15) if rng.random() > 0.04]
    cells = spark.createDataFrame(rows, "r int, c int, z double")
    got = lines.contour_lines(cells, 10.0).toPandas().sort_values(["level", "line", "seq"])
    for _, line in got.groupby(["level", "line"]):
        assert line["seq"].tolist() == list(range(len(line))) and (line["n_pieces"] == len(line)).all()
        ends, starts = line[["y2", "x2"]].to_numpy(), line[["y1", "x1"]].to_numpy()
        assert (ends[:-1] == starts[1:]).all()
        if line["closed"].iloc[0]:
            assert (ends[-1] == starts[0]).all()
    assert len(got) == lines.contour_pieces(cells, 10.0).count()


def test_rings_of_areas(spark, bits):
    """Labels strewn at random, areas that touch in corners, holes, missing cells: ring areas add up to the cells."""
    rng = random.Random(2)
    marked = {(r, c): rng.choice([1, 1, 2, 3]) for r in range(13) for c in range(11) if rng.random() > 0.2}
    cells = spark.createDataFrame([(r, c, p) for (r, c), p in marked.items()] + [(50, 50, None)], "r int, c int, p long")
    rings = lines.area_rings(cells)
    got = lines.ring_summary(rings).toPandas()
    for p in (1, 2, 3):
        own = {k for k, v in marked.items() if v == p}
        assert got.loc[got["p"] == p, "area"].sum() == len(own)
        areas, seen = 0, set()
        for start in own:  # 4-connected areas by hand: one outer ring each
            if start in seen:
                continue
            areas, todo = areas + 1, [start]
            while todo:
                r, c = todo.pop()
                if (r, c) in own and (r, c) not in seen:
                    seen.add((r, c))
                    todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        assert (got.loc[got["p"] == p, "area"] > 0).sum() == areas
        sides = sum((r + a, c + b) not in own for r, c in own for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert got.loc[got["p"] == p, "n_pieces"].sum() == sides
    ordered = rings.toPandas().sort_values(["p", "line", "seq"])
    for _, ring in ordered.groupby(["p", "line"]):
        ends, starts = ring[["y2", "x2"]].to_numpy(), ring[["y1", "x1"]].to_numpy()
        assert (ends == list(starts[1:]) + [starts[0]]).all()


def test_ring_with_a_hole(spark):
    cells = spark.createDataFrame([(r, c, 5) for r in range(5) for c in range(5) if (r, c) != (2, 2)], "r int, c int, p long")
    assert sorted(r["area"] for r in lines.ring_summary(lines.area_rings(cells)).collect()) == [-1.0, 25.0]


def test_streams_and_stems(spark):
    """A valley with side valleys: every stream cell is in one stretch; the stem goes up where most cells drain through."""
    rows = [(r, c, float(100 * abs(c - 6) + 3 * r + (0 if r % 4 else -1) * min(abs(c - 6), 1) * 40)) for r in range(25) for c in range(13)]
    directed = hydro.d8(spark.createDataFrame(rows, "r int, c int, z double"))
    acc = hydro.flow_accumulation(directed)
    network = hydro.stream_network(directed, acc, 4)
    got = lines.stream_lines(network).toPandas().sort_values(["link_r", "link_c", "seq"])
    inner = got[got["seq"] < got["n_cells"]]
    assert not inner.duplicated(["r", "c"]).any() and len(inner) == network.count()
    for _, line in got.groupby(["link_r", "link_c"]):
        steps = line[["r", "c"]].diff().iloc[1:].abs()
        assert (steps.max(axis=1) == 1).all() and line["seq"].tolist() == list(range(len(line)))
    size = {(r["r"], r["c"]): r["accumulation"] for r in acc.collect()}
    down = {(r["r"], r["c"]): (r["r"] + grid.D8_STEPS[r["d8"]][0], r["c"] + grid.D8_STEPS[r["d8"]][1]) if r["d8"] >= 0 else None for r in directed.collect()}
    expected = set()
    for outlet in [x for x, to in down.items() if to is None]:
        at, step = outlet, 0
        while at is not None:
            expected.add((*outlet, step, *at))
            at, step = max((x for x, to in down.items() if to == at), key=lambda x: (size[x], (-x[0], -x[1])), default=None), step + 1
    assert {tuple(r) for r in lines.main_stems(directed, acc).collect()} == expected

"""Nearest cells, polygons and basin networks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import spatial as G


def planned(monkeypatch, module):
    """Collects the plan of every frame that `module` materialises."""
    plans = []

    def kept(df, f=module.cut_lineage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df)

    monkeypatch.setattr(module, "cut_lineage", kept)
    return plans


@pytest.fixture
def all_look_small(spark):
    """Every side of a join is taken for small, as those of well compressed tables are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2**62))
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def edges_of(name, points):
    return [(name, *a, *b) for a, b in zip(points, points[1:] + points[:1])]


@pytest.mark.parametrize("n_slices", [1, 3, 4096])
def test_nearest_on_axis_equals_brute_force(spark, n_slices):
    rng = np.random.default_rng(4)
    axis = sorted({float(np.round(v, 2)) for v in np.concatenate([rng.normal(0, 1, 40), [50.0, 51.0]])})
    points = [float(np.round(v, 2)) for v in rng.uniform(-60, 60, 80)] + axis[:3] + [50.5]
    a = spark.createDataFrame([(v,) for v in axis], "lon double")
    p = spark.createDataFrame([(i, v) for i, v in enumerate(points)], "id int, lon double")
    out = {r.id: r.near for r in G.nearest_on_axis(p, a, "lon", "lon", "near", n_slices).collect()}
    for i, v in enumerate(points):
        want = min(axis, key=lambda c: (abs(c - v), -c))
        assert abs(out[i] - v) == pytest.approx(abs(want - v)), v
    assert out[len(points) - 1] == 51.0  # ties take the larger coordinate


def inside(px, py, points):
    hit = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


@pytest.mark.parametrize("most_edges", [3, 32])
def test_points_in_polygons_equal_brute_force(spark, most_edges):
    shapes = {
        "star": [(0.1, 0.2), (5.3, 1.1), (9.7, 0.4), (6.2, 4.9), (8.8, 9.3), (4.4, 6.1), (0.3, 9.9), (2.2, 4.7)],
        "box": [(-3.5, -2.5), (2.5, -2.5), (2.5, 3.5), (-3.5, 3.5)],
    }
    edges = spark.createDataFrame(
        [e for k, v in shapes.items() for e in edges_of(k, v)], "zone string, x1 double, y1 double, x2 double, y2 double"
    )
    grid = [(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(-5, 12) for y in range(-5, 12))]
    points = spark.createDataFrame(grid, "id int, x double, y double")
    got = {(r.id, r.zone) for r in G.points_in_polygons(points, ["id"], "x", "y", edges, "zone", most_edges).collect()}
    assert got == {(i, k) for i, x, y in grid for k, v in shapes.items() if inside(x, y, v)}


def comb(n, left, low, width, height):
    """A concave outline with n teeth."""
    step = width / n
    top = [(left + step * (k + d), low + (height if d else height / 9)) for k in range(n) for d in (0.0, 0.5)]
    return [(left + width, low - 1.0), *reversed(top), (left, low - 1.0)]


ROUGH = {
    # Integer vertices on tile bounds, a hole, a hole in a second part, a dense coast, a small zone within a large one.
    "lattice": [[(0, 0), (8, 0), (8, 4), (4, 4), (4, 8), (0, 8)], [(1, 1), (2, 1), (2, 2), (1, 2)]],
    "holed": [[(-16, -16), (16, -16), (16, 16), (-16, 16)], [(-8, -8), (8, -8), (8, 8), (-8, 8)], [(-2, -3), (3, -2), (1, 3)]],
    "coast": [comb(150, -15.0, 0.0, 30.0, 9.0)],
    "tiny": [[(3.0, 3.0), (3.01, 3.0), (3.005, 3.02)]],
    "line": [[(5, 5), (9, 5)]],
}


def rough_edges(spark):
    rows = [(k, *map(float, e[1:])) for k, rings in ROUGH.items() for ring in rings for e in edges_of(k, ring)]
    return spark.createDataFrame(rows, "zone string, x1 double, y1 double, x2 double, y2 double"), rows


@pytest.mark.parametrize("most_edges", [6, 1000])
def test_tile_tree_on_holes_bounds_and_coasts(spark, most_edges):
    """Every status is that of a plain ray over all edges, also for points on vertices, edges and bounds of tiles."""
    edges, rows = rough_edges(spark)
    rng = np.random.default_rng(6)
    points = [(float(x), float(y)) for x in range(-17, 18) for y in range(-17, 18)] + [(r[1], r[2]) for r in rows[::3]]
    points += [((r[1] + r[3]) / 2, (r[2] + r[4]) / 2) for r in rows[::5]] + [(3.004, 3.001)] * 40 + rng.uniform(-17, 17, (400, 2)).tolist()
    ends = np.array([r[1:] for r in rows])
    name = np.array([r[0] for r in rows])
    want = set()
    for i, (x, y) in enumerate(points):
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (ends[:, 2] - ends[:, 0]) * (y - ends[:, 1]) / (ends[:, 3] - ends[:, 1]) + ends[:, 0]
            hit = ((ends[:, 1] > y) != (ends[:, 3] > y)) & (x < at)
        want |= {(i, k) for k in ROUGH if hit[name == k].sum() % 2}
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id int, x double, y double")
    got = {(r.id, r.zone) for r in G.points_in_polygons(df, ["id"], "x", "y", edges, "zone", most_edges).collect()}
    assert got == want and len({k for _, k in got}) == 4


def test_refinement_bounds_the_edges_a_point_meets(spark):
    """Edges compared over all points shrink with the tiles; a leaf holds few however dense the coast is."""
    edges, _ = rough_edges(spark)
    met = []
    for most in (1000, 64, 8):
        leaves = G.tile_tree(edges.where("zone = 'coast'"), "zone", most)
        sizes = leaves.select(F.coalesce(F.size("edges"), F.lit(0)).alias("n"), F.pow(F.lit(4.0), -F.col("_level")).alias("area")).toPandas()
        # Points spread evenly: the share of a leaf is its area.
        met.append(float((sizes["n"] * sizes["area"]).sum() / sizes["area"].sum()))
        assert sizes["n"].max() <= most
    assert met == sorted(met, reverse=True) and met[-1] < met[0] / 20
    assert G.tile_tree(edges.where("false"), "zone").count() == 0


@pytest.mark.parametrize("tile", [0.7, 2.0])
def test_polygon_intersects(spark, tile):
    def square(name, x, y, s):
        return edges_of(name, [(x, y), (x + s, y), (x + s, y + s), (x, y + s)])

    schema = "{} string, x1 double, y1 double, x2 double, y2 double"
    basins = spark.createDataFrame(
        square("far", 20.0, 20.0, 1.0) + square("cross", -0.5, 1.0, 1.0) + square("within", 2.0, 2.0, 0.5)
        + square("around", -1.0, -1.0, 9.0), schema.format("basin")
    )
    zone = spark.createDataFrame(square("z", 0.0, 0.0, 5.0), schema.format("zone"))
    got = {r.basin for r in G.polygon_intersects(basins, "basin", zone, "zone", tile).collect()}
    assert got == {"cross", "within", "around"}


def test_no_polygons_are_sent_through_the_driver(spark, monkeypatch, all_look_small):
    """Only a tree of few edges goes to every task; with more of them no side of any join does."""
    schema = "{} string, x1 double, y1 double, x2 double, y2 double"
    basins = spark.createDataFrame([e for k in range(30) for e in shifted(f"b{k}", k % 6 * 0.5, k // 6 * 0.5, 0.5)], schema.format("basin"))
    zone = spark.createDataFrame(shifted("z", 0.6, 0.6, 0.7), schema.format("zone"))
    want = {f"b{6 * y + x}" for x in (1, 2) for y in (1, 2)}
    plans = planned(monkeypatch, G)
    for most in (100_000, 0):
        monkeypatch.setattr(G, "SENT_EDGES", most, raising=False)
        out = G.polygon_intersects(basins, "basin", zone, "zone")
        assert {r.basin for r in out.collect()} == want
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_upstream_closure_handles_cycles_and_limits(spark):
    rows = [(1, 0, 10), (2, 1, 10), (3, 2, 99), (4, 3, 10), (5, 1, 10), (6, 7, 10), (7, 6, 10), (8, 8, 10)]
    basins = spark.createDataFrame(rows, "hybas_id long, next_down long, up_area int")
    seeds = spark.createDataFrame([("a", 1), ("b", 6), ("c", 8)], "zone string, hybas_id long")
    out = {(r.zone, r.hybas_id) for r in G.upstream_closure(basins, seeds, max_area=50).collect()}
    assert out == {("a", 1), ("a", 2), ("a", 5), ("b", 6), ("b", 7), ("c", 8)}


def test_no_network_is_sent_through_the_driver(spark, monkeypatch, all_look_small):
    basins = spark.createDataFrame([(k, k // 2, 10, int(k == 5)) for k in range(1, 9)], "hybas_id long, next_down long, up_area int, lake int")
    edges = spark.createDataFrame([(k, *e[1:]) for k in range(1, 9) for e in shifted("", float(k - 1), 0.0)], "hybas_id long, x1 double, y1 double, x2 double, y2 double")
    zone = spark.createDataFrame(shifted("z", 1.2, 0.2, 0.3), "zone string, x1 double, y1 double, x2 double, y2 double")
    plans = planned(monkeypatch, G)
    members = G.upstream_closure(basins, spark.createDataFrame([("z", 2)], "zone string, hybas_id long"))
    assert {r.hybas_id for r in members.collect()} == {2, 4, 5, 8} and len(plans) > 3
    monkeypatch.setattr(G, "SENT_EDGES", 0, raising=False)
    out = G.catchments(basins, edges, zone)
    assert len(out.collect()) == 12
    assert not any("Broadcast" in p for p in [*plans, out._jdf.queryExecution().executedPlan().toString()])


def test_dissolve_keeps_the_outer_boundary(spark):
    a = edges_of("a", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
    b = edges_of("b", [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)])
    edges = spark.createDataFrame(a + b, "id string, x1 double, y1 double, x2 double, y2 double")
    members = spark.createDataFrame([("a", "z"), ("b", "z")], "id string, zone string")
    out = G.dissolve_boundary(edges, members, "id", "zone").collect()
    assert len(out) == 6 and not any(r.x1 == 1.0 and r.x2 == 1.0 for r in out)


def test_zone_reduce_rejects_nothing_silently(spark):
    cube = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 3.0), (1.0, 0.0, 10.0)], "lat double, lon double, dis24 double")
    zones = spark.createDataFrame([(0.0, 0.0, "z"), (1.0, 0.0, "z")], "lat double, lon double, zone string")
    row = G.zone_period_reduce(cube, zones, F.lit(1), "mean", ["mean", "max", "sum"]).first()
    assert (row["mean"], row["max"], row["sum"]) == (6.0, 10.0, 12.0)


def shifted(key, x, y, side=1.0):
    return edges_of(key, [(x, y), (x + side, y), (x + side, y + side), (x, y + side)])


def test_intersections_of_parts_and_of_touching_shapes(spark):
    schema = "{} string, x1 double, y1 double, x2 double, y2 double"
    zone = spark.createDataFrame(shifted("z", 0.0, 0.0, 4.0), schema.format("zone"))
    shapes = (
        shifted("second part inside", -9.0, -9.0) + shifted("second part inside", 1.0, 1.0) + shifted("same", 0.0, 0.0, 4.0)
        + shifted("half over", 2.0, 0.0, 4.0) + shifted("shared side", 4.0, 0.0, 4.0) + shifted("corner", 4.0, 4.0)
        + shifted("apart", 4.5, 0.0) + shifted("in line", 6.0, 0.0, 4.0)
    )
    basins = spark.createDataFrame(shapes, schema.format("basin"))
    got = {r.basin for r in G.polygon_intersects(basins, "basin", zone, "zone", 1.5).collect()}
    assert got == {"second part inside", "same", "half over", "shared side", "corner"}
    parts = basins.withColumn("part", (F.col("x1") < -1).cast("int"))
    again = G.polygon_intersects(parts, "basin", zone.withColumn("part", F.lit(0)), "zone", 1.5, "part").collect()
    assert {r.basin for r in again} == got


def test_catchments_follow_the_network(spark):
    schema = "hybas_id long, x1 double, y1 double, x2 double, y2 double"
    edges = [(k, *e[1:]) for k in range(1, 6) for e in shifted("", float(k - 1), 0.0)]
    basins = spark.createDataFrame(
        [(1, 0, 10, 0), (2, 1, 10, 0), (3, 2, 10, 0), (4, 3, 10, 1), (5, 4, 10, 0)], "hybas_id long, next_down long, up_area int, lake int"
    )
    zone = spark.createDataFrame(shifted("z", 0.2, 0.2, 0.3), "zone string, x1 double, y1 double, x2 double, y2 double")
    out = G.catchments(basins, spark.createDataFrame(edges, schema), zone).collect()
    assert {x for r in out for x in (r.x1, r.x2)} == {0.0, 1.0, 2.0, 3.0} and len(out) == 8


def test_long_river_needs_few_rounds(spark):
    chain = spark.createDataFrame([(k, k - 1, 1) for k in range(1, 301)], "hybas_id long, next_down long, up_area int")
    seeds = spark.createDataFrame([("a", 5), ("b", 200)], "zone string, hybas_id long")
    out = {(r.zone, r.hybas_id) for r in G.upstream_closure(chain, seeds).collect()}
    assert out == {("a", k) for k in range(5, 301)} | {("b", k) for k in range(200, 301)}


def test_rings_of_holes_touching_parts_and_open_lines(spark):
    """A block with a hole, a part that touches it at a corner, a clockwise neighbour, and a line that does not close."""
    schema = "id string, x1 double, y1 double, x2 double, y2 double"
    cells = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(3, 3)]
    rows = [(f"{x}{y}", *e[1:]) for x, y in cells for e in (shifted("", float(x), float(y)) if (x, y) != (2, 0) else [(k, c, d, a, b) for k, a, b, c, d in shifted("", 2.0, 0.0)])]
    edges = spark.createDataFrame(rows, schema)
    members = edges.select("id", F.lit("z").alias("zone")).distinct()
    boundary = G.directed_boundary(edges, members, "id", "zone")
    line = spark.createDataFrame([("line", 9.0, 9.0, 8.0, 8.0), ("line", 8.0, 8.0, 8.5, 9.0)], "zone string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.zone, r.x, r.y): r for r in G.rings(boundary.unionByName(line), "zone").collect()}
    assert {k: (r.n_vertices, r.area, r.outer, r.closed) for k, r in got.items() if r.closed} == {
        ("z", 0.0, 0.0): (12, 9.0, True, True), ("z", 1.0, 1.0): (4, -1.0, False, True), ("z", 3.0, 3.0): (4, 1.0, True, True),
    }
    assert [(v.x, v.y) for v in got["z", 1.0, 1.0].vertices] == [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]
    assert [(v.x, v.y) for v in got["line", 9.0, 9.0].vertices] == [(9.0, 9.0), (8.0, 8.0)] and not got["line", 9.0, 9.0].closed
    outline = [(v.x, v.y) for v in got["z", 0.0, 0.0].vertices]
    assert outline[0] == (0.0, 0.0) and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(outline, outline[1:] + outline[:1]))


def test_a_long_ring_takes_logarithmic_rounds(spark, monkeypatch):
    n, written = 100_000, []
    monkeypatch.setattr(G, "cut_lineage", lambda df, f=G.cut_lineage: written.append(1) or f(df))
    at = lambda k: [F.cos(2 * F.pi() * (k % n) / n).alias("x"), F.sin(2 * F.pi() * (k % n) / n).alias("y")]
    k = F.col("id")
    ring = spark.range(n).select(F.lit("z").alias("zone"), *(c.alias(f"x{i}" if j == 0 else f"y{i}") for i, p in ((1, at(k)), (2, at(k + 1))) for j, c in enumerate(p)))
    row = G.rings(ring.orderBy(F.xxhash64("x1")), "zone").first()
    assert row.n_vertices == n and row.closed and row.outer and len(written) <= 2 + 19
    turn = np.unwrap(np.arctan2([v.y for v in row.vertices], [v.x for v in row.vertices]))
    assert (np.diff(turn) > 0).all() and turn[-1] - turn[0] < 2 * np.pi

"""Nearest cells, zonal statistics, basin networks and boundaries.

Polygons are tables of directed edges (id, x1, y1, x2, y2). Candidates are found by
equi-joins on square tiles, never by pairing everything with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.quantiles import exact_quantiles
from freshet.session import cut_lineage, shuffled


def nearest_on_axis(points: DataFrame, axis: DataFrame, point: str, coordinate: str, out: str,
                    n_slices: int = 4096) -> DataFrame:
    """Attach to each point the closest coordinate of a grid axis; ties take the larger one.

    The axis is cut into `n_slices` slices between its ends. A point compares with the
    nearest axis values on both sides inside its slice; empty slices borrow the value of
    the slice before or after. Only the slice table, at most `n_slices` + 2 rows, is
    ordered as a whole. Points with equal coordinates are looked up once.
    """
    values = axis.select(F.col(coordinate).alias("_c")).where(F.col(coordinate).isNotNull()).distinct()
    ends = values.agg(F.struct(F.min("_c").alias("lo"), F.max("_c").alias("hi"))).scalar()

    def sliced(df: DataFrame, x: str) -> DataFrame:
        at = df.withColumn("_ends", ends)
        width = (F.col("_ends.hi") - F.col("_ends.lo")) / n_slices
        position = F.when(width == 0, F.lit(0)).otherwise(F.floor((F.col(x) - F.col("_ends.lo")) / width))
        return at.withColumn("_s", F.least(F.greatest(position, F.lit(-1)), F.lit(n_slices + 1))).drop("_ends")

    cells = sliced(values, "_c")
    wanted = sliced(points.select(F.col(point).alias("_x")).where(F.col(point).isNotNull()).distinct(), "_x")
    # Per slice: the last axis value before it and the first one after it.
    summary = (
        cells.groupBy("_s").agg(F.min("_c").alias("_min"), F.max("_c").alias("_max"))
        .unionByName(wanted.select("_s").distinct(), allowMissingColumns=True)
        .groupBy("_s").agg(F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    )
    def nearest_before(value: str, keys: list, order: Column, end: int) -> Column:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        return F.last(value, ignorenulls=True).over(w)

    whole = [F.lit(0)]
    borders = summary.select(
        "_s",
        nearest_before("_max", whole, F.col("_s").asc(), -1).alias("_before"),
        nearest_before("_min", whole, F.col("_s").desc(), -1).alias("_after"),
    )
    both = cells.select("_s", F.col("_c").alias("_x"), F.col("_c")).unionByName(
        wanted.select("_s", "_x"), allowMissingColumns=True
    ).groupBy("_s", "_x").agg(F.max("_c").alias("_c"), F.max(F.col("_c").isNull()).alias("_is_point"))
    near = both.select(
        "_s", "_x", "_is_point",
        nearest_before("_c", ["_s"], F.col("_x").asc(), 0).alias("_l"),
        nearest_before("_c", ["_s"], F.col("_x").desc(), 0).alias("_r"),
    ).where("_is_point").join(borders, "_s")
    left, right = F.coalesce("_l", "_before"), F.coalesce("_r", "_after")
    nearest = F.when(right.isNull(), left).when(left.isNull(), right).when(
        F.col("_x") - left < right - F.col("_x"), left
    ).otherwise(right)
    found = near.select(F.col("_x").alias(point), nearest.alias(out))
    return points.join(found, point)


def nearest_cell_series(cube: DataFrame, stations: DataFrame) -> DataFrame:
    """Daily series of the grid cell nearest to each station, matched axis by axis."""
    # Both axes come from the cells, a table without days; the cube is read for it once.
    axes = cut_lineage(cube.select("lat", "lon").distinct())
    located = nearest_on_axis(stations, axes, "lon", "lon", "_cell_lon")
    located = nearest_on_axis(located, axes, "lat", "lat", "_cell_lat")
    cells = located.select("station", F.col("_cell_lat").alias("lat"), F.col("_cell_lon").alias("lon"))
    return cube.join(cells, ["lat", "lon"]).select("station", "time", F.col("dis24").alias("dis"))


def crosses_ray(px: Column, py: Column) -> Column:
    """Does the edge cross the ray from (px, py) towards larger x?"""
    straddles = (F.col("y1") > py) != (F.col("y2") > py)
    rise = F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    at = (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / rise + F.col("x1")
    return straddles & (px < at)


def _tiles(low: str, high: str, size: float) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))


def bounding_boxes(edges: DataFrame, key: str) -> DataFrame:
    """Extent of every polygon; edges are listed once per direction, so both ends count."""
    return edges.groupBy(key).agg(
        F.min(F.least("x1", "x2")).alias("bx1"), F.max(F.greatest("x1", "x2")).alias("bx2"),
        F.min(F.least("y1", "y2")).alias("by1"), F.max(F.greatest("y1", "y2")).alias("by2"),
    )


#: Edges up to which a tile stays whole, and halvings after which it does in any case.
TILE_EDGES, TILE_LEVELS = 32, 24
#: Leaves and edges of a tree, some 5 MB, up to which it is sent to every task that places points.
SENT_EDGES = 100_000
_TILE = ["_level", "_tx", "_ty"]


def _side(level: Column) -> Column:
    """Side of the tiles of a level, a power of two, so their bounds are exact."""
    return F.pow(F.lit(2.0), -level)


def _turns(e: dict[str, Column], px: Column, py: Column, right: Column, low: Column) -> Column:
    """How often an edge changes the status on the way from (right, low) to (px, py), up and then left.

    The status of a point is the parity of the edges that cross its ray towards larger x. On the way
    up an edge counts if it passes the vertical line between both heights, which its ends or its
    place at a height tell without rounding of their own; on the way left it counts where it crosses the ray.
    """
    x1, y1, x2, y2 = (e[c] for c in ("x1", "y1", "x2", "y2"))
    first = y1 <= y2

    def at(y: Column) -> Column:
        return (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1

    def beyond(y: Column) -> Column:
        """Is the edge, held at its end where `y` is above or below it, right of the line?"""
        upper, lower = F.when(first, x2).otherwise(x1), F.when(first, x1).otherwise(x2)
        return F.when(F.greatest(y1, y2) <= y, upper > right).when(F.least(y1, y2) > y, lower > right).otherwise(at(y) > right)

    left = ((y1 > py) != (y2 > py)) & (px < at(py)) & (at(py) <= right)
    return (beyond(py) != beyond(low)).cast("int") + F.coalesce(left, F.lit(False)).cast("int")


def _touches(level: Column, tx: Column, ty: Column) -> Column:
    """Does an edge (x1, y1, x2, y2) pass a tile? A margin far above rounding makes it rather yes than no."""
    side = _side(level)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    margin = (F.greatest(F.abs(x1), F.abs(x2), F.abs(y1), F.abs(y2)) + side) * 1e-9
    left, low = tx * side - margin, ty * side - margin
    right, high = (tx + 1) * side + margin, (ty + 1) * side + margin

    def at(y: Column) -> Column:
        return F.coalesce((x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1, x1)

    inside = (F.greatest(y1, y2) >= low) & (F.least(y1, y2) <= high)
    a, b = at(F.greatest(F.least(y1, y2), low)), at(F.least(F.greatest(y1, y2), high))
    flat = y1 == y2
    least, most = F.when(flat, F.least(x1, x2)).otherwise(F.least(a, b)), F.when(flat, F.greatest(x1, x2)).otherwise(F.greatest(a, b))
    return inside & (most >= left) & (least <= right)


def tile_tree(edges: DataFrame, zone: str, most_edges: int = TILE_EDGES, most_levels: int = TILE_LEVELS) -> DataFrame:
    """Leaves of a quadtree per zone: (zone, _level, _tx, _ty, status, edges).

    A zone begins with the at most four tiles that hold its extent. Tiles with more than `most_edges` edges
    are cut in four until none is left or `most_levels` are passed, so the leaves are small where the boundary
    is dense and large inside and outside. `status` is 1 if the lower right corner of the tile is inside; a tile
    without edges has that status as a whole. A child's status follows from its parent's and the edges in the
    parent alone, so no tile ever meets the edges of a whole zone but the first four.
    """
    keys = [zone, *_TILE]
    lines = edges.select(zone, *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    boxes = bounding_boxes(lines, zone)
    extent = F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1"), F.lit(1e-9))
    level = (-F.ceil(F.log2(extent))).cast("int")
    across = [F.explode(F.sequence(F.floor(F.col(f"b{c}1") / _side(F.col("_level"))), F.floor(F.col(f"b{c}2") / _side(F.col("_level"))))) for c in "xy"]
    roots = boxes.withColumn("_level", level).withColumn("_tx", across[0]).withColumn("_ty", across[1]).select(*keys)
    right, low = (F.col("_tx") + 1) * _side(F.col("_level")), F.col("_ty") * _side(F.col("_level"))
    open_tiles = lines.join(shuffled(roots), zone).select(
        *keys, "x1", "y1", "x2", "y2", F.lit(0).alias("_above"),
        _touches(*map(F.col, _TILE)).alias("_in"), F.coalesce(crosses_ray(right, low), F.lit(False)).cast("int").alias("_turns"),
    )
    done = None
    for depth in range(most_levels + 1):
        marked = cut_lineage(open_tiles)
        tiles = marked.groupBy(*keys).agg(
            ((F.max("_above") + F.sum("_turns")) % 2).cast("int").alias("status"), F.sum(F.col("_in").cast("int")).alias("_n")
        )
        counted = cut_lineage(tiles.withColumn("_full", (F.col("_n") > most_edges) & F.lit(depth < most_levels)))
        whole, full = counted.where("not _full").select(*keys, "status"), counted.where("_full").select(*keys, "status")
        held = marked.where("_in").select(*keys, "x1", "y1", "x2", "y2")
        listed = held.join(shuffled(whole.drop("status")), keys).groupBy(*keys).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        leaves = whole.join(shuffled(listed), keys, "left")
        done = leaves if done is None else done.unionByName(leaves)
        if full.isEmpty():
            break
        parts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
        child = held.join(shuffled(full), keys).withColumn("_part", parts).select(
            zone, (F.col("_level") + 1).alias("_level"), (F.col("_tx") * 2 + F.col("_part.i")).alias("_tx"), (F.col("_ty") * 2 + F.col("_part.j")).alias("_ty"),
            right.alias("_right"), low.alias("_low"), F.col("status").alias("_above"), "x1", "y1", "x2", "y2",
        )
        turns = _turns({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, right, low, F.col("_right"), F.col("_low"))
        open_tiles = child.select(*keys, "x1", "y1", "x2", "y2", "_above", _touches(*map(F.col, _TILE)).alias("_in"), turns.alias("_turns"))
    return cut_lineage(done)


def points_in_polygons(points: DataFrame, point_keys: list[str], x: str, y: str, edges: DataFrame, zone: str,
                       most_edges: int = TILE_EDGES) -> DataFrame:
    """(point keys, zone) of every point inside a polygon, by crossing parity.

    A point finds its leaf of each zone's `tile_tree` by equality, one row per level in use. In a leaf
    without edges it takes the status of the tile; else it is compared with the edges of the leaf, which
    are a short array, so no rows are multiplied. A zone has holes and parts as its edges say.
    """
    leaves = tile_tree(edges, zone, most_edges)
    used = leaves.select("_level").distinct().agg(F.array_sort(F.collect_set("_level")).alias("l")).scalar()
    located = points.select(
        *point_keys, F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"), F.explode(used).alias("_level")
    )
    located = located.withColumn("_tx", F.floor(F.col("_px") / _side(F.col("_level")))).withColumn("_ty", F.floor(F.col("_py") / _side(F.col("_level"))))
    # A tile wholly outside needs no row.
    needed = leaves.where("edges IS NOT NULL OR status = 1")
    n_edges = needed.agg(F.sum(1 + F.coalesce(F.size("edges"), F.lit(0)))).first()[0]
    met = located.join(F.broadcast(needed) if (n_edges or 0) <= SENT_EDGES else shuffled(needed), _TILE)
    right, low = (F.col("_tx") + 1) * _side(F.col("_level")), F.col("_ty") * _side(F.col("_level"))
    turned = F.aggregate(
        F.coalesce("edges", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")), F.col("status"),
        lambda n, e: n + _turns({c: e[c] for c in ("x1", "y1", "x2", "y2")}, F.col("_px"), F.col("_py"), right, low),
    )
    return met.where(turned % 2 == 1).select(*point_keys, zone).distinct()


def cell_zones(cube: DataFrame, edges: DataFrame, zone: str = "zone", most_edges: int = TILE_EDGES) -> DataFrame:
    """Static map from grid cell to zone; computed once and reused for every day."""
    cells = cube.select("lat", "lon").distinct()
    return points_in_polygons(cells, ["lat", "lon"], "lon", "lat", edges, zone, most_edges)


def zonal_stats(cube: DataFrame, zones: DataFrame, value: str = "dis24", zone: str = "zone") -> DataFrame:
    """Daily maximum and mean per zone; both combine before the shuffle."""
    return cube.join(zones, ["lat", "lon"]).groupBy(zone, "time").agg(
        F.max(value).alias("max"), F.avg(value).alias("mean")
    )


def zonal_static(cube: DataFrame, zones: DataFrame, value: str = "dis24", zone: str = "zone") -> DataFrame:
    """Mean and median over all values of a zone; a zone may hold most of the cube."""
    valued = cube.join(zones, ["lat", "lon"])
    means = valued.groupBy(zone).agg(F.avg(value).alias("mean"))
    medians = exact_quantiles(valued, [zone], value, [0.5])
    return means.join(medians.select(zone, F.col("value").alias("median")), zone)


def zone_period_reduce(
    cube: DataFrame, zones: DataFrame, period: Column, over_time: str, over_space: list[str],
    value: str = "dis24", zone: str = "zone"
) -> DataFrame:
    """Reduce each cell over the days of a period, then the cells of each zone."""
    reducers = {"mean": F.avg, "sum": F.sum, "max": F.max}
    per_cell = cube.groupBy("lat", "lon", period.alias("period")).agg(reducers[over_time](value).alias("_v"))
    return per_cell.join(zones, ["lat", "lon"]).groupBy(zone, "period").agg(
        *[reducers[r]("_v").alias(r) for r in over_space]
    )


def polygon_intersects(left: DataFrame, left_key: str, right: DataFrame, right_key: str,
                       tile: float = 1.0, part: str | None = None) -> DataFrame:
    """Pairs of polygons that share any point: meeting edges, or a part of one inside the other.

    Edges meet if they cross, touch or overlap, and only edges that pass through the same
    tile are compared. Without a meeting, each ring lies inside or outside as a whole: one
    vertex per ring decides if the column `part` names the rings, else every vertex is tested.
    """
    def tiled(edges: DataFrame, key: str, tag: str) -> DataFrame:
        named = edges.select(
            F.col(key), *[F.col(c).alias(f"{tag}{c}") for c in ("x1", "y1", "x2", "y2")],
            F.least("x1", "x2").alias("_a"), F.greatest("x1", "x2").alias("_b"),
            F.least("y1", "y2").alias("_c"), F.greatest("y1", "y2").alias("_d"),
        )
        return named.withColumn("_tx", _tiles("_a", "_b", tile)).withColumn("_ty", _tiles("_c", "_d", tile)).drop(
            "_a", "_b", "_c", "_d"
        )

    def side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> Column:
        return (F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax))

    def overlap(axis: str) -> Column:
        """The two edges' extents meet on this axis; checked before any orientation test."""
        return (F.least(f"l{axis}1", f"l{axis}2") <= F.greatest(f"r{axis}1", f"r{axis}2")) & (
            F.least(f"r{axis}1", f"r{axis}2") <= F.greatest(f"l{axis}1", f"l{axis}2")
        )

    l, r = tiled(left, left_key, "l"), tiled(right, right_key, "r")
    joined = l.join(shuffled(r), ["_tx", "_ty"]).where(overlap("x") & overlap("y"))
    s1, s2 = side("lx1", "ly1", "lx2", "ly2", "rx1", "ry1"), side("lx1", "ly1", "lx2", "ly2", "rx2", "ry2")
    s3, s4 = side("rx1", "ry1", "rx2", "ry2", "lx1", "ly1"), side("rx1", "ry1", "rx2", "ry2", "lx2", "ly2")
    # With overlapping extents, ends on the line or on both sides of it mean a common point.
    crossing = joined.where((s1 * s2 <= 0) & (s3 * s4 <= 0)).select(left_key, right_key)

    def vertices(edges: DataFrame, key: str) -> DataFrame:
        if part is None:
            return edges.select(key, F.col("x1").alias("_vx"), F.col("y1").alias("_vy")).distinct()
        low = F.min(F.struct("x1", "y1"))
        return edges.groupBy(key, part).agg(low.alias("_v")).select(key, F.col("_v.x1").alias("_vx"), F.col("_v.y1").alias("_vy"))

    left_inside = points_in_polygons(
        vertices(left, left_key), [left_key, "_vx", "_vy"], "_vx", "_vy", right, right_key
    ).select(left_key, right_key)
    right_inside = points_in_polygons(
        vertices(right, right_key), [right_key, "_vx", "_vy"], "_vx", "_vy", left, left_key
    ).select(left_key, right_key)
    return crossing.unionByName(left_inside).unionByName(right_inside).distinct()


def upstream_closure(basins: DataFrame, seeds: DataFrame, zone: str = "zone", max_area: float = 25000) -> DataFrame:
    """Seed basins and everything that drains into them through basins of limited area.

    A basin has one basin below it, so paths are doubled: after round k every basin knows
    the zones within 2^k steps down and the basin 2^k steps down. Rounds grow with the
    logarithm of the longest path; cycles end when a path would be longer than the network.
    Each round is written to the checkpoint folder, so the plan does not grow.
    """
    network = basins.where(F.col("up_area") <= max_area).select("hybas_id", F.col("next_down").alias("_to")).distinct()
    jumps = cut_lineage(network)
    start = seeds.select(zone, "hybas_id").distinct()
    below = start.withColumnRenamed("hybas_id", "_to")
    known = cut_lineage(jumps.join(shuffled(below), "_to").select(zone, "hybas_id"))
    reach, n = 1, jumps.count()
    while reach < n:
        there = jumps.join(shuffled(known.select(zone, F.col("hybas_id").alias("_to"))), "_to").select(zone, "hybas_id")
        known = cut_lineage(known.unionByName(there).distinct())
        jumps = cut_lineage(jumps.join(shuffled(jumps.select(F.col("hybas_id").alias("_to"), F.col("_to").alias("_then"))), "_to").select(
            "hybas_id", F.col("_then").alias("_to")
        ))
        reach *= 2
        if jumps.isEmpty():
            break
    return known.unionByName(start).distinct()


def catchments(basins: DataFrame, basin_edges: DataFrame, zone_edges: DataFrame, zone: str = "zone", max_area: float = 25000,
               tile: float = 1.0) -> DataFrame:
    """Boundary of each zone's catchment: basins without lakes that meet the zone, all that drains into them, dissolved.

    `basins` has hybas_id, next_down, up_area and lake.
    """
    dry = basins.where(F.col("lake") == 0)
    edges = basin_edges.join(shuffled(dry.select("hybas_id")), "hybas_id", "left_semi")
    seeds = polygon_intersects(edges, "hybas_id", zone_edges, zone, tile).select(zone, "hybas_id")
    members = upstream_closure(dry, seeds, zone, max_area)
    return dissolve_boundary(edges, members, "hybas_id", zone)


def dissolve_boundary(edges: DataFrame, members: DataFrame, key: str, zone: str) -> DataFrame:
    """Outer boundary of the union of each zone's polygons: undirected edges used once."""
    start, end = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(
        F.col("x2").alias("x"), F.col("y2").alias("y")
    )
    undirected = edges.join(shuffled(members), key).select(
        zone, F.least(start, end).alias("_a"), F.greatest(start, end).alias("_b")
    )
    return undirected.groupBy(zone, "_a", "_b").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == 1).select(
        zone, F.col("_a.x").alias("x1"), F.col("_a.y").alias("y1"), F.col("_b.x").alias("x2"), F.col("_b.y").alias("y2")
    )


def directed_boundary(edges: DataFrame, members: DataFrame, key: str, zone: str) -> DataFrame:
    """`dissolve_boundary` with directions: every edge has the zone on its left.

    A polygon that runs clockwise as a whole is turned; its holes must run against its outline.
    """
    turned = edges.groupBy(key).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) < 0).alias("_turn"))
    start, end = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    sided = edges.join(turned, key).join(members, key).select(
        zone, F.least(start, end).alias("_a"), F.greatest(start, end).alias("_b"), ((start <= end) != F.col("_turn")).alias("_up")
    )
    once = sided.groupBy(zone, "_a", "_b").agg(F.count(F.lit(1)).alias("_k"), F.first("_up").alias("_up")).where(F.col("_k") == 1)
    a, b = F.when(F.col("_up"), F.col("_a")).otherwise(F.col("_b")), F.when(F.col("_up"), F.col("_b")).otherwise(F.col("_a"))
    return once.select(zone, a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def rings(boundary: DataFrame, zone: str) -> DataFrame:
    """Ordered rings of directed edges (zone, x1, y1, x2, y2) with the zone on their left, one row per ring.

    (zone, x, y, n_vertices, area, outer, closed, vertices): a ring begins at its least vertex (x, y); `area` is
    negative for holes. Each edge points to the next one; where rings touch, to the first edge clockwise
    from where it came. Pointers are then doubled: after round k an edge knows the least edge among the next
    2^k and its distance, so a ring takes rounds with the logarithm of its length, each one join written to the
    checkpoint folder. Lines that do not close are rows with `closed` false and
    the starts of their edges in order.
    """
    named = cut_lineage(boundary.withColumn("_e", F.monotonically_increasing_id()))
    leaving = named.select(zone, F.col("_e").alias("_n"), F.col("x1").alias("_vx"), F.col("y1").alias("_vy"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("_go"))
    coming = named.select(zone, "_e", F.col("x2").alias("_vx"), F.col("y2").alias("_vy"), F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("_back"))
    angle = F.col("_back") - F.col("_go")
    turn = F.when(angle <= 0, angle + 2 * F.pi()).otherwise(angle)
    following = coming.join(leaving, [zone, "_vx", "_vy"]).groupBy("_e").agg(F.min_by("_n", F.struct(turn, "_n")).alias("_next"))
    me = F.struct("x1", "y1", "x2", "y2", "_e")
    zero = F.lit(0).cast("long")
    state = cut_lineage(named.join(following, "_e", "left").select(
        "_e", "_next", me.alias("_least"), zero.alias("_off"), zero.alias("_steps"), F.col("_e").alias("_last")
    ))
    reach = 1
    while True:
        there = state.select(F.col("_e").alias("_next"), *[F.col(c).alias(f"t{c}") for c in ("_next", "_least", "_off", "_steps", "_last")])
        joined = state.join(there, "_next", "left")
        lower = F.coalesce(F.col("t_least") < F.col("_least"), F.lit(False))
        moved = cut_lineage(joined.select(
            "_e", F.col("t_next").alias("_next"), F.when(lower, F.col("t_least")).otherwise(F.col("_least")).alias("_least"),
            F.when(lower, F.col("t_off") + reach).otherwise(F.col("_off")).alias("_off"),
            F.when(F.col("_next").isNull(), F.col("_steps")).otherwise(F.col("t_steps") + reach).alias("_steps"),
            F.coalesce("t_last", "_last").alias("_last"), (lower | (F.col("_next").isNotNull() & F.col("t_next").isNull())).alias("_changed"),
        ))
        state, reach = moved.drop("_changed"), reach * 2
        if moved.where("_changed").isEmpty():
            break
    # On an open line the pointer runs off its end; its edges share the last one.
    closed = F.col("_next").isNotNull()
    placed = named.join(state, "_e").select(
        zone, "x1", "y1", "x2", "y2", closed.alias("closed"), F.when(closed, F.col("_least._e")).otherwise(F.col("_last")).alias("_ring"),
        F.when(closed, -F.col("_off")).otherwise(-F.col("_steps")).alias("_at"), (closed & (F.col("_off") == 0)).alias("_head"),
    )
    # The head is 0 steps from itself; all others come after it in falling distance.
    order = F.struct((~F.col("_head")).alias("h"), F.col("_at").alias("at"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    made = placed.groupBy(zone, "closed", "_ring").agg(
        F.count(F.lit(1)).alias("n_vertices"), (F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"), F.array_sort(F.collect_list(order)).alias("_v")
    )
    first = F.col("_v")[0]
    return made.select(
        zone, first["x"].alias("x"), first["y"].alias("y"), "n_vertices", "area", (F.col("area") > 0).alias("outer"), "closed",
        F.transform("_v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("vertices"),
    )


def station_points(stations: DataFrame, panel: DataFrame) -> DataFrame:
    """Point per station, only for stations that occur in the panel."""
    return stations.join(panel.select("station").distinct(), "station", "left_semi").select(
        "station", F.struct("lon", "lat").alias("point")
    )

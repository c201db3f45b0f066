"""Neighbours on the sphere, weights, spectra and clipping of lines and polygons by cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nilas.functions.angles import EARTH_KM, chord_km, circular_mean, lon360, polar_lonlat, unit_xyz


#: Widths of the cubes of unit vectors in which places are looked for, each a quarter of the one before.
WIDTHS = tuple(2.0**-n for n in (1, 3, 5, 7, 9))


def neighbours(targets: DataFrame, sources: DataFrame, k: int, radius_km: float) -> DataFrame:
    """The k nearest sources of each target within a radius; ties to the smaller id.

    targets: tgt_id, lon, lat; sources: src_id, lon, lat. Of the sources at one
    place only the k smallest ids can be among the k nearest, and targets at one
    place have the same neighbours: places are compared with places, and each
    with those alone that can hold one of its k nearest.
    """
    reach = 2 * math.sin(min(radius_km / (2 * EARTH_KM), math.pi / 2))
    placed = lambda prefix: [v.alias(f"{prefix}{c}") for c, v in zip("xyz", unit_xyz(F.col("lon"), F.col("lat")), strict=True)]

    def least(df: DataFrame, by: tuple[str, ...], *order: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)

    at_place = least(sources.select("src_id", "lon", "lat").dropna(subset=["lon", "lat"]), ("lon", "lat"), "src_id")
    s = at_place.groupBy("lon", "lat").agg(F.collect_list(F.struct("src_id")).alias("_ids")).select("_ids", F.size("_ids").alias("_n"), *placed("s"))
    t = targets.select("lon", "lat").dropna().distinct().select(F.struct("lon", "lat").alias("tgt_id"), *placed("t"))
    chord = F.sqrt(sum(((F.col(f"t{c}") - F.col(f"s{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    met = candidates(t, s, ("x", "y", "z"), WIDTHS, k, reach).select("tgt_id", chord_km(chord).alias("km"), "_ids").where(F.col("km") <= radius_km)
    near = least(met.select("tgt_id", "km", F.inline("_ids")), ("tgt_id",), "km", "src_id").select("tgt_id.lon", "tgt_id.lat", "src_id", "km")
    return least(targets.join(near, ["lon", "lat"]).select("tgt_id", "src_id", "km"), ("tgt_id",), "km", "src_id")


def candidates(
    targets: DataFrame, sources: DataFrame, dims: tuple[str, ...], widths: tuple[float, ...], k: int = 1, reach: float = math.inf
) -> DataFrame:
    """Each target (tgt_id, t + dims) with the sources (s + dims and more) that can be among its k nearest, however far or as far as `reach`.

    Each width is a quarter of the one before. Sources lie in cubes. From the
    widest down, a target keeps those that aren't farther than the nearest cubes
    that hold k sources together are at most and meets their children by key,
    and at last the sources in them. For k > 1 a source row stands for `_n` sources.
    """
    at = lambda width: [F.floor(F.col(f"s{c}") / width).cast("int").alias(f"c{c}") for c in dims]
    mine = Window.partitionBy("tgt_id")

    def cubes(width: float) -> DataFrame:
        return sources.select(*at(width)).distinct() if k == 1 else sources.groupBy(*at(width)).agg(F.sum("_n").alias("_n"))

    def kept(df: DataFrame, width: float) -> DataFrame:
        low = {c: F.col(f"c{c}") * width for c in dims}
        near = sum((F.pow(F.greatest(low[c] - F.col(f"t{c}"), F.col(f"t{c}") - low[c] - width, F.lit(0.0)), F.lit(2.0)) for c in dims), F.lit(0.0))
        far = sum((F.pow(F.greatest(F.abs(F.col(f"t{c}") - low[c]), F.abs(F.col(f"t{c}") - low[c] - width)), F.lit(2.0)) for c in dims), F.lit(0.0))
        df = df.withColumns({"_near": near, "_far": far})
        if reach < math.inf:
            df = df.where(F.col("_near") <= reach * reach * (1 + 1e-9) + 1e-9)
        if k == 1:
            df = df.withColumn("_least", F.min("_far").over(mine))
        else:  # fewer than k in all: none is too far
            df = df.withColumn("_held", F.sum("_n").over(mine.orderBy("_far")))
            df = df.withColumn("_least", F.coalesce(F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(mine), F.lit(math.inf))).drop("_n", "_held")
        return df.where(F.col("_near") <= F.col("_least") * (1 + 1e-9) + 1e-9).drop("_near", "_far", "_least")

    met = kept(targets.crossJoin(F.broadcast(cubes(widths[0]))), widths[0])  # few cubes of the greatest width
    for width in widths[1:]:
        children = cubes(width).select("*", *[F.shiftright(f"c{c}", 2).alias(f"p{c}") for c in dims])
        parents = met.withColumnsRenamed({f"c{c}": f"p{c}" for c in dims})
        met = kept(parents.join(children, [f"p{c}" for c in dims]).drop(*[f"p{c}" for c in dims]), width)
    return met.join(sources.select("*", *at(widths[-1])), [f"c{c}" for c in dims]).drop(*[f"c{c}" for c in dims])


def nearest(targets: DataFrame, sources: DataFrame, widths: tuple[float, ...] = WIDTHS) -> DataFrame:
    """The nearest source of each target however far it is, ties to the smaller id: tgt_id, src_id, km.

    targets: tgt_id, lon, lat; sources: src_id, lon, lat; points without a place have no row.
    """

    def placed(df: DataFrame, key: str, prefix: str) -> DataFrame:
        return df.select(key, *[v.alias(f"{prefix}{c}") for c, v in zip("xyz", unit_xyz(F.col("lon"), F.col("lat")), strict=True)]).dropna()

    s = placed(sources, "src_id", "s").groupBy("sx", "sy", "sz").agg(F.min("src_id").alias("src_id"))
    chord = F.sqrt(sum(((F.col(f"t{c}") - F.col(f"s{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    pairs = candidates(placed(targets, "tgt_id", "t"), s, ("x", "y", "z"), widths).select("tgt_id", F.struct(chord_km(chord).alias("km"), "src_id").alias("_best"))
    return pairs.groupBy("tgt_id").agg(F.min("_best").alias("_best")).select("tgt_id", "_best.src_id", "_best.km")


def inverse_distance_weights(near: DataFrame, power: float, exact_km: float = 1e-9) -> DataFrame:
    """Weights that sum to one per target; a source at the target takes all."""
    mine = Window.partitionBy("tgt_id")
    hit = F.max((F.col("km") <= exact_km).cast("int")).over(mine) == 1
    raw = F.when(hit, ((F.col("km") <= exact_km) & (F.col("rank") == 1)).cast("double")).otherwise(F.pow(F.greatest("km", F.lit(exact_km)), F.lit(-power)))
    return near.withColumn("_w", raw).withColumn("w", F.col("_w") / F.sum("_w").over(mine)).where("w > 0").select("tgt_id", "src_id", "w")


def apply_weights(values: DataFrame, weights: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sparse matrix times field: weights are shared by all times."""
    return values.join(weights, "src_id").groupBy(*keys, "tgt_id").agg(F.sum(F.col("w") * F.col(value)).alias(value))


def apply_shared_weights(values: DataFrame, rows: DataFrame, targets: DataFrame, row_keys: list[str], value: str) -> DataFrame:
    """Sparse matrix times field where many targets have the same row of weights: tgt_id and the value.

    rows: row_keys, src_id, w, each different row once; targets: tgt_id,
    row_keys. The field meets the different rows only, so the work grows with
    them and the targets, not with their product. A target that is there twice
    gets the sum; one whose row has no source has none.
    """
    made = apply_weights(values, rows.withColumn("tgt_id", F.struct(*row_keys)).select("tgt_id", "src_id", "w"), [], value)
    met = targets.select(F.col("tgt_id").alias("_tgt"), F.struct(*row_keys).alias("_row")).join(made, F.col("_row").eqNullSafe(F.col("tgt_id")))
    return met.groupBy(F.col("_tgt").alias("tgt_id")).agg(F.sum(value).alias(value))


def overlap_matrix(source: DataFrame, target: DataFrame) -> DataFrame:
    """Share of each target bin that each source bin covers; bins are tables of src/tgt, lo, hi of bounded size."""
    s, t = source.select("src_bin", F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi")), target.select("tgt_bin", F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    over = F.least("s_hi", "t_hi") - F.greatest("s_lo", "t_lo")
    joined = s.join(F.broadcast(t), (F.col("s_lo") < F.col("t_hi")) & (F.col("t_lo") < F.col("s_hi")))
    return joined.select("src_bin", "tgt_bin", (over / (F.col("t_hi") - F.col("t_lo"))).alias("share"))


def remap(spectra: DataFrame, matrix: DataFrame, keys: list[str], energy: str) -> DataFrame:
    return spectra.join(F.broadcast(matrix), "src_bin").groupBy(*keys, "tgt_bin").agg(F.sum(F.col(energy) * F.col("share")).alias(energy))


def wave_height(energy: Column, width: Column) -> Column:
    """Aggregate over bins: significant height, 4 sqrt(m0)."""
    return 4 * F.sqrt(F.sum(F.greatest(energy, F.lit(0.0)) * width))


def peak(frequency: Column, energy: Column) -> Column:
    """Aggregate: the frequency of the greatest energy, the highest of equal ones."""
    return F.max_by(frequency, F.struct(energy, frequency))


def direction_widths(direction: str, keys: list[str]) -> Column:
    """Widths in radians of bins around the circle (degrees), halfway to both neighbours; they sum to 2 pi."""
    w = Window.partitionBy(*keys).orderBy(direction)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead(direction).over(w), F.first(direction).over(whole) + 360)
    before = F.coalesce(F.lag(direction).over(w), F.last(direction).over(whole) - 360)
    return F.radians((after - before) / 2)


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, lo_x: Column, hi_x: Column, lo_y: Column, hi_y: Column) -> tuple[Column, Column]:
    """First and last parameter (0 to 1) of the part of a segment in a box; first > last: outside."""
    dx, dy = x1 - x0, y1 - y0

    def slab(p: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        a, b = F.try_divide(lo - p, d), F.try_divide(hi - p, d)
        out = (p < lo) | (p > hi)
        return F.when(d == 0, F.when(out, 2.0).otherwise(0.0)).otherwise(F.least(a, b)), F.when(d == 0, F.when(out, -1.0).otherwise(1.0)).otherwise(F.greatest(a, b))

    (ax, bx), (ay, by) = slab(x0, dx, lo_x, hi_x), slab(y0, dy, lo_y, hi_y)
    return F.greatest(ax, ay, F.lit(0.0)), F.least(bx, by, F.lit(1.0))


def line_density(segments: DataFrame, size: float) -> DataFrame:
    """Length in x and y of segments in each square cell, over the cell's size.

    segments: x0, y0, x1, y1. Cells that a segment's bounding box meets are
    enumerated (a hash of the grid), so no segment meets a far cell.
    """
    s = segments
    for c in "xy":
        lo, hi = F.floor(F.least(f"{c}0", f"{c}1") / size).cast("int"), F.floor(F.greatest(f"{c}0", f"{c}1") / size).cast("int")
        s = s.withColumn(f"c{c}", F.explode(F.sequence(lo, hi)))
    box = [F.col("cx") * size, (F.col("cx") + 1) * size, F.col("cy") * size, (F.col("cy") + 1) * size]
    a, b = clip_segment(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], *box)
    inside = s.withColumn("_part", b - a).where("_part > 0")
    return inside.groupBy("cx", "cy").agg(
        (F.sum(F.abs(F.col("x1") - F.col("x0")) * F.col("_part")) / size).alias("fx"), (F.sum(F.abs(F.col("y1") - F.col("y0")) * F.col("_part")) / size).alias("fy")
    )


def following(points: Column) -> Column:
    """Each corner's next one around the ring."""
    return F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def signed_area(points: Column) -> Column:
    """Area of a polygon from its array of (x, y) corners, negative if they run clockwise."""
    terms = F.zip_with(points, following(points), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2


def shoelace(points: Column) -> Column:
    return F.abs(signed_area(points))


def ring_edges(rings: DataFrame, keys: list[str], ring: str) -> DataFrame:
    """Edges of rings from x0 to a greater x1: keys, x0, x1, y0, y1, `way`, and the ring's `low`, `high` and `area`.

    The ring's area is the sum of the areas below its edges times `way`; edges
    along y add nothing and are left out, as are rings with a corner that isn't
    known.
    """
    p = F.col(ring)
    known = F.forall(p, lambda q: q["x"].isNotNull() & q["y"].isNotNull() & ~F.isnan(q["x"]) & ~F.isnan(q["y"]))
    r = rings.where(known & (F.size(p) > 2)).withColumn("_s", signed_area(p))
    ys = F.transform(p, lambda q: q["y"])
    edges = F.zip_with(p, following(p), lambda a, b: F.when(a["x"] != b["x"], F.struct(
        F.least(a["x"], b["x"]).alias("x0"), F.greatest(a["x"], b["x"]).alias("x1"), F.when(a["x"] < b["x"], a["y"]).otherwise(b["y"]).alias("y0"),
        F.when(a["x"] < b["x"], b["y"]).otherwise(a["y"]).alias("y1"), F.signum(F.col("_s") * (a["x"] - b["x"])).alias("way"),
    )))
    return r.select(*keys, F.array_min(ys).alias("low"), F.array_max(ys).alias("high"), F.abs("_s").alias("area"), F.inline(F.filter(edges, lambda e: e.isNotNull())))


def polygon_cover(polygons: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """The area of each polygon in each cell that it meets: id, cell_id, area, cell_area.

    polygons: id, ring (array of x, y), hole (boolean); the rings of an id add
    up and its holes are taken off. cells: cell_id, corners (array of x, y), of
    any shape that doesn't cross itself. The area in both is the sum over pairs
    of edges of the area below both. Edges are hashed to squares of `size` (near
    a cell's width, which matters for speed only); an edge meets the cells of
    its own stretch of x, from its ring's lowest point to its own highest.
    Less than 1e-9 of a cell counts as nothing.
    """

    def at(y: Column) -> Column:
        return F.floor(y / size).cast("int")

    def placed(edges: DataFrame, prefix: str, top: Column) -> DataFrame:
        e = edges.withColumn("_bottom", at(F.col("low")))
        e = e.withColumn("bx", F.explode(F.sequence(at(F.col("x0")), at(F.col("x1"))))).withColumn("by", F.explode(F.sequence("_bottom", at(top))))
        return e.withColumnsRenamed({c: f"{prefix}{c}" for c in ("x0", "x1", "y0", "y1", "way", "low", "high", "area", "_bottom")})

    rings = polygons.select("id", "ring", F.when(F.col("hole"), -1.0).otherwise(1.0).alias("sign"))
    a = placed(ring_edges(rings, ["id", "sign"], "ring"), "a", F.greatest("y0", "y1"))
    b = placed(ring_edges(cells, ["cell_id"], "corners"), "b", F.col("high"))
    met = a.join(b, ["bx", "by"]).where((F.col("by") == F.greatest("a_bottom", "b_bottom")) & (F.col("alow") < F.col("bhigh")) & (F.col("ahigh") > F.col("blow")))
    met = met.withColumns({"_from": F.greatest("ax0", "bx0", F.col("bx") * size), "_to": F.least("ax1", "bx1", (F.col("bx") + 1) * size)}).where("_from < _to")

    def height(c: str, x: str) -> Column:
        return F.col(f"{c}y0") + (F.col(f"{c}y1") - F.col(f"{c}y0")) * (F.col(x) - F.col(f"{c}x0")) / (F.col(f"{c}x1") - F.col(f"{c}x0")) - F.col("blow")

    def above(p: Column, q: Column) -> Column:
        """Mean of the positive part of a line from p to q."""
        most = F.greatest(p, q)
        return F.when(F.least(p, q) >= 0, (p + q) / 2).when(most <= 0, 0.0).otherwise(most * most / (2 * F.abs(p - q)))

    (a0, a1), (b0, b1) = [[height(c, x) for x in ("_from", "_to")] for c in "ab"]
    below_both = (above(a0, a1) - above(a0 - b0, a1 - b1)) * (F.col("_to") - F.col("_from"))
    out = met.groupBy("id", "cell_id", F.col("barea").alias("cell_area")).agg(F.sum(F.col("sign") * F.col("away") * F.col("bway") * below_both).alias("area"))
    return out.where(F.col("area") > 1e-9 * F.col("cell_area")).select("id", "cell_id", "area", "cell_area")


def occupancy(cover: DataFrame) -> DataFrame:
    """Of each cell that polygons meet: their area, their number, and the share of the cell, 1 at most where they overlap."""
    out = cover.groupBy("cell_id", "cell_area").agg(F.sum("area").alias("area"), F.count("*").alias("hits"))
    return out.select("cell_id", "area", "hits", F.least(F.col("area") / F.col("cell_area"), F.lit(1.0)).alias("fraction"))


def conservative_weights(sources: DataFrame, targets: DataFrame, size: float, normalised: bool = True) -> DataFrame:
    """First-order conservative weights from source cells (src_id, corners) to target cells (tgt_id, corners): tgt_id, src_id, w.

    A weight is the share of the target that the source covers; normalised, of
    the part that any source covers. Targets that none covers have no weight.
    """
    rings = sources.select(F.col("src_id").alias("id"), F.col("corners").alias("ring"), F.lit(False).alias("hole"))
    met = polygon_cover(rings, targets.select(F.col("tgt_id").alias("cell_id"), "corners"), size)
    whole = F.sum("area").over(Window.partitionBy("cell_id")) if normalised else F.col("cell_area")
    return met.select(F.col("cell_id").alias("tgt_id"), F.col("id").alias("src_id"), (F.col("area") / whole).alias("w"))


def cells_of_corners(corners: DataFrame, j: str = "nj", i: str = "ni") -> DataFrame:
    """Cells between corners (x, y in a plane): j, i, `corners` and the unit vectors along its rows (eix, eiy) and columns (ejx, ejy).

    Cells without all four corners, without area or without a direction are left out.
    """
    along, up = Window.partitionBy(j).orderBy(i), Window.partitionBy(i).orderBy(j)
    point = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    c = corners.select(j, i, point.alias("_a")).withColumns({"_b": F.when(F.lead(i).over(along) == F.col(i) + 1, F.lead("_a").over(along))})
    above = F.lead(j).over(up) == F.col(j) + 1
    c = c.withColumns({"_d": F.when(above, F.lead("_a").over(up)), "_c": F.when(above, F.lead("_b").over(up))}).dropna(subset=["_a", "_b", "_c", "_d"])
    vector = {
        f"_{n}{z}": (F.col(f"{p}.{z}") + F.col(f"{q}.{z}") - F.col(f"{r}.{z}") - F.col(f"{s}.{z}")) / 2
        for n, (p, q, r, s) in {"i": ("_b", "_c", "_a", "_d"), "j": ("_c", "_d", "_a", "_b")}.items() for z in "xy"
    }
    c = c.withColumn("corners", F.array("_a", "_b", "_c", "_d")).withColumns(vector)
    length = {n: F.hypot(f"_{n}x", f"_{n}y") for n in "ij"}
    c = c.where((shoelace(F.col("corners")) > 0) & (length["i"] > 0) & (length["j"] > 0))
    return c.select(j, i, "corners", *[(F.col(f"_{n}{z}") / length[n]).alias(f"e{n}{z}") for n in "ij" for z in "xy"])


def line_cover(segments: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Projected length of lines in the cells that they cross: cell_id, sum_i, sum_j, hits (lines), fx and fy (the sums over dx and dy).

    segments: source, x0, y0, x1, y1. cells: cell_id, corners (convex), the unit
    vectors eix, eiy, ejx, ejy, and dx, dy. Bounding boxes are hashed to squares
    of `size`, and a segment meets a cell once, in the first square of both.
    """

    def boxed(df: DataFrame, prefix: str, xs: Column, ys: Column) -> DataFrame:
        at = {f"{prefix}{c}{n}": F.floor(f(v) / size).cast("int") for c, v in (("x", xs), ("y", ys)) for n, f in (("0", F.array_min), ("1", F.array_max))}
        df = df.withColumns(at)
        return df.withColumn("bx", F.explode(F.sequence(f"{prefix}x0", f"{prefix}x1"))).withColumn("by", F.explode(F.sequence(f"{prefix}y0", f"{prefix}y1")))

    p = F.when(signed_area(F.col("corners")) < 0, F.reverse("corners")).otherwise(F.col("corners"))
    around = F.zip_with(p, following(p), lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("u"), (b["y"] - a["y"]).alias("v")))
    c = boxed(cells.withColumn("_sides", around), "_c", F.transform("corners", lambda q: q["x"]), F.transform("corners", lambda q: q["y"]))
    s = boxed(segments.select("source", "x0", "y0", "x1", "y1").dropna(), "_s", F.array("x0", "x1"), F.array("y0", "y1"))
    met = s.join(c, ["bx", "by"]).where((F.col("bx") == F.greatest("_sx0", "_cx0")) & (F.col("by") == F.greatest("_sy0", "_cy0")))

    def left_of(side: Column, n: int) -> Column:
        return side["u"] * (F.col(f"y{n}") - side["y"]) - side["v"] * (F.col(f"x{n}") - side["x"])

    def enters(side: Column) -> Column:
        a, b = left_of(side, 0), left_of(side, 1)
        return F.when((a < 0) & (b < 0), 2.0).when(a < 0, a / (a - b)).otherwise(0.0)

    def leaves(side: Column) -> Column:
        a, b = left_of(side, 0), left_of(side, 1)
        return F.when((a < 0) & (b < 0), -1.0).when(b < 0, a / (a - b)).otherwise(1.0)

    part = F.array_min(F.transform("_sides", leaves)) - F.array_max(F.transform("_sides", enters))
    inside = met.withColumn("_part", part).where("_part > 0")
    along = {n: F.abs((F.col("x1") - F.col("x0")) * F.col(f"e{n}x") + (F.col("y1") - F.col("y0")) * F.col(f"e{n}y")) * F.col("_part") for n in "ij"}
    by_line = inside.groupBy("cell_id", "source", "dx", "dy").agg(F.sum(along["i"]).alias("_i"), F.sum(along["j"]).alias("_j"))
    out = by_line.groupBy("cell_id", "dx", "dy").agg(F.sum("_i").alias("sum_i"), F.sum("_j").alias("sum_j"), F.count("*").alias("hits"))
    over = lambda total, side: F.when(F.col(side) > 0, F.col(total) / F.col(side)).otherwise(0.0)
    return out.select("cell_id", "sum_i", "sum_j", "hits", over("sum_i", "dx").alias("fx"), over("sum_j", "dy").alias("fy"))


def line_parts(vertices: Column) -> Column:
    """Segments of an array of vertices, to explode."""
    return F.zip_with(
        F.slice(vertices, F.lit(1), F.size(vertices) - 1), F.slice(vertices, F.lit(2), F.size(vertices) - 1),
        lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")),
    )


def bilinear(targets: DataFrame, source: DataFrame, keys: list[str], extrapolate: bool = True) -> DataFrame:
    """targets: keys, y, x in steps of the source's grid; source: j, i, value. Each target meets its four corners by key.

    A target outside the grid, or with a corner that is missing or NULL, takes
    the nearest known cell's value (ties to the smaller j, then i), or NULL
    without `extrapolate`. One without a place is NULL.
    """
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    corner = lambda dj, di, w: F.struct((F.floor("y") + dj).cast("int").alias("sj"), (F.floor("x") + di).cast("int").alias("si"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx))
    asked = targets.select(*keys, "y", "x", F.inline(corners)).where("w > 0 OR w IS NULL")
    grid = source.select(F.col("j").alias("sj"), F.col("i").alias("si"), F.col("value").cast("double").alias("value"))
    made = asked.join(grid, ["sj", "si"], "left").groupBy(*keys, "y", "x").agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))
    if not extrapolate:
        return made.select(*keys, "value")
    lost = made.where("value IS NULL").select(*keys, F.struct(*keys).alias("tgt_id"), F.col("y").cast("double").alias("ty"), F.col("x").cast("double").alias("tx"))
    known = grid.where("value IS NOT NULL").select(F.col("sj").cast("double").alias("sy"), F.col("si").cast("double").alias("sx"), "value")
    dy, dx = F.col("ty") - F.col("sy"), F.col("tx") - F.col("sx")
    pairs = candidates(lost.dropna(subset=["ty", "tx"]).select("tgt_id", "ty", "tx"), known, ("y", "x"), tuple(4.0**n for n in (6, 5, 4, 3, 2, 1)))
    found = pairs.groupBy("tgt_id").agg(F.min(F.struct((dy * dy + dx * dx).alias("d"), "sy", "sx", "value")).alias("_best"))
    filled = lost.join(found, "tgt_id", "left").select(*keys, F.col("_best.value").alias("value"))
    return made.where("value IS NOT NULL").select(*keys, "value").unionByName(filled)


def frequency_bins(spark: SparkSession, first: float, ratio: float, bins: int) -> DataFrame:
    """Geometric frequency bins: centre, edges half a ratio away, and width."""
    centre = F.lit(first) * F.pow(F.lit(ratio), F.col("id").cast("double"))
    half = ratio**0.5
    b = spark.range(bins).select(F.col("id").cast("int").alias("bin"), centre.alias("f"))
    return b.select("bin", "f", (F.col("f") / half).alias("lo"), (F.col("f") * half).alias("hi"), (F.col("f") * half - F.col("f") / half).alias("width"))


def raster_centres(extents: DataFrame, pixel: float) -> DataFrame:
    """The pixel centres (row from the top, x, y) of each extent x_min, y_min, x_max, y_max, snapped outward to whole pixels."""
    e = extents.select("*", *[F.floor(F.col(c) / pixel).cast("int").alias(f"_{c}") for c in ("x_min", "y_min")], *[F.ceil(F.col(c) / pixel).cast("int").alias(f"_{c}") for c in ("x_max", "y_max")])
    grid = e.withColumn("_i", F.explode(F.sequence("_x_min", F.col("_x_max") - 1))).withColumn("_j", F.explode(F.sequence("_y_min", F.col("_y_max") - 1)))
    return grid.select(*extents.columns, (F.col("_y_max") - 1 - F.col("_j")).alias("row"), ((F.col("_i") + 0.5) * pixel).alias("x"), ((F.col("_j") + 0.5) * pixel).alias("y"))


def grid_corners(centres: DataFrame, j: str = "nj", i: str = "ni") -> DataFrame:
    """Corners of a grid from its centres (lon, lat): the mean of the centres around each, four inside, two on an edge, one at a corner."""
    shifts = F.array(*[F.struct((F.col(j) + a).alias("j"), (F.col(i) + b).alias("i")) for a in (0, 1) for b in (0, 1)])
    met = centres.select("lon", "lat", F.explode(shifts).alias("c")).select("lon", "lat", F.col("c.j").alias(j), F.col("c.i").alias(i))
    return met.groupBy(j, i).agg(lon360(circular_mean(F.col("lon"))).alias("lon"), F.avg("lat").alias("lat"))


def grid_faces(centres: DataFrame, j: str = "nj", i: str = "ni") -> DataFrame:
    """Mid-points of the grid lines' pieces: face 'e' between two corners of one column, 'n' between two of one row."""
    c = grid_corners(centres, j, i)
    parts = []
    for face, a, b in (("e", 1, 0), ("n", 0, 1)):
        ends = c.select("lon", "lat", F.explode(F.array(F.struct(F.col(j).alias("j"), F.col(i).alias("i")), F.struct((F.col(j) - a).alias("j"), (F.col(i) - b).alias("i")))).alias("c"))
        mid = ends.groupBy(F.col("c.j").alias(j), F.col("c.i").alias(i)).agg(F.count("*").alias("_n"), lon360(circular_mean(F.col("lon"))).alias("lon"), F.avg("lat").alias("lat"))
        parts.append(mid.where(F.col("_n") == 2).select(F.lit(face).alias("face"), j, i, "lon", "lat"))
    return parts[0].union(parts[1])


def onto_raster(sources: DataFrame, raster: DataFrame, radius_km: float, value: str = "value", fill: float | None = None) -> DataFrame:
    """The nearest source's value for each centre of a polar stereographic raster (x, y), `fill` where none is within the radius.

    sources: src_id, lon, lat and the value, which may be of many days: the
    nearest source is found once for each pixel.
    """
    lon, lat = polar_lonlat(F.col("x"), F.col("y"))
    pixels = raster.withColumn("tgt_id", F.struct("x", "y")).withColumns({"lon": lon, "lat": lat})
    points = sources.select("src_id", "lon", "lat").distinct()
    near = neighbours(pixels.select("tgt_id", "lon", "lat"), points, 1, radius_km).select("tgt_id", "src_id")
    out = pixels.join(near, "tgt_id", "left").join(sources.drop("lon", "lat"), "src_id", "left")
    return out.drop("tgt_id", "src_id").withColumn(value, F.coalesce(F.col(value), F.lit(fill)) if fill is not None else F.col(value))

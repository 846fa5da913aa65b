"""Spatial joins by grid cells.

Three joins cover the city's needs, all as equi-joins on cell keys followed by an exact test:

* ``nearest``       k nearest items of each origin, exact, by descending a pyramid of cell counts. The
                    candidates an origin keeps per level depend on k only, not on how crowded a cell is,
                    so a place holding a third of all rows costs the same as any other.
* ``within_pairs``  every pair at most r apart; the pairs are the result, crowded cells are salted.
* ``box_join``      pairs whose boxes overlap, for boxes of any mix of sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upland.session import written

LEVELS = list(range(24, -8, -2))   # log2 of the cell side in metres, coarse to fine
TOP_NODES = 64                     # cells kept in the plan itself as the first level
LEAF_ITEMS = 32                    # a bottom cell holds at most this many items
BROADCAST_ROWS = 20_000            # a cell table up to this many rows is broadcast (a few MB on the driver)
SALTS = 8
HOT_ROWS = 20_000                  # a cell with more rows than this is salted in within_pairs
ROUND_M = 0.01                     # keeps ties that round to the same millimetre


def _keys(xyz: Sequence[Column], level: int) -> list[Column]:
    return [F.floor(c / F.lit(2.0**level)).cast("long") for c in xyz]


def _near(point: Sequence[Column], cell: Sequence[Column], level: int) -> Column:
    """Shortest distance from a point to a cell."""
    side, total = F.lit(2.0**level), F.lit(0.0)
    for p, c in zip(point, cell):
        gap = F.greatest(c * side - p, p - (c + 1) * side, F.lit(0.0))
        total = total + gap * gap
    return F.sqrt(total)


def _far(point: Sequence[Column], cell: Sequence[Column], level: int) -> Column:
    """Longest distance from a point to a cell."""
    side, total = F.lit(2.0**level), F.lit(0.0)
    for p, c in zip(point, cell):
        gap = F.greatest(F.abs(p - c * side), F.abs(p - (c + 1) * side))
        total = total + gap * gap
    return F.sqrt(total)


def lookup_join(left: DataFrame, table: DataFrame, keys: list[str], rows: int, salt_by: Sequence[str]) -> DataFrame:
    """Inner join of many rows to a cell table: broadcast when the table is small, else shuffled with the left
    side of each key spread over SALTS copies of the table's row."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(table), keys)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def nearest(
    origins: DataFrame,
    items: DataFrame,
    k: int,
    *,
    origin_id: str,
    origin_at: Callable[[], Sequence[Column]],
    item_at: Callable[[], Sequence[Column]],
    distance: Column,
    tie: Sequence[str],
    same_site: Sequence[str] | None = None,
    max_m: float | None = None,
    slack_m: float = 0.0,
    exclude: Column | None = None,
    origin_site: Sequence[str] | None = None,
    by_columns: list[str] | None = None,
) -> DataFrame:
    """The k items closest to each origin, nearest first, as origin columns + item columns + dist + rank.

    ``origin_at`` and ``item_at`` give 2 or 3 coordinates in metres, ``distance`` the exact metres between a joined
    pair. An item may reach up to ``slack_m`` closer than its own point (half a segment). ``same_site`` names the
    columns that fix an item's distance: of any number of copies only the first k by ``tie`` can ever be returned.
    ``exclude`` drops at most one item per origin (itself). ``origin_site`` names the origin columns that fix the
    distances: the search then runs once per place, and its result is joined to all origins there. Column names of the
    two sides must differ. The items looked through are written to the shared folder once, where there is one.
    """
    dims = len(origin_at())
    axes = [f"_c{i}" for i in range(dims)]
    need = k + (1 if exclude is not None else 0)
    order = [F.floor(F.col("dist") * 1000 + 0.5), *tie]
    if origin_site:
        found = nearest(origins.select(*origin_site).distinct(), items, need, origin_id="", origin_at=origin_at, item_at=item_at, distance=distance,
                        tie=tie, same_site=same_site, max_m=max_m, slack_m=slack_m, by_columns=list(origin_site))
        out = origins.join(found, list(origin_site)).select(*origins.columns, *[c for c in found.columns if c not in origin_site])
        if exclude is None:
            return out
        own = Window.partitionBy(origin_id).orderBy(*order)
        return out.where(~exclude).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    key = by_columns or [origin_id]

    if same_site:
        first = Window.partitionBy(*same_site).orderBy(*tie)
        items = items.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") <= need).drop("_copy")
    at = [f"_i{i}" for i in range(dims)]
    items = items.select("*", *[c.alias(a) for a, c in zip(at, item_at())])
    if items.sparkSession.conf.get("spark.checkpoint.dir", None):    # read many times below; without a folder, worked out again
        items = written(items)

    # One small job: per level, how many cells there are and how full the fullest is.
    per_level = F.explode(F.array(*[
        F.struct(F.lit(lv).alias("lv"), *[c.alias(a) for a, c in zip(axes, _keys([F.col(x) for x in at], lv))]) for lv in LEVELS]))
    counts = items.select(per_level.alias("n")).select("n.*").groupBy("lv", *axes).count()
    stats = {r["lv"]: r for r in counts.groupBy("lv").agg(F.count("*").alias("cells"), F.max("count").alias("fullest"),
                                                          F.sum("count").alias("rows")).collect()}
    if not stats:
        return origins.join(items, F.lit(False)).drop(*at).withColumn("dist", distance).withColumn("rank", F.lit(1))
    total = stats[LEVELS[0]]["rows"]
    top = min((lv for lv in LEVELS if stats[lv]["cells"] <= TOP_NODES), default=LEVELS[0])
    bottom = next((lv for lv in LEVELS if lv <= top and stats[lv]["fullest"] <= LEAF_ITEMS), LEVELS[-1])
    steps = [lv for lv in LEVELS if bottom <= lv < top]

    def cells_at(level: int) -> DataFrame:
        return items.groupBy(*[c.alias(a) for a, c in zip(axes, _keys([F.col(x) for x in at], level))]).agg(
            F.count("*").alias("_n"))

    here = [f"_o{i}" for i in range(dims)]
    o = origins.select("*", *[c.alias(a) for a, c in zip(here, origin_at())])
    point = [F.col(h) for h in here]
    limit = F.lit(float("inf") if max_m is None else float(max_m))
    # A bounded search starts at the level whose cells are at least as wide as its circle, so it meets two of them per axis.
    wide = next((lv for lv in reversed(LEVELS) if max_m is not None and 2.0**lv >= 2 * (max_m + slack_m + ROUND_M)), LEVELS[0])
    if wide < top:
        bottom = min(bottom, wide)
        steps = [lv for lv in steps if lv < wide]
        top = wide
        frontier = o.withColumn("_reach", limit + F.lit(slack_m + ROUND_M))
        for a, h in zip(axes, here):
            cell = lambda c: F.floor(c / F.lit(2.0**wide)).cast("long")
            frontier = frontier.withColumn(a, F.explode(F.sequence(cell(F.col(h) - F.col("_reach")), cell(F.col(h) + F.col("_reach")))))
    else:
        # First level: at most TOP_NODES cells, held in the plan; bounds and pruning happen inside the row.
        roots = [tuple(r) for r in cells_at(top).collect()]
        nodes = F.array(*[F.struct(*[F.lit(int(v)).cast("long").alias(a) for a, v in zip([*axes, "_n"], root)]) for root in roots])
        seen = F.transform(nodes, lambda n: F.struct(
            _far(point, [n[a] for a in axes], top).alias("far"), _near(point, [n[a] for a in axes], top).alias("near"),
            *[n[a].alias(a) for a in axes], n["_n"].alias("_n")))
        o = o.withColumn("_seen", F.array_sort(seen))
        reach = F.aggregate(
            F.col("_seen"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("far")),
            lambda acc, x: F.struct(
                (acc["n"] + x["_n"]).alias("n"),
                F.when((acc["n"] < need) & (acc["n"] + x["_n"] >= need), x["far"]).otherwise(acc["far"]).alias("far")),
            lambda acc: acc["far"])
        o = o.withColumn("_reach", F.least(reach, limit) + F.lit(slack_m + ROUND_M))
        frontier = o.withColumn("_seen", F.explode(F.filter("_seen", lambda x: x["near"] <= F.col("_reach")))).select(
            *[c for c in o.columns if c not in ("_seen",)], *[F.col("_seen")[a].alias(a) for a in axes])

    # Descend: open each kept cell, tighten the reach from the counts, drop what lies beyond it.
    for above, level in zip([top, *steps], steps):
        table = cells_at(level).select(
            *[F.floor(F.col(a) / F.lit(2 ** (above - level))).cast("long").alias(a) for a in axes],
            *[F.col(a).alias(f"_k{a}") for a in axes], "_n")
        frontier = lookup_join(frontier, table, axes, stats[level]["cells"], key).drop(*axes)
        inner = [F.col(f"_k{a}") for a in axes]
        frontier = frontier.withColumn("_far", _far(point, inner, level)).withColumn("_near", _near(point, inner, level))
        frontier = frontier.where(F.col("_near") <= F.col("_reach"))
        by = Window.partitionBy(*key)
        frontier = frontier.withColumn("_upto", F.sum("_n").over(by.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0)))
        bound = F.min(F.when(F.col("_upto") >= need, F.col("_far"))).over(by)
        frontier = frontier.withColumn("_bound", bound).withColumn(
            "_reach", F.least(F.col("_reach"), F.coalesce("_bound", F.lit(float("inf"))) + F.lit(slack_m + ROUND_M)))
        frontier = frontier.where(F.col("_near") <= F.col("_reach")).drop("_n", "_far", "_near", "_upto", "_bound")
        for a in axes:
            frontier = frontier.withColumnRenamed(f"_k{a}", a)

    keyed = items.select("*", *[c.alias(a) for a, c in zip(axes, _keys([F.col(x) for x in at], bottom))])
    pairs = lookup_join(frontier, keyed, axes, total, key)
    gap = sum(((p - F.col(x)) * (p - F.col(x)) for p, x in zip(point, at)), F.lit(0.0))
    pairs = pairs.where(F.sqrt(gap) <= F.col("_reach") + F.lit(slack_m))
    if exclude is not None:
        pairs = pairs.where(~exclude)
    pairs = pairs.withColumn("dist", distance)
    if max_m is not None:
        pairs = pairs.where(F.col("dist") <= F.lit(float(max_m)))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    return pairs.drop(*axes, *at, *here, "_reach")


def within_pairs(a: DataFrame, b: DataFrame, r: float, *, a_at: Sequence[Column], b_at: Sequence[Column],
                 distance: Column, b_id: str | None, a_site: Sequence[str] = (), b_site: Sequence[str] = ()) -> DataFrame:
    """Every pair at most r metres apart, with dist. Cells are 2r wide, so each row of ``a`` meets at most two per
    axis; a cell of ``b`` with more than HOT_ROWS rows is split by hash and met by as many copies of ``a``'s row. Where
    ``a_site`` and ``b_site`` name the columns that fix the distance, every two places are met once."""
    if a_site and b_site:
        met = within_pairs(a.select(*a_site).distinct(), b.select(*b_site).distinct(), r, a_at=a_at, b_at=b_at, distance=distance, b_id=None)
        return a.join(met.join(b, list(b_site)), list(a_site)).select(*a.columns, *b.columns, "dist")
    axes = [f"_c{i}" for i in range(len(a_at))]
    side = F.lit(2.0 * r)
    left = a
    for name, c in zip(axes, a_at):
        left = left.withColumn(name, F.explode(F.sequence(F.floor((c - F.lit(r)) / side).cast("long"),
                                                          F.floor((c + F.lit(r)) / side).cast("long"))))
    right = b.select("*", *[F.floor(c / side).cast("long").alias(n) for n, c in zip(axes, b_at)])
    hot = right.groupBy(*axes).count().where(F.col("count") > HOT_ROWS).select(
        *axes, F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("_parts"))
    left = left.join(hot, axes, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    right = right.join(hot, axes, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*([b_id] if b_id else b.columns)), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return left.join(right, [*axes, "_salt"]).withColumn("dist", distance).where(F.col("dist") <= F.lit(r)).drop(*axes, "_salt")


# ------------------------------------------------------------------- box joins


def _box_level(w: Column, s: Column, e: Column, n: Column, floor_level: int) -> Column:
    """Level whose cell side is at least the box's longer side, so the box meets at most 2 x 2 cells."""
    size = F.greatest(e - w, n - s)
    return F.greatest(F.when(size > 0, F.ceil(F.log2(size))).otherwise(F.lit(floor_level)), F.lit(floor_level)).cast("int")


def _levels(df: DataFrame, box, floor_level: int) -> DataFrame:
    """One row holding the levels that boxes of a table have (at most about 40), found as part of the query."""
    return df.select(_box_level(*box, floor_level).alias("_lv")).agg(F.collect_set("_lv").alias("_levels")).withColumn("_one", F.lit(1))


def box_join(a: DataFrame, b: DataFrame, a_box: Sequence[Column], b_box: Sequence[Column], cond: Column,
             how: str = "inner", floor_level: int = 3) -> DataFrame:
    """Join rows whose boxes (west, south, east, north) overlap and satisfy ``cond``; how is inner, left_semi or
    left_anti, by ``a``'s first column as its key. Boxes of any mix of sizes: two boxes meet at the level of the larger one, where both cover at most
    2 x 2 cells. A semi or anti join stops at the first match, so no pairs are listed. Column names must differ.

    Nothing runs while the plan is built. A row goes to its own level and to those levels above it that the other side
    has, which a one-row aggregate of the other side tells; where ``a`` holds points (west and east are one column) its
    level is known, so ``a`` is read once however many joins are chained. Both sides of the cell join are plain shuffles,
    so adaptive execution may split a crowded cell."""
    points = a_box[0] is a_box[2] and a_box[1] is a_box[3]

    def spread(df: DataFrame, box, side: str, other: DataFrame | None) -> DataFrame:
        w, s, e, n = box
        df = df.select("*", _box_level(w, s, e, n, floor_level).alias(f"_own{side}"), *[c.alias(f"_{side}{k}") for k, c in zip("wsen", box)])
        lv = F.array(f"_own{side}")
        if other is not None:
            df = df.withColumn("_one", F.lit(1)).join(F.broadcast(other), "_one").drop("_one")
            lv = F.array_union(lv, F.filter("_levels", lambda p: p > F.col(f"_own{side}")))
        span = lambda lo, hi, cell: F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long"))

        def cells(level):
            cell = F.pow(F.lit(2.0), level)
            return F.flatten(F.transform(span(f"_{side}w", f"_{side}e", cell), lambda x: F.transform(span(f"_{side}s", f"_{side}n", cell), lambda y: F.struct(level.alias("_lv"), x.alias("_cx"), y.alias("_cy")))))

        df = df.withColumn("_cells", F.flatten(F.transform(lv, cells))).drop("_levels")
        return df.withColumn("_all", F.size("_cells")).withColumn("_cells", F.explode("_cells")).select("*", "_cells.*").drop("_cells")

    l = spread(a, a_box, "a", _levels(b, b_box, floor_level))
    r = spread(b, b_box, "b", None if points else _levels(a, a_box, floor_level)).drop("_all")
    overlap = (F.col("_aw") <= F.col("_be")) & (F.col("_ae") >= F.col("_bw")) & (F.col("_as") <= F.col("_bn")) & (F.col("_an") >= F.col("_bs"))
    # the pair meets once: in the cell holding the lower-left corner of the two boxes' common part
    once = (F.floor(F.greatest("_aw", "_bw") / F.pow(F.lit(2.0), l["_lv"])).cast("long") == l["_cx"]) & (
        F.floor(F.greatest("_as", "_bs") / F.pow(F.lit(2.0), l["_lv"])).cast("long") == l["_cy"])
    on = ((l["_lv"] == r["_lv"]) & (l["_cx"] == r["_cx"]) & (l["_cy"] == r["_cy"])
          & (l["_lv"] == F.greatest("_owna", "_ownb")) & overlap & once & cond)
    if how == "inner":
        return l.join(r, on).select(*[F.col(c) for c in a.columns], *[F.col(c) for c in b.columns])
    key = a.columns[0]
    if how == "left_semi":
        return l.join(r, on, "left_semi").select(*a.columns).dropDuplicates([key])
    # a row is free when it is free in every cell it was sent to
    left = l.join(r, on, "left_anti").groupBy(key).agg(F.count("*").alias("_free"), *[F.first(c).alias(c) for c in ["_all", *a.columns[1:]]])
    return left.where("_free = _all").select(*a.columns)

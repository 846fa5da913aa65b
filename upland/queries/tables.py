"""City-shaped views of the given tables, as DataFrames and as SQL text saying the same.

Coordinates are whole micro-degrees divided once, so both engines hold the same doubles. A line is 16 consecutive
order keys, so it stays short however many orders there are.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.functions.geo import EARTH_KM, planar_scale, planar_xy
from upland.operators import places as P
from upland.session import configure

K = planar_scale()


# ---------------------------------------------------------------- shared text


def ulng(k):
    return f"(120500000 + (({k}) * 7919 % 20000) * 10)"


def ulat(k):
    return f"(16300000 + (({k}) * 104729 % 20000) * 10)"


def deg(micro):
    return f"(CAST({micro} AS DOUBLE) / CAST(1000000 AS DOUBLE))"


def lng(k):
    return deg(ulng(k))


def lat(k):
    return deg(ulat(k))


def hav_km(a, b, c, d, radius=EARTH_KM):
    """SQL great-circle distance."""
    return (f"({2 * radius!r}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * "
            f"pow(sin(radians({c} - {a}) / 2), 2)))))")


def px_sql(lng_):
    return f"(({lng_} + 180) / 360 * {K!r}::DOUBLE)"


def py_sql(lat_):
    return f"(asinh(tan(radians({lat_}))) / {2 * math.pi!r}::DOUBLE * {K!r}::DOUBLE)"


def rnd(x, digits):
    """SQL rounding, halves up."""
    s = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def r(x, digits: int) -> Column:
    """The same rounding in Spark."""
    from upland.functions.geo import round_half_up
    return round_half_up(x, 10.0**digits)


def hhmm(k, step):
    return f"(lpad(CAST(({k} * {step}) % 24 AS VARCHAR), 2, '0') || ':00')"


def pick(k, values):
    """SQL CASE giving the k-th of a list."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {k} {whens} END)"


MARKET = dict(zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), P.VENUE_CATEGORIES))
HIGHWAYS = ("primary", "secondary", "tertiary", "residential", "service", "trunk", "unclassified", "living_street", "track", "pedestrian", "primary_link")
BUILDINGS = ("commercial", "house", "apartments", "yes", "hotel", "retail")
DX, DY = (200, 0, 150, 100), (0, 200, 150, -100)   # micro-degrees a vertex, by direction

DEST = f"""dest AS (SELECT s_suppkey AS id, 'place-' || s_suppkey AS slug, s_name AS name, {pick('s_nationkey % 8', P.CATEGORIES)} AS category,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE {pick('s_nationkey % 4', P.ERAS)} END AS era,
  CASE WHEN s_suppkey % 10 = 7 THEN NULL ELSE CAST(850 + (s_suppkey * 37) % 850 AS DOUBLE) END AS elevation,
  CASE WHEN s_suppkey % 6 <> 0 THEN {hhmm('s_suppkey', 5)} END AS open, CASE WHEN s_suppkey % 6 <> 0 THEN {hhmm('s_suppkey', 7)} END AS close,
  {lng('s_suppkey')} AS lng, {lat('s_suppkey')} AS lat FROM supplier)"""

VEN_CAT = "(CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MARKET.items()) + " END)"
VEN = f"""ven AS (SELECT c_custkey AS vid, 'venue-' || c_custkey AS vslug, c_name AS vname, {VEN_CAT} AS vcategory, CAST(1 + c_custkey % 4 AS INTEGER) AS price_range,
  CASE WHEN c_custkey % 6 <> 0 THEN {hhmm('c_custkey', 5)} END AS open, CASE WHEN c_custkey % 6 <> 0 THEN {hhmm('c_custkey', 7)} END AS close,
  {lng('c_custkey')} AS vlng, {lat('c_custkey')} AS vlat FROM customer)"""

STOP = f"""stop AS (SELECT o_orderkey AS stop_id, o_orderkey // 16 AS route, CAST(o_orderkey % 16 AS INTEGER) AS seq, 'Stop ' || o_orderkey AS sname,
  {lng('o_orderkey')} AS slng, {lat('o_orderkey')} AS slat FROM orders)"""

_L, _I = "(o_orderkey // 16)", "(o_orderkey % 16)"
_POS = f"(CASE WHEN {_L} % 5 = 0 AND {_I} > 8 THEN 16 - {_I} ELSE {_I} END)"


def _dir(values):
    return f"(CASE {_L} % 4 WHEN 0 THEN {values[0]} WHEN 1 THEN {values[1]} WHEN 2 THEN {values[2]} ELSE {values[3]} END)"


WIG = "((o_orderkey * 31) % 7)"
PATH = f"""path AS (SELECT {_L} AS code, CAST({_I} AS INTEGER) AS i,
  {deg(f"{ulng(_L)} + {_POS} * {_dir(DX)} + {WIG}")} AS lng, {deg(f"{ulat(_L)} + {_POS} * {_dir(DY)} + {WIG}")} AS lat FROM orders)"""
PPATH = PATH + f""", ppath AS (SELECT code, i, {px_sql('lng')} AS x, {py_sql('lat')} AS y FROM path)"""
SEG = PPATH + """, seg AS (SELECT p.code, p.i AS seg, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS len
  FROM ppath p JOIN ppath q ON p.code = q.code AND q.i = p.i + 1),
 aseg AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY code ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM seg)"""


def road_tag_sql():
    """road: one row per line with its tags."""
    return f"""road AS (SELECT DISTINCT {_L} AS code, {pick(f'{_L} % 11', HIGHWAYS)} AS highway,
  CASE WHEN {_L} % 9 = 0 THEN '2;3' WHEN {_L} % 9 = 1 THEN '2.0' WHEN {_L} % 9 = 2 THEN '4' END AS lanes, {_L} % 3 = 0 AS oneway,
  'Street ' || ({_L} % 50) AS street, CASE WHEN {_L} % 6 = 0 THEN 'concrete' END AS surface FROM orders)"""


ROAD = road_tag_sql()

_BX, _BY = f"({px_sql(deg(ulng('p_partkey') + ' + (p_partkey % 7) * 20'))})", f"({py_sql(deg(ulat('p_partkey') + ' + (p_partkey % 5) * 20'))})"
BLD = f"""bld AS (SELECT p_partkey AS bid, 'way/' || p_partkey AS oid, {_BX} AS cx, {_BY} AS cy, CAST(2 + p_size AS DOUBLE) AS side,
  CASE WHEN p_partkey % 7 = 0 THEN (5 + p_partkey % 20) || ' m' END AS t_height, CASE WHEN p_partkey % 5 = 0 THEN CAST(1 + p_partkey % 9 AS VARCHAR) END AS t_levels,
  {pick('p_partkey % 6', BUILDINGS)} AS building, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS t_name FROM part)"""

# The ground: a height for every pixel, stored in 1/256 m steps.
HEIGHT = "(1000 + 100 * sin({i} / 17.0::DOUBLE) + 50 * cos({j} / 23.0::DOUBLE))"


def height_sql(i, j):
    return f"(floor(({HEIGHT.format(i=i, j=j)} + 32768) * 256) / 256.0::DOUBLE - 32768)"


def pix_sql(lng_, lat_, z=14):
    n = f"{float(2 ** z * 256)!r}::DOUBLE"
    return f"(({lng_} + 180) / 360 * {n})", f"((1 - asinh(tan(radians({lat_}))) / {math.pi!r}::DOUBLE) / 2 * {n})"


def bilinear_sql(lng_, lat_, z=14):
    """Bilinear height in closed form: SQL needs no pixel table."""
    u, v = pix_sql(lng_, lat_, z)
    i, j = f"floor({u})", f"floor({v})"
    fu, fv = f"({u} - {i})", f"({v} - {j})"
    top = f"({height_sql(i, j)} * (1 - {fu}) + {height_sql(f'({i} + 1)', j)} * {fu})"
    bot = f"({height_sql(i, f'({j} + 1)')} * (1 - {fu}) + {height_sql(f'({i} + 1)', f'({j} + 1)')} * {fu})"
    return f"({top} * (1 - {fv}) + {bot} * {fv})"


CODES = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)
GRID_W, GRID_N, GRID_D = 120.5, 16.5, 0.0001
GRID = f"""grid AS (SELECT o_orderkey // 128 AS "row", o_orderkey % 128 AS "col",
  CASE (o_orderkey * 7919) % 11 {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(CODES))} END AS code FROM orders)"""

EV = """ev AS (SELECT event_id, ts, user_id, event_type, value FROM events)"""


def with_(*parts) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --------------------------------------------------------------------- Spark


def _micro(expr: str) -> Column:
    """The same text as a Spark expression: whole-number division is `div` there."""
    return F.expr(expr.replace("//", "div"))


def spark_sql(text: str) -> str:
    out = text.replace("//", "div").replace("::DOUBLE", "D").replace(" AS VARCHAR)", " AS STRING)")
    return out.replace('"row"', "row").replace('"col"', "col")


class Tables:
    """The given tables and the views above over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def raw(self, name: str) -> DataFrame:
        """A given table; instants stored without a zone are UTC."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])

    def _view(self, text: str, **tables) -> DataFrame:
        """Run one of the view texts: `name AS (SELECT ... FROM table)` over the given tables."""
        body = spark_sql(text.split(" AS (", 1)[1].rsplit(")", 1)[0])
        return self.spark.sql(body.replace(f"FROM {list(tables)[0]}", "FROM {t}"), t=list(tables.values())[0])

    @cached_property
    def dest(self) -> DataFrame:
        d = self._view(DEST, supplier=self.raw("supplier"))
        return d.select("*", F.when(F.col("open").isNotNull(), F.struct("open", "close")).alias("hours"))

    @cached_property
    def ven(self) -> DataFrame:
        d = self._view(VEN, customer=self.raw("customer"))
        return d.select("*", F.when(F.col("open").isNotNull(), F.struct("open", "close")).alias("hours"))

    @cached_property
    def stop(self) -> DataFrame:
        return self._view(STOP, orders=self.raw("orders"))

    @cached_property
    def path(self) -> DataFrame:
        return self._view(PATH, orders=self.raw("orders"))

    @cached_property
    def lines(self) -> DataFrame:
        """code, line (lng/lat) with at most 16 vertices."""
        v = self.path.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("i", "lng", "lat"))).alias("v"))
        return v.select("code", F.transform("v", lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("line"))

    @cached_property
    def roads(self) -> DataFrame:
        """Lines in the planar frame with road tags."""
        tags = self._view(ROAD.replace("SELECT DISTINCT", "SELECT"), orders=self.raw("orders"))
        first = tags.where(F.lit(True)).groupBy("code").agg(*[F.first(c).alias(c) for c in ("highway", "lanes", "oneway", "street", "surface")])
        return self.planar_lines.join(first, "code")

    @cached_property
    def planar_lines(self) -> DataFrame:
        def xy(p):
            x, y = planar_xy(p["lng"], p["lat"])
            return F.struct(x.alias("x"), y.alias("y"))
        return self.lines.select("code", F.transform("line", xy).alias("line"))

    @cached_property
    def segs(self) -> DataFrame:
        from upland.operators.lines import segments
        return segments(self.planar_lines, "code")

    @cached_property
    def bld(self) -> DataFrame:
        """Square buildings in the planar frame with their edges and box."""
        from upland.operators.rings import edges
        # narrow rows are dealt out before outlines are made of them: a small file is one split, whatever its number of rows
        b = self._view(BLD, part=self.raw("part")).repartition("bid")
        h = F.col("side") / 2
        corner = lambda sx, sy: F.struct((F.col("cx") + sx * h).alias("x"), (F.col("cy") + sy * h).alias("y"))
        b = b.withColumn("ring", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)))
        return b.withColumn("edges", edges("ring")).select("*", (F.col("cx") - h).alias("w"), (F.col("cy") - h).alias("s"),
                                                           (F.col("cx") + h).alias("e"), (F.col("cy") + h).alias("n"))

    def pixels(self, points: DataFrame, z: int = 14, reach: int = 1) -> DataFrame:
        """The height pixels under and beside a set of points (lng, lat), as a three-byte pixel table."""
        from upland.functions.geo import pixel_xy
        u, v = pixel_xy("lng", "lat", z)
        at = points.select(F.floor(u).cast("long").alias("i"), F.floor(v).cast("long").alias("j")).distinct()
        span = F.sequence(F.lit(-reach + 1), F.lit(reach))
        at = at.withColumn("a", F.explode(span)).withColumn("b", F.explode(span)).select((F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j")).distinct()
        h = F.expr(HEIGHT.format(i="i", j="j").replace("::DOUBLE", "D"))
        code = F.floor((h + 32768) * 256)
        return at.select(F.lit(z).alias("z"), F.expr("i div 256").alias("x"), F.expr("j div 256").alias("y"), F.expr("i % 256").alias("px"), F.expr("j % 256").alias("py"),
                         F.floor(code / 65536).cast("int").alias("r"), (F.floor(code / 256) % 256).cast("int").alias("g"), (code % 256).cast("int").alias("b"))

    def heights(self, points: DataFrame, z: int = 14, reach: int = 1) -> DataFrame:
        from upland.operators.raster import read_heights
        return read_heights(self.pixels(points, z, reach))

    @cached_property
    def grid(self) -> DataFrame:
        return self._view(GRID, orders=self.raw("orders"))

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").select("event_id", "ts", "user_id", "event_type", "value")

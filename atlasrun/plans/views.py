"""The input views of the registered queries, over the folder of parquet tables.

Each view exists twice: as a DataFrame method and as SQL text with the same formula.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let

EPOCH_MS = 1704067200000


def epoch_millis(column: str) -> Column:
    """Milliseconds since 1970 of a time without zone, read as UTC whatever the session's zone is."""
    return F.unix_millis(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


class Tables:
    """Lazily read tables and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def attempts(self) -> DataFrame:
        """Answer log with verdicts; every run starts at 0 and has ten targets."""
        millis = epoch_millis("ts")
        return self.read("events").select(
            F.col("user_id").alias("run_id"), (F.col("user_id") % 5).alias("quiz_id"), F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "view", "read-elapsed").otherwise("submit").alias("type"),
            (F.floor((millis - EPOCH_MS) / 1000) - F.when(F.col("event_id") % 17 == 0, 60000).otherwise(0)).alias("ts_ms"),
            F.when(F.col("event_type") == "purchase", True)
            .when(F.col("event_type").isin("click", "error"), False).alias("is_correct"),
            F.lit(10).cast("bigint").alias("total"))

    @cached_property
    def actions(self) -> DataFrame:
        """Full action log: starts, answers, clock reads, forced completions, resets, empty quizzes."""
        millis = epoch_millis("ts")
        kind = F.col("event_type")
        turn = F.floor(F.col("value")).cast("bigint") % 4
        action = (F.when(kind == "signup", "start").when(kind == "view", "read-elapsed")
                  .when((kind == "error") & (turn == 0), "reset")
                  .when((kind == "error") & (turn == 1), "complete-debug").otherwise("submit"))
        return self.read("events").select(
            F.col("user_id").alias("run_id"), (F.col("user_id") % 5).alias("quiz_id"), F.col("event_id").alias("seq"),
            action.alias("type"),
            (F.floor((millis - EPOCH_MS) / 1000) - F.when(F.col("event_id") % 17 == 0, 60000).otherwise(0)).alias("ts_ms"),
            F.when(kind == "purchase", True).when(kind == "click", False).alias("is_correct"),
            (F.col("user_id") % 5).alias("total"))

    @cached_property
    def scores(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderpriority").alias("quiz_id"), F.col("o_custkey").cast("string").alias("username"),
            F.floor("o_totalprice").cast("double").alias("score"),
            F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") * 31 % 10001).cast("double") / 10000).alias("accuracy"),
            ((F.col("o_orderkey") * 7919) % 600000).cast("double").alias("elapsed_ms"),
            epoch_millis("o_orderdate").cast("double").alias("created_at"),
            F.col("o_orderkey").cast("string").alias("id"))

    @cached_property
    def texts(self) -> DataFrame:
        return self.read("documents").select("doc_id", "text")

    @cached_property
    def places(self) -> DataFrame:
        """Catalog: one location per nation, in key order."""
        return self.read("nation").select(
            F.concat(F.lit("iso:"), F.col("n_name")).alias("location_id"), F.col("n_name").alias("iso3"),
            F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("pos"))

    @cached_property
    def quizzes(self) -> DataFrame:
        """One quiz per region plus the world quiz in front."""
        regions = self.read("region").select(
            F.col("r_name").alias("quiz_id"), F.concat("r_name", F.lit(" UN Countries")).alias("name"),
            (F.col("r_regionkey") + 1).cast("bigint").alias("quiz_pos"),
            F.when(F.col("r_regionkey") > 0, "regional").alias("category"))
        world = self.read("region").where(F.col("r_regionkey") == 0).select(
            F.lit("world").alias("quiz_id"), F.lit("World UN Countries").alias("name"),
            F.lit(0).cast("bigint").alias("quiz_pos"), F.lit(None).cast("string").alias("category"))
        return regions.unionByName(world)

    @cached_property
    def members(self) -> DataFrame:
        """Quiz membership with positions."""
        nation, region = self.read("nation"), self.read("region")
        location = F.concat(F.lit("iso:"), F.col("n_name")).alias("location_id")
        pos = F.col("n_nationkey").cast("bigint").alias("pos")
        regional = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("r_name").alias("quiz_id"), pos, location)
        return regional.unionByName(nation.select(F.lit("world").alias("quiz_id"), pos, location))

    @cached_property
    def features(self) -> DataFrame:
        """Boundary features: one per supplier, keyed by its nation and a group code."""
        supplier, nation = self.read("supplier"), self.read("nation")
        key = F.col("s_suppkey")
        return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("ne:"), key.cast("string")).alias("feature_id"), key.alias("feature_pos"),
            F.col("n_name").alias("code"), F.concat(F.lit("S"), (key % 7).cast("string")).alias("group_code"),
            F.struct(((key * 7919 % 36000) / 100.0 - 180).alias("x"), ((key * 104729 % 17000) / 100.0 - 85).alias("y")).alias("anchor"),
            F.when(key % 3 == 0, F.concat(F.lit("Supplier path "), key.cast("string"))).alias("path_text"))

    @cached_property
    def part_features(self) -> DataFrame:
        """Supplemental features: one per part, with code, label and type."""
        return self.read("part").select(
            F.concat(F.lit("ne:admin1:"), F.col("p_partkey").cast("string")).alias("feature_id"),
            F.col("p_partkey").alias("feature_pos"), F.col("p_brand").alias("code"), F.col("p_name").alias("label"),
            F.col("p_type").alias("kind"), F.col("p_size").cast("bigint").alias("size"))

    @cached_property
    def candidates(self) -> DataFrame:
        """One candidate per distinct part name with its first brand as declared code."""
        return self.read("part").groupBy("p_name").agg(F.min("p_brand").alias("code")).select(
            F.col("p_name").alias("name"), "code")

    @cached_property
    def points(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.alias("point_id"), ((key * 7919 % 36000) / 100.0 - 180).alias("lon"),
            ((key * 104729 % 17000) / 100.0 - 85).alias("lat"))

    @cached_property
    def raw_rings(self) -> DataFrame:
        """Open vertex lists: 32 points of each embedding."""
        coords = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
            (F.get(F.col("embedding"), i * 2).cast("double") * 180).alias("x"),
            (F.get(F.col("embedding"), i * 2 + 1).cast("double") * 90).alias("y")))
        return self.read("embeddings").select(F.col("vec_id").alias("ring_id"), F.col("label").cast("bigint").alias("label"),
                                              coords.alias("points"))

    @cached_property
    def rings(self) -> DataFrame:
        """Closed rings, mostly self-crossing."""
        return self.raw_rings.select("ring_id", "label", F.concat("points", F.slice("points", 1, 1)).alias("ring"))

    @cached_property
    def star_rings(self) -> DataFrame:
        """The same vertices ordered by angle around their mean, closed: mostly simple rings."""
        def mean(points):
            total = F.aggregate(points, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
                                lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
            return let(total, lambda s: F.struct((s["x"] / F.size(points)).alias("x"), (s["y"] / F.size(points)).alias("y")))

        def turned(points):
            return let(mean(points), lambda centre: F.array_sort(F.transform(points, lambda p: F.struct(
                F.round(F.atan2(p["y"] - centre["y"], p["x"] - centre["x"]), 9).alias("angle"),
                p["x"].alias("x"), p["y"].alias("y")))))

        def closed(points):
            bare = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
            return let(bare, lambda r: F.concat(r, F.slice(r, 1, 1)))

        return self.raw_rings.select("ring_id", "label", let(F.col("points"), lambda r: let(turned(r), closed)).alias("ring"))

    @cached_property
    def boundary_features(self) -> DataFrame:
        """Nested features: a polygon with a hole (16 and 8 vertices) and an island (8 vertices)."""
        def ring(points, first: int, count: int):
            return F.concat(F.slice(points, first, count), F.slice(points, first, 1))

        nested = let(F.col("ring"), lambda r: F.array(F.array(ring(r, 1, 16), ring(r, 17, 8)), F.array(ring(r, 25, 8))))
        first = F.col("polygons")[0][0][0]
        return self.star_rings.select(
            F.concat(F.lit("ne:"), F.col("ring_id").cast("string")).alias("feature_id"), F.col("ring_id").alias("feature_pos"),
            nested.alias("polygons")).select(
            "feature_id", "feature_pos", F.when(F.col("feature_pos") % 3 > 0, first["x"]).alias("label_x"),
            first["y"].alias("label_y"), "polygons")

    @cached_property
    def components(self) -> DataFrame:
        """Open boundaries in degrees, five to a location; every tenth location lies on the seam."""
        place = F.floor(F.col("ring_id") / 5).cast("bigint")
        slot = F.col("ring_id") % 5
        grow = (1 + F.col("ring_id") % 8).cast("double")
        on_seam = place % 10 == 0
        base_x = F.when(on_seam, F.lit(179.0)).otherwise((place * 7919 % 36000) / 100.0 - 180)
        base_y = F.when(on_seam, F.lit(0.0)).otherwise((place * 104729 % 17000) / 100.0 - 85)

        def wrap(x):
            return F.when(x >= 180.0, x - 360.0).when(x < -180.0, x + 360.0).otherwise(x)

        moved = F.transform("points", lambda p: F.struct(
            (wrap(F.col("bx") + F.col("slot") * 1.5 + p["x"] / 180 * F.col("grow")) + 180.0).alias("x"),
            (90.0 - (F.col("by") + p["y"] / 90 * F.col("grow"))).alias("y")))
        return (self.raw_rings.withColumns({"location_id": place, "slot": slot.cast("double"), "grow": grow, "bx": base_x, "by": base_y})
                .select("location_id", F.col("ring_id").alias("component_id"), F.col("slot").cast("bigint").alias("pos"),
                        moved.alias("points")))


# --- the same views as SQL -------------------------------------------------------------------

_SECONDS = ("((epoch_ms(ts) - 1704067200000) // 1000) - (CASE WHEN event_id % 17 = 0 THEN 60000 ELSE 0 END)")

ATTEMPTS = f"""attempts AS (
  SELECT user_id AS run_id, user_id % 5 AS quiz_id, event_id AS seq,
         CASE WHEN event_type = 'view' THEN 'read-elapsed' ELSE 'submit' END AS type, {_SECONDS} AS ts_ms,
         CASE WHEN event_type = 'purchase' THEN true WHEN event_type IN ('click', 'error') THEN false END AS is_correct,
         10 AS total
  FROM events)"""

ACTIONS = f"""actions AS (
  SELECT user_id AS run_id, user_id % 5 AS quiz_id, event_id AS seq,
         CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'view' THEN 'read-elapsed'
              WHEN event_type = 'error' AND floor(value)::BIGINT % 4 = 0 THEN 'reset'
              WHEN event_type = 'error' AND floor(value)::BIGINT % 4 = 1 THEN 'complete-debug' ELSE 'submit' END AS type,
         {_SECONDS} AS ts_ms,
         CASE WHEN event_type = 'purchase' THEN true WHEN event_type = 'click' THEN false END AS is_correct,
         user_id % 5 AS total
  FROM events)"""

SCORES = """scores AS (
  SELECT o_orderpriority AS quiz_id, o_custkey::VARCHAR AS username, floor(o_totalprice) AS score,
         CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 31 % 10001)::DOUBLE / 10000 END AS accuracy,
         ((o_orderkey * 7919) % 600000)::DOUBLE AS elapsed_ms, epoch_ms(o_orderdate)::DOUBLE AS created_at,
         o_orderkey::VARCHAR AS id
  FROM orders)"""

PLACES = """places AS (
  SELECT 'iso:' || n_name AS location_id, n_name AS iso3, n_name AS name, n_nationkey::BIGINT AS pos FROM nation)"""

QUIZZES = """quizzes AS (
  SELECT r_name AS quiz_id, r_name || ' UN Countries' AS name, (r_regionkey + 1)::BIGINT AS quiz_pos,
         CASE WHEN r_regionkey > 0 THEN 'regional' END AS category FROM region
  UNION ALL SELECT 'world', 'World UN Countries', 0, NULL FROM region WHERE r_regionkey = 0)"""

MEMBERS = """members AS (
  SELECT r_name AS quiz_id, n_nationkey::BIGINT AS pos, 'iso:' || n_name AS location_id
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'world', n_nationkey::BIGINT, 'iso:' || n_name FROM nation)"""

FEATURES = """features AS (
  SELECT 'ne:' || s_suppkey AS feature_id, s_suppkey AS feature_pos, n_name AS code, 'S' || (s_suppkey % 7) AS group_code,
         (s_suppkey * 7919 % 36000) / 100.0::DOUBLE - 180 AS ax, (s_suppkey * 104729 % 17000) / 100.0::DOUBLE - 85 AS ay,
         CASE WHEN s_suppkey % 3 = 0 THEN 'Supplier path ' || s_suppkey END AS path_text
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

PART_FEATURES = """part_features AS (
  SELECT 'ne:admin1:' || p_partkey AS feature_id, p_partkey AS feature_pos, p_brand AS code, p_name AS label, p_type AS kind,
         p_size::BIGINT AS size FROM part)"""

CANDIDATES = "candidates AS (SELECT p_name AS name, min(p_brand) AS code FROM part GROUP BY p_name)"

POINTS = """points AS (
  SELECT c_custkey AS point_id, (c_custkey * 7919 % 36000) / 100.0::DOUBLE - 180 AS lon,
         (c_custkey * 104729 % 17000) / 100.0::DOUBLE - 85 AS lat FROM customer)"""

# One row per vertex, in order; i runs from 0.
RAW_VERTICES = """raw_vertices AS (
  SELECT vec_id AS ring_id, label::BIGINT AS label, i, embedding[2*i+1]::DOUBLE * 180 AS x, embedding[2*i+2]::DOUBLE * 90 AS y
  FROM embeddings, (SELECT unnest(range(32)) AS i))"""

STAR_VERTICES = """centres AS (
  SELECT ring_id, list_reduce(list(x ORDER BY i), lambda a, b: a + b) / 32 AS cx,
         list_reduce(list(y ORDER BY i), lambda a, b: a + b) / 32 AS cy FROM raw_vertices GROUP BY ring_id),
star_vertices AS (
  SELECT ring_id, label, row_number() OVER (PARTITION BY ring_id ORDER BY round(atan2(y - cy, x - cx), 9), x, y) - 1 AS i, x, y
  FROM raw_vertices JOIN centres USING (ring_id))"""

# Closed rings of the nested features, with ids.
BOUNDARY_VERTICES = STAR_VERTICES + """,
ring_parts AS (SELECT * FROM (VALUES (0, 0, 0, 0, 16), (0, 1, 1, 16, 8), (1, 0, 2, 24, 8)) AS v(polygon_pos, ring_pos, part_pos, start, n)),
boundary_vertices AS (
  SELECT 'ne:' || ring_id AS feature_id, 'ne:' || ring_id || ':polygon:' || polygon_pos AS polygon_id,
         'ne:' || ring_id || ':polygon:' || polygon_pos || ':ring:' || ring_pos AS ring_id,
         polygon_pos, ring_pos, part_pos, n, k AS i, x, y
  FROM star_vertices JOIN (SELECT *, unnest(range(n + 1)) AS k FROM ring_parts) ON i = start + k % n)"""

# Component boundaries, map coordinates of a world 360 wide.
COMPONENT_VERTICES = """component_vertices AS (
  SELECT location_id, ring_id AS component_id, slot AS pos, i,
         (CASE WHEN wx >= 180 THEN wx - 360 WHEN wx < -180 THEN wx + 360 ELSE wx END) + 180 AS x, 90 - wy AS y
  FROM (SELECT ring_id, ring_id // 5 AS location_id, ring_id % 5 AS slot, i,
               (CASE WHEN (ring_id // 5) % 10 = 0 THEN 179.0::DOUBLE ELSE ((ring_id // 5) * 7919 % 36000) / 100.0::DOUBLE - 180 END)
                 + (ring_id % 5) * 1.5::DOUBLE + x / 180 * (1 + ring_id % 8) AS wx,
               (CASE WHEN (ring_id // 5) % 10 = 0 THEN 0.0::DOUBLE ELSE ((ring_id // 5) * 104729 % 17000) / 100.0::DOUBLE - 85 END)
                 + y / 90 * (1 + ring_id % 8) AS wy
        FROM raw_vertices))"""

"""Catalog, candidates, quizzes and other configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .gate import admitted, violations

LOCATIONS = ("array<struct<id:string,iso3:string,name:string,geometryRefs:array<string>,anchor:array<double>,"
             "bounds:array<double>>>")
QUIZZES = ("array<struct<id:string,name:string,description:string,category:string,locationIds:array<string>,"
           "map:struct<contextFeatureExclusions:array<string>,baseLayerLocationIds:array<string>,viewBox:string,"
           "preserveAspectRatio:string,standardParallel:double,wrapWidth:double,seamLongitude:double,"
           "wrapActive:boolean,selectable:boolean>>>")


def _parsed(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """``file, place, row, problem``: the elements of JSON array files; a broken document is one row, and so is an empty one without place."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim(F.col("value"), F.lit(" \t\r\n\ufeff")).alias("text"))
    options = {"columnNameOfCorruptRecord": "_broken"}
    element = schema.removeprefix("array<").removesuffix(">")
    files = texts.withColumns({"rows": F.from_json("text", schema, options), "parts": F.from_json("text", "array<string>", options)})
    whole = F.col("text").startswith("[") & F.col("rows").isNotNull() & F.col("parts").isNotNull()
    one = F.array(F.from_json(F.lit(None).cast("string"), element))
    placed = files.select("file", whole.alias("_whole"), F.posexplode_outer(F.when(whole, F.col("rows")).otherwise(one)).alias("place", "row"))
    problem = (F.when(~F.col("_whole"), "malformed").when(F.col("place").isNull(), None).when(F.col("row").isNull(), "not an object")
               .when(F.coalesce(F.trim(F.col(f"row.{key}")), F.lit("")) == "", f"no {key}"))
    return placed.select("file", "place", "row", problem.alias("problem"))


def rejected_documents(spark: SparkSession, path: str, schema: str = LOCATIONS) -> DataFrame:
    """Violations: documents that are no JSON arrays, and elements that are no objects or have no id."""
    return violations(_parsed(spark, path, schema))


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of JSON array files, numbered without gaps over files by name and places in a file.

    They are read here and now, through the gate (:mod:`.gate`): a malformed document is an error, not an empty one.
    """
    rows = admitted(_parsed(spark, path, schema), "documents")
    if rows.isEmpty():  # also a document without a byte
        raise ValueError(f"no document in {path}")
    rows = rows.where("place is not null")
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    starts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "file").select((F.col("start") + F.col("place")).alias("pos"), "row.*")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``location_id, iso3, name, pos`` in file order."""
    return _documents(spark, path, LOCATIONS).select(F.col("id").alias("location_id"), "iso3", "name", "pos")


def _bounds(values: Column) -> Column:
    return F.struct(*[F.get(values, i).alias(n) for i, n in enumerate(("min_x", "min_y", "max_x", "max_y"))])


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Location documents with their own references, anchor and bounds."""
    rows = _documents(spark, path, LOCATIONS)
    return rows.select(F.col("id").alias("location_id"), "iso3", "name", "pos", F.col("geometryRefs").alias("geometry_refs"),
                       F.struct(F.get("anchor", 0).alias("x"), F.get("anchor", 1).alias("y")).alias("anchor"), _bounds(F.col("bounds")).alias("bounds"))


def location_refs(locations: DataFrame) -> DataFrame:
    """References of location documents, one row each, in order."""
    return locations.select("location_id", F.posexplode("geometry_refs").alias("ref_pos", "feature_id")).select(
        "location_id", "feature_id", F.col("ref_pos").cast("bigint").alias("ref_pos"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate rows of quoted CSV files; absent values are empty, flags boolean, codes an array.

    Lines with too few or too many fields and rows without a name are an error, here and now.
    """
    header = spark.read.csv(path, header=True, quote='"', escape='"').schema
    read = spark.read.schema(f"{header.simpleString()[7:-1].replace(':', ' ')}, _broken string")
    parsed = read.csv(path, header=True, quote='"', escape='"', columnNameOfCorruptRecord="_broken", enforceSchema=False)
    problem = F.when(F.col("_broken").isNotNull(), "malformed line").when(F.coalesce(F.trim("entity"), F.lit("")) == "", "no entity")
    rows = admitted(parsed.select(F.col("_metadata.file_path").alias("file"), "*", problem.alias("problem")).drop("_broken"), "candidates").drop("file").na.fill("")
    codes = F.filter(F.transform(F.split("iso_3166_2_codes", ";"), lambda c: F.trim(c)), lambda c: c != "")
    flags = {name: F.col(name).try_cast("boolean") for name in ("iso_3166_1", "un_m49", "world_bank", "iso_3166_2_autonomous")}
    return rows.withColumns({**flags, "source_count": F.col("source_count").try_cast("int"), "codes": codes,
                             "name": F.col("entity"), "iso2": F.nullif(F.col("iso_3166_1_code"), F.lit(""))})


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed references (``location_id, ref_pos, feature_id``) from a document keyed by location."""
    from ..operators.resolve import override_rows

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,array<string>>").alias("overrides"))
    return override_rows(admitted(texts.withColumn("problem", F.when(F.col("overrides").isNull(), "malformed")), "overrides").select("overrides"))


def read_quizzes(spark: SparkSession, path: str) -> DataFrame:
    """Quiz definitions in order, map settings as a nullable struct."""
    rows = _documents(spark, path, QUIZZES)
    m = "map."
    settings = F.struct(F.col(m + "viewBox").alias("view_box"), F.col(m + "preserveAspectRatio").alias("preserve_aspect_ratio"),
                        F.col(m + "standardParallel").alias("standard_parallel"), F.col(m + "wrapWidth").alias("wrap_width"),
                        F.col(m + "seamLongitude").alias("seam_longitude"), F.col(m + "wrapActive").alias("wrap_active"),
                        F.col(m + "selectable").alias("selectable"), F.col(m + "contextFeatureExclusions").alias("exclusions"),
                        F.col(m + "baseLayerLocationIds").alias("base_layers"))
    return rows.select(F.col("id").alias("quiz_id"), "name", "description", "category", F.col("pos").alias("quiz_pos"),
                       F.col("locationIds").alias("location_ids"), F.when(F.col("map").isNotNull(), settings).alias("map"))


def quiz_members(quizzes: DataFrame) -> DataFrame:
    """Members of each quiz with their positions."""
    return quizzes.select("quiz_id", F.posexplode("location_ids").alias("pos", "location_id")).select(
        "quiz_id", F.col("pos").cast("bigint").alias("pos"), "location_id")


def quiz_exclusions(quizzes: DataFrame) -> DataFrame:
    """Context features each quiz leaves out."""
    return quizzes.select("quiz_id", F.explode("map.exclusions").alias("feature_id"))


def quiz_base_layers(quizzes: DataFrame) -> DataFrame:
    """Locations each quiz draws as its base, in order."""
    return quizzes.select("quiz_id", F.posexplode("map.base_layers").alias("pos", "location_id"))

"""Boundary files and their checksums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geometry import points_from_pairs
from ..functions.names import code_keys, feature_id, split_labels
from ..functions.arrays import present
from .gate import admitted, violations

POLYGON = "array<array<array<double>>>"
MULTI_POLYGON = "array<array<array<array<double>>>>"

# The property columns that hold codes, names and label positions.
KEY_PROPERTIES = ("ISO_A3", "ADM0_A3", "SOV_A3", "GU_A3")
CODE_PROPERTIES = ("iso_3166_2", "ISO_A2", "ISO_A2_EH", "iso_a2", "SU_A3", "ADM0_A3", "adm0_a3")
SUPPLEMENT_KEYS = ("iso_3166_2", "ISO_A2", "ISO_A2_EH", "SU_A3", "ADM0_A3", "adm0_a3", "name", "name_en", "NAME", "NAME_LONG",
                   "SUBUNIT", "shapeID", "shapeName", "shapeISO", "shapeGroup", "shapeType")
LABEL_PROPERTIES = ("iso_3166_2", "name", "name_en", "name_alt", "NAME", "NAME_LONG", "SUBUNIT", "shapeName")
ID_PROPERTIES = ("NE_ID", "ne_id", "adm1_code", "shapeID")


# Property names differ only in case in places, and most are unused: a map keeps them apart.
FEATURE_SCHEMA = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
COLLECTION_SCHEMA = f"type string, features array<struct<{FEATURE_SCHEMA}>>"
SHAPES = ("Polygon", "MultiPolygon")
# Files from this size on do not fit in a record; they are read in pieces.
MOST_BYTES, PIECE_BYTES = 2_000_000_000, 8 << 20


def polygons_from(kind: Column, coordinates: Column) -> Column:
    """Coordinates text as polygons of rings of points; a single polygon becomes a list of one."""
    one = F.from_json(coordinates, POLYGON)
    single = F.when(one.isNotNull(), F.array(one))
    many = F.from_json(coordinates, MULTI_POLYGON)
    nested = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", many)
    return F.transform(nested, lambda polygon: F.transform(polygon, points_from_pairs))


def _parsed(spark: SparkSession, paths: str | list[str], lines: bool) -> DataFrame:
    """``file, block, row, properties, geometry_type, polygons, problem`` of every feature; one that cannot be used has a problem.

    ``block`` is where the part of the file begins that Spark read as one, ``row`` the order inside it. Sorted by
    both, features are in file order, however files are split.
    """
    if lines:
        rows = spark.read.text(paths).select(
            F.regexp_replace(F.trim("value"), ",$", "").alias("text"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        # Blank lines and the first and last line of a wrapper are not features.
        rows = rows.where(~F.col("text").rlike(r'^(\{\s*"type":\s*"FeatureCollection".*\[|\]\s*\}?|)$'))
        parsed = rows.withColumn("feature", F.from_json("text", FEATURE_SCHEMA + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}))
        broken = F.col("feature._broken").isNotNull()
    else:
        whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("bigint").alias("block"),
                                                              F.from_json("value", COLLECTION_SCHEMA)["features"].alias("features"))
        nothing = F.array(F.from_json(F.lit(None).cast("string"), FEATURE_SCHEMA))
        parsed = whole.select("file", "block", F.posexplode(F.coalesce("features", nothing)).alias("row", "feature"))
        broken = F.lit(False)
    shape = F.col("feature.geometry")
    parsed = parsed.select("file", "block", F.col("row").cast("bigint").alias("row"), F.col("feature.properties").alias("properties"), shape["type"].alias("geometry_type"),
                           polygons_from(shape["type"], shape["coordinates"]).alias("polygons"), (F.col("feature").isNull() | broken).alias("_malformed"), shape.isNull().alias("_bare"))
    problem = (F.when(F.col("_malformed"), "malformed").when(F.col("_bare"), "no geometry")
               .when(~F.coalesce(F.col("geometry_type").isin(*SHAPES), F.lit(False)), "not a polygon")
               .when(F.col("polygons").isNull(), "malformed coordinates"))
    return parsed.withColumn("problem", problem).drop("_malformed", "_bare")


def rejected_features(spark: SparkSession, paths: str | list[str], *, lines: bool = True) -> DataFrame:
    """Violations: what :func:`read_features` cannot use, with its file and the reason."""
    return violations(_parsed(spark, paths, lines))


def read_features(spark: SparkSession, paths: str | list[str], *, lines: bool = True) -> DataFrame:
    """Features of GeoJSON files: one per line (splittable, for large data) or whole collections.

    ``feature_pos`` orders features everywhere downstream: files by name, then places in the file, without gaps. It
    does not depend on how files are split. The sources are read here and now, through the gate (:mod:`.gate`): a malformed
    feature or one without a polygon is an error whatever is read later, and all of them are set aside. Features are numbered within each part of a file, after the
    number of features in the parts before it.
    """
    parsed = admitted(_parsed(spark, paths, lines), "features")
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)  # a row for each part of a file
    starts = parsed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(W.partitionBy("file", "block").orderBy("row")) - 1
    return parsed.join(starts, ["file", "block"]).select(place.alias("feature_pos"), "properties", "geometry_type", "polygons")


def _texts(names: tuple[str, ...]) -> list[Column]:
    return [_property(n) for n in names]


def _property(name: str) -> Column:
    return F.element_at("properties", name)


def country_features(raw: DataFrame, prefix: str = "ne") -> DataFrame:
    """Base features: id, keys, label position and polygons."""
    return raw.select(
        feature_id(F.lit(prefix), None, _property("NE_ID")).alias("feature_id"), "feature_pos",
        code_keys(*_texts(KEY_PROPERTIES)).alias("keys"), _property("LABEL_X").try_cast("double").alias("label_x"),
        _property("LABEL_Y").try_cast("double").alias("label_y"), "polygons")


def supplemental_features(raw: DataFrame, source: str, prefix: str = "ne") -> DataFrame:
    """Supplemental features of one source with codes, keys and labels."""
    return raw.select(
        feature_id(F.lit(prefix), F.lit(source), *_texts(ID_PROPERTIES)).alias("feature_id"), "feature_pos",
        F.lit(source).alias("source"), _property("iso_3166_2").alias("code"),
        present(*_texts(CODE_PROPERTIES)).alias("source_codes"), F.array_distinct(present(*_texts(SUPPLEMENT_KEYS))).alias("keys"),
        split_labels(*_texts(LABEL_PROPERTIES)).alias("labels"), split_labels(_property("name_alt")).alias("alternate_labels"),
        _property("LABEL_X").try_cast("double").alias("label_x"), _property("LABEL_Y").try_cast("double").alias("label_y"), F.col("polygons").alias("geometry"))


def _bare(path: str) -> str:
    return re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", path).rstrip("/")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each file, read a piece at a time."""
    for batch in batches:
        found = []
        for path in batch["path"].to_pylist():
            store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path) if path.startswith("file:") else path)
            digest = hashlib.sha256()
            with store.open_input_stream(place) as file:
                while piece := file.read(PIECE_BYTES):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(found, pa.string())], names=["path", "sha256"])


def file_digests(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``path, file, sha256`` of all files under a folder, or of one file; ``file`` is relative to the folder.

    Each file is hashed on an executor. One of ``most_bytes`` or more does not fit in a record and is read a piece at a time, by way
    of Arrow's file systems (local or mounted paths, ``hdfs``, ``s3``, ``gs``); a task has one such file. Spark lists no files without a byte, so those are missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hashed = files.where(F.col("length") < most_bytes).select("path", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") >= most_bytes).select("path").repartition("path").mapInArrow(_streamed, "path string, sha256 string")
    bare, top = F.regexp_replace("path", r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", ""), _bare(root)
    below = F.when(bare == top, F.regexp_extract(bare, r"([^/]+)$", 1)).otherwise(F.substr(bare, F.lit(len(top) + 2)))
    return hashed.unionByName(large).select("path", below.alias("file"), "sha256")


def digest_violations(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that differ from the digests pinned in the manifest (``file, sha256``), are missing, or are not listed there."""
    have = digests.select("file", F.col("sha256").alias("have"))
    joined = manifest.select("file", F.col("sha256").alias("want")).join(have, "file", "full_outer")
    detail = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "not listed").otherwise(F.col("have"))
    return joined.where(~F.col("have").eqNullSafe(F.col("want"))).select(
        F.lit("checksum").alias("rule"), F.col("file").alias("entity"), detail.alias("detail"))


def read_checked_features(spark: SparkSession, root: str, manifest: DataFrame, *, lines: bool = True) -> DataFrame:
    """Features of the files under a folder, if those are just the listed ones with the pinned digests.

    Anything else is an error before reading, which names every file at fault. A manifest has a row per file.
    """
    digests = file_digests(spark, root)
    bad = digest_violations(digests, manifest).orderBy("entity").collect()
    if bad:
        raise ValueError("source checksum mismatch: " + ", ".join(f"{r.entity} is {r.detail}" for r in bad))
    return read_features(spark, [r.path for r in digests.select("path").orderBy("file").collect()], lines=lines)

"""The build job on small sources, and what stays in force when one goes wrong."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from atlasrun.jobs import build
from atlasrun.operators import quality
from atlasrun.sources import gate, publish
from test_sources import FEATURES, SQUARE, feature, write


@pytest.fixture
def sources(spark, tmp_path):
    def digests(folder):
        rows = [(str(f.relative_to(folder)), hashlib.sha256(f.read_bytes()).hexdigest()) for f in sorted(folder.rglob("*.json"))]
        return spark.createDataFrame(rows, "file string, sha256 string")

    base, more = tmp_path / "base", tmp_path / "more"
    for folder, some in ((base, FEATURES), (more, [
            feature("Polygon", SQUARE, ne_id=1, iso_3166_2="ES-CN", iso_a2="ES", name="Canary Islands"), feature("Polygon", SQUARE, ne_id=2, iso_3166_2="US-AL", iso_a2="US", name="Alabama"),
            feature("Polygon", SQUARE, ne_id=3, iso_3166_2="ZZ-ZZ", iso_a2="ZZ", name="Elsewhere")])):
        folder.mkdir()
        (folder / "f.json").write_text("\n".join(map(json.dumps, some)))
    (tmp_path / "c.csv").write_text("entity,iso_3166_1,un_m49,world_bank,iso_3166_2_autonomous,source_count,iso_3166_1_code,iso_3166_2_codes,iso_3166_2_categories\n"
                                    "Canary Islands,False,False,False,True,1,,ES-CN,Region\n")
    return build.Sources(
        features=str(base), digests=digests(base), supplements={"admin1": str(more)}, supplement_digests={"admin1": digests(more)},
        catalog=write(tmp_path / "catalog.json", [{"id": "iso:A", "iso3": "AAA", "name": "Aland"}, {"id": "iso:B", "iso3": "BBB", "name": "Bland"}]),
        locations=write(tmp_path / "l.json", [{"id": "US-AL", "name": "Alabama", "geometryRefs": ["ne:admin1:2"], "anchor": [1.5, 2], "bounds": [0, 1, 2, 3]}]),
        candidates=str(tmp_path / "c.csv"), overrides=write(tmp_path / "o.json", {"iso:B": ["ne:12", "ne:11"]}),
        quizzes=write(tmp_path / "q.json", [{"id": "world", "name": "World", "locationIds": ["iso:B", "iso:A"]}, {"id": "s", "name": "S", "locationIds": ["US-AL"]}]))


def test_a_build_is_published_whole_or_not_at_all(spark, tmp_path, sources):
    out = str(tmp_path / "out")
    done = build.build(spark, sources, out, "one")
    assert done["number"] == 0 and done["header"] == {"locations": {"standard": 2, "candidates": 1, "configured": 1, "total": 4}}
    refs = publish.read_published(spark, out, "location_refs")
    assert sorted((r.location_id, r.feature_id) for r in refs.collect()) == [
        ("US-AL", "ne:admin1:2"), ("candidate:canary-islands", "ne:admin1:1"), ("iso:A", "ne:11"), ("iso:B", "ne:11"), ("iso:B", "ne:12")]
    assert {r.feature_id for r in publish.read_published(spark, out, "features").collect()} == {"ne:11", "ne:12", "ne:admin1:1", "ne:admin1:2"}
    assert all(r.bounds is not None for r in publish.read_published(spark, out, "locations").collect())

    # A broken rule: a quiz names a location that is not there.
    good = sources.quizzes
    sources.quizzes = write(tmp_path / "q2.json", [{"id": "world", "name": "World", "locationIds": ["iso:B", "iso:X"]}])
    with pytest.raises(publish.BuildRefused, match="iso:X") as refused:
        build.build(spark, sources, out, "two")
    assert spark.read.parquet(refused.value.violations).where("detail like '%iso:X%' or entity like '%iso:X%'").count() > 0
    # A damaged source stops before any table.
    sources.quizzes = write(tmp_path / "q3.json", "nonsense")
    with pytest.raises(gate.SourceFault):
        build.build(spark, sources, out, "three")
    assert publish.manifest(spark, out)["build"] == "one" and publish.read_published(spark, out, "quizzes").count() == 2

    sources.quizzes = good
    assert build.build(spark, sources, out, "four")["number"] == 1
    with pytest.raises(ValueError, match="in force already"):
        build.build(spark, sources, out, "four")


def test_manifests_are_never_written_over(spark, tmp_path):
    out, table = str(tmp_path / "out"), spark.createDataFrame([(2,), (1,)], "id long")

    def put(name, rule=lambda t: quality.unique(t["t"], "id")):
        return publish.publish(spark, out, name, {"t": table}, {"t": ["id"]}, rule)

    assert publish.manifest(spark, out) is None
    with pytest.raises(ValueError, match="no published table"):
        publish.read_published(spark, out, "t")
    put("a")

    def overtaken(tables):
        publish._commit(spark, out, 1, {"build": "b", "tables": {}})  # someone else publishes while this build is checked
        return quality.unique(tables["t"], "id")

    with pytest.raises(ValueError, match="meanwhile"):
        put("c", overtaken)
    assert publish.manifest(spark, out)["build"] == "b"
    put("d")
    assert publish.clean_builds(spark, out, keep=1) == ["a", "b"] and publish.read_published(spark, out, "t").count() == 2
    with pytest.raises(publish.BuildRefused, match="unique"):
        publish.publish(spark, out, "e", {"t": table.union(table)}, {"t": ["id"]}, lambda t: quality.unique(t["t"], "id"))
    assert publish.manifest(spark, out)["build"] == "d" and publish.read_published(spark, out, "t").agg(F.max("id")).first()[0] == 2

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from atlasrun.operators import quality, resolve, rings
from atlasrun.sources import artifacts, boundaries, config, gate

SQUARE = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]
HOLED = [SQUARE[0], [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 2.0]]]


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


FEATURES = [
    feature("Polygon", HOLED, NE_ID=11, ISO_A3="AAA", ADM0_A3="AAA", SOV_A3="-99", LABEL_X=5.0, LABEL_Y=5.0),
    feature("MultiPolygon", [SQUARE, [[[20.0, 0.0], [30.0, 0.0], [30.0, 5.0], [20.0, 0.0]]]], NE_ID=12, ISO_A3="-99", ADM0_A3="BBB", LABEL_X=None, LABEL_Y=2.0)]


def write(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("lines", [True, False])
def test_features_from_both_layouts(spark, tmp_path, lines):
    path = tmp_path / "f.json"
    path.write_text("\n".join(json.dumps(f) for f in FEATURES) if lines else json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    table = boundaries.country_features(boundaries.read_features(spark, str(path), lines=lines)).orderBy("feature_pos")
    rows = table.collect()
    assert [(r.feature_id, r["keys"], r.label_x, len(r.polygons), len(r.polygons[0])) for r in rows] == [
        ("ne:11", ["AAA"], 5.0, 1, 2), ("ne:12", ["BBB"], None, 2, 1)]
    parts = rings.build_parts(table, 0.5)
    assert sorted(r.part_id for r in parts.collect()) == ["ne:11:part:0", "ne:11:part:1", "ne:12:part:0", "ne:12:part:1"]
    built = {r.feature_id: r for r in rings.build_features(table, parts).collect()}
    assert tuple(built["ne:11"].anchor) == (740.0, 340.0) and tuple(built["ne:12"].anchor) == (720.0, 320.0)
    assert tuple(built["ne:12"].bounds) == (720.0, 320.0, 840.0, 360.0)
    assert parts.where("part_id = 'ne:12:part:1'").first().path == "M800,360L840,360L840,340L800,360Z"


def supplement(spark, tmp_path):
    items = [
        feature("Polygon", SQUARE, ne_id=1, iso_3166_2="ES-TF", iso_a2="ES", name="Tenerife", name_alt="Isla|Canaria;x"),
        feature("Polygon", SQUARE, ne_id=2, iso_3166_2="NC-X", iso_a2="NC", name="New Caledonia"),
        feature("Polygon", SQUARE, ne_id=3, iso_3166_2="CA-BC", iso_a2="CA", name="British Columbia", name_alt="New Caledonia"),
        feature("Polygon", SQUARE, adm1_code="IT-23", iso_3166_2="IT-23", iso_a2="IT", name="Aosta Valley"),
        feature("Polygon", SQUARE, shapeID="99", shapeName="Kósovo", shapeISO="XK")]
    path = tmp_path / "s.json"
    path.write_text("\n".join(json.dumps(f) for f in items))
    return boundaries.supplemental_features(boundaries.read_features(spark, str(path)), "admin1")


def test_candidates_by_precedence(spark, tmp_path):
    features = supplement(spark, tmp_path)
    table = tmp_path / "c.csv"
    table.write_text('entity,iso_3166_1,un_m49,world_bank,iso_3166_2_autonomous,source_count,iso_3166_1_code,iso_3166_2_codes,iso_3166_2_categories\n'
                     'Canary Islands,False,False,False,True,1,,ES-CN,Region\n'
                     'New Caledonia,True,True,True,False,3,NC,,"Country, ""special"""\n'
                     'Valle d’Aosta,False,False,False,True,1,,IT-99; IT-98,\n'
                     'Kosovo,True,False,False,False,1,XK,,\n', encoding="utf-8")
    candidates = config.read_candidates(spark, str(table))
    first = {r.name: r for r in candidates.collect()}
    assert first["New Caledonia"].un_m49 is True and first["New Caledonia"].iso_3166_2_categories == 'Country, "special"'
    assert first["Valle d’Aosta"].codes == ["IT-99", "IT-98"] and first["Kosovo"].iso2 == "XK" and first["Canary Islands"].iso2 is None
    exact = spark.createDataFrame([("Kosovo", "ne:admin1:99")], "name string, feature_id string")
    parts = spark.createDataFrame([("Canary Islands", "ES-TF", 0), ("Canary Islands", "ES-GC", 1)], "name string, key string, key_pos int")
    aliases = spark.createDataFrame([("Valle d’Aosta", "Aosta Valley")], "name string, alias string")
    matches = resolve.candidate_matches(candidates, features, exact, parts, aliases)
    assert sorted((r.name, r.feature_id, r.tier) for r in matches.collect()) == [
        ("Canary Islands", "ne:admin1:1", "parts"), ("Kosovo", "ne:admin1:99", "exact"), ("New Caledonia", "ne:admin1:2", "match"),
        ("New Caledonia", "ne:admin1:3", "match"), ("Valle d’Aosta", "ne:admin1:IT-23", "match")]
    clash = resolve.ambiguous_matches(candidates, features, matches, aliases)
    assert [(r.name, r.feature_id) for r in clash.collect()] == [("New Caledonia", "ne:admin1:3")]


def test_preferred_geometry(spark, tmp_path):
    features = supplement(spark, tmp_path).withColumn("geometry", F.col("feature_id"))
    better = spark.createDataFrame([("ES-TF", 1, "older"), ("ES-TF", 2, "better"), ("ES-TF", 0, "oldest")], "code string, feature_pos int, geometry string")
    chosen = {r.feature_id: (r.geometry, r.geometry_source) for r in resolve.prefer_geometry(features, better, "gb:x").collect()}
    assert chosen["ne:admin1:1"] == ("better", "gb:x") and chosen["ne:admin1:2"] == ("ne:admin1:2", "admin1") and len(chosen) == 5


def test_config_documents(spark, tmp_path):
    catalog = config.read_catalog(spark, write(tmp_path / "a.json", [{"id": "iso:B", "iso3": "BBB", "name": "Bé"}, {"id": "iso:A", "iso3": "AAA", "name": "A"}]))
    assert [(r.location_id, r.pos) for r in catalog.orderBy("pos").collect()] == [("iso:B", 0), ("iso:A", 1)]
    places = config.read_locations(spark, write(tmp_path / "l.json", [
        {"id": "US-AL", "name": "Alabama", "geometryRefs": ["x:1", "x:0"], "anchor": [1.5, 2], "bounds": [0, 1, 2, 3]}]))
    assert [(r.feature_id, r.ref_pos) for r in config.location_refs(places).orderBy("ref_pos").collect()] == [("x:1", 0), ("x:0", 1)]
    assert tuple(places.first().bounds) == (0, 1, 2, 3)
    overrides = config.read_overrides(spark, write(tmp_path / "o.json", {"iso:A": ["p:1", "p:0"]}))
    assert [(r.location_id, r.ref_pos, r.feature_id) for r in overrides.orderBy("ref_pos").collect()] == [("iso:A", 0, "p:1"), ("iso:A", 1, "p:0")]
    quizzes = config.read_quizzes(spark, write(tmp_path / "q.json", [
        {"id": "world", "name": "World UN Countries", "description": "d", "locationIds": ["iso:B", "iso:A"]},
        {"id": "states", "name": "States", "category": "regional", "locationIds": ["US-AL"], "map": {
            "contextFeatureExclusions": ["ne:1"], "baseLayerLocationIds": ["US-AL"], "viewBox": "-100 35 671.9444444444445 295", "standardParallel": 38,
            "wrapWidth": 1440, "seamLongitude": 0, "selectable": True}}]))
    members = config.quiz_members(quizzes)
    assert [(r.quiz_id, r.pos, r.location_id) for r in members.orderBy("quiz_id", "pos").collect()] == [
        ("states", 0, "US-AL"), ("world", 0, "iso:B"), ("world", 1, "iso:A")]
    maps = {r.quiz_id: r for r in resolve.quiz_maps(quizzes).collect()}
    assert maps["world"].view is None and maps["world"].seam_longitude == 152.0 and maps["world"].wrap_active
    assert maps["states"].view.max_x == pytest.approx(571.9444) and maps["states"].standard_parallel == 38.0 and maps["states"].selectable
    assert [r.feature_id for r in config.quiz_exclusions(quizzes).collect()] == ["ne:1"]
    assert config.quiz_base_layers(quizzes).count() == 1
    found = quality.quiz_inputs(quizzes, members, resolve.all_locations(catalog, places).select("location_id", "name"))
    assert found.count() == 0


def test_checksums(spark, tmp_path):
    root = tmp_path / "in put"
    texts = {"f.json": FEATURES[:1], "sub/f.json": FEATURES[1:]}
    digest = {}
    for name, some in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("\n".join(json.dumps(f) for f in some))
        digest[name] = hashlib.sha256((root / name).read_bytes()).hexdigest()

    def manifest(**changed):
        return spark.createDataFrame(list({**digest, **changed}.items()), "file string, sha256 string")

    assert boundaries.read_checked_features(spark, str(root), manifest()).count() == 2
    one = spark.createDataFrame([("f.json", digest["f.json"])], "file string, sha256 string")
    assert boundaries.read_checked_features(spark, str(root / "f.json"), one).count() == 1
    # Equal base names are told apart, and a file that is not listed is a fault.
    bad = boundaries.digest_violations(boundaries.file_digests(spark, str(root)), manifest(**{"f.json": digest["sub/f.json"], "gone.json": "1"}))
    assert sorted((r.entity, r.detail) for r in bad.collect()) == [("f.json", digest["f.json"]), ("gone.json", "missing")]
    (root / "extra.json").write_text("{}")
    with pytest.raises(ValueError, match="extra.json is not listed"):
        boundaries.read_checked_features(spark, str(root), manifest())
    with pytest.raises(ValueError, match="checksum mismatch: extra.json is not listed, f.json is .*, gone.json is missing"):
        boundaries.read_checked_features(spark, str(root), manifest(**{"f.json": "0", "gone.json": "1"}))


@pytest.mark.parametrize("lines", [True, False])
def test_unusable_features(spark, tmp_path, lines):
    good, path = FEATURES[0], tmp_path / "f.json"
    odd = [{**good, "geometry": None}, {"type": "Feature", "properties": {}}, feature("Point", [1, 2]), feature("Polygon", "x")]
    if lines:
        path.write_text("\n".join(['{"type": "FeatureCollection", "features": [', json.dumps(good) + ",", "", *map(json.dumps, odd), '{"type": "Feat', "]}"]))
    else:
        path.write_text(json.dumps({"features": [good, *odd]}))
        (tmp_path / "g.json").write_text('{"features": [')
    found = sorted(r.detail for r in boundaries.rejected_features(spark, str(tmp_path), lines=lines).collect())
    assert found == ["malformed", "malformed coordinates", "no geometry", "no geometry", "not a polygon"]
    # Nothing is handed out, however little of it would be read.
    with pytest.raises(gate.SourceFault, match="unusable features: 5 faults") as caught:
        boundaries.read_features(spark, str(tmp_path), lines=lines).select("polygons")
    assert sorted(r.detail for r in gate.quarantined(spark, caught.value).collect()) == found


@pytest.mark.parametrize("read", [lambda t: t.count(), lambda t: t.select("polygons").collect(), lambda t: t.limit(1).collect()])
def test_no_read_is_too_narrow_for_the_gate(spark, tmp_path, read):
    path = tmp_path / "f.json"
    path.write_text("\n".join([*map(json.dumps, FEATURES), '{"type": "Feat']))
    with pytest.raises(gate.SourceFault):
        read(boundaries.country_features(boundaries.read_features(spark, str(path))))
    path.write_text("\n".join(map(json.dumps, FEATURES)))
    read(boundaries.country_features(boundaries.read_features(spark, str(path))))


def test_broken_documents_are_told(spark, tmp_path):
    texts = {"a": '[{"id": "x", "name": "X"}]', "b": "[]", "c": " ", "d": "{}", "e": '[{"id": "y"}', "f": '[{"id": "y"}, {"name": "Z"}, {"id": " "}, 7]', "g": '{"id": "q"}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = sorted((r.entity[-6:-5], r.detail) for r in config.rejected_documents(spark, str(tmp_path)).collect())
    assert [g for g in got if g[0] not in "f"] == [("c", "malformed"), ("d", "malformed"), ("e", "malformed"), ("g", "malformed")]
    assert ("f", "no id") in got or ("f", "malformed") in got
    with pytest.raises(gate.SourceFault, match="malformed"):
        config.read_catalog(spark, str(tmp_path))
    assert [r.location_id for r in config.read_catalog(spark, str(tmp_path / "a.json")).collect()] == ["x"]
    assert config.read_catalog(spark, str(tmp_path / "b.json")).count() == 0
    (tmp_path / "empty.json").write_text("")
    with pytest.raises(ValueError, match="no document"):
        config.read_catalog(spark, str(tmp_path / "empty.json"))
    for name, broken, read in (("q", '[{"id": "w"', config.read_quizzes), ("l", "nonsense", config.read_locations), ("o", '{"a": ["x"]', config.read_overrides),
                               ("c", "entity,source_count,iso_3166_2_codes\nA,1,x\nB,1,x,too,many\n", config.read_candidates)):
        with pytest.raises(gate.SourceFault):
            path = tmp_path / f"broken-{name}"
            path.write_text(broken)
            read(spark, str(path))


def test_digests_of_large_files(spark, tmp_path):
    for k, size in enumerate((5, 1, 70_000, 20 << 20)):
        (tmp_path / f"f {k}.bin").write_bytes(bytes([k]) * size)
    plain = {r.file: r.sha256 for r in boundaries.file_digests(spark, str(tmp_path)).collect()}
    assert plain == {f"f {k}.bin": hashlib.sha256((tmp_path / f"f {k}.bin").read_bytes()).hexdigest() for k in range(4)}
    assert {r.file: r.sha256 for r in boundaries.file_digests(spark, str(tmp_path), most_bytes=2).collect()} == plain


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    for name, begin in (("b.json", 100), ("a.json", 0)):
        (tmp_path / name).write_text("\n".join(json.dumps(feature("Polygon", SQUARE, NE_ID=begin + k)) for k in range(60)))
    before, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("1g", "1500b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = boundaries.read_features(spark, str(tmp_path)).select("feature_pos", F.col("properties.NE_ID").cast("int").alias("id")).collect()
            seen.append(sorted(tuple(r) for r in rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] == [(k, k if k < 60 else k + 40) for k in range(120)]


def test_documents_are_numbered_over_files(spark, tmp_path):
    for name, ids in (("b.json", "xy"), ("a.json", "pqr")):
        write(tmp_path / name, [{"id": i, "iso3": i, "name": i} for i in ids])
    rows = config.read_catalog(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.location_id) for r in rows] == list(enumerate("pqrxy"))


def test_artifacts(spark, tmp_path):
    refs = spark.createDataFrame([("b", 0, "f2"), ("a", 1, "f1"), ("a", 0, "f3")], "location_id string, ref_pos bigint, feature_id string")
    features = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "feature_id string")
    sources = spark.createDataFrame([("s", "u", "h", "free", "who")], "source string, url string, sha256 string, license string, attribution string")
    moved = spark.createDataFrame([("gb:x", "f1")], "geometry_source string, feature_id string")
    tables = artifacts.manifest_tables(sources, moved, refs, features)
    for turn in (1, 2):
        artifacts.write_manifest(tables, str(tmp_path / "m"))
        back = spark.read.json(str(tmp_path / "m" / "location_refs"))
        assert [(r.location_id, r.ref_pos) for r in back.orderBy("location_id", "ref_pos").collect()] == [("a", 0), ("a", 1), ("b", 0)]
    header = artifacts.manifest_header(sources, refs, features).first()
    assert (header.references, header.locations, header.features, header.generated_at, header.sources[0].sha256) == (3, 2, 3, "deterministic", "h")
    out = str(tmp_path / "p")
    artifacts.write_table(refs, out, order=["location_id", "ref_pos"], partition="location_id")
    artifacts.write_table(refs.where("location_id = 'a'").withColumn("feature_id", F.lit("new")), out, order=["location_id", "ref_pos"], partition="location_id")
    assert sorted((r.location_id, r.feature_id) for r in spark.read.parquet(out).collect()) == [("a", "new"), ("a", "new"), ("b", "f2")]

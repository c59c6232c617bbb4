from pyspark.sql import functions as F

from atlasrun.functions import names
from atlasrun.operators import search


def texts(spark, rows, expression):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(expression).collect()]


def test_name_key(spark):
    cases = {"Côte": "cote", "Côte": "cote", "SÃO": "sao", "Türkiye": "turkiye", "á̈": "a", "Cote d'Ivoire": "cote divoire",
             "Cote d’Ivoire": "cote divoire", "Timor-Leste": "timorleste", "Timor—Leste": "timorleste", "U.S.A.": "usa", "مُصر": "مُصر",
             "ø ł ß": "ø ł ß", "  x\ty \n": "x\ty", "a.́": "á"}
    assert texts(spark, list(cases), names.name_key(F.col("t"))) == list(cases.values())


def test_label_key_and_slug(spark):
    assert texts(spark, ["Castile and León", "ﬁne №1", None], names.label_key(F.col("t"))) == ["castileandleon", "fineno1", None]
    assert texts(spark, ["Curaçao", "Åland Islands", "-x-", "Bolzano/South Tyrol"], names.slug_id(F.col("t"))) == [
        "non-un:curac-ao", "non-un:a-land-islands", "non-un:x", "non-un:bolzano-south-tyrol"]


def test_codes(spark):
    row = spark.range(1).select(
        names.code_keys(F.lit("AAA"), F.lit("-99"), F.lit(None).cast("string"), F.lit("AAA"), F.lit("")).alias("keys"),
        names.split_labels(F.lit("a|b;"), F.lit(None).cast("string"), F.lit("c")).alias("labels"),
        names.country_codes(F.array(F.lit("us-mi"), F.lit("GB"), F.lit("-99"))).alias("countries"),
        names.feature_id(F.lit("gb"), F.lit("x"), F.lit(None).cast("bigint"), F.lit("7")).alias("id")).first()
    assert (row["keys"], row["labels"], row["countries"], row["id"]) == (["AAA"], ["a", "b", "c"], ["US", "GB", ""], "gb:x:7")


def suggestions(spark, catalog, queries, limit=8):
    items = spark.createDataFrame([(i, n, p) for p, (i, n) in enumerate(catalog)], "item_id string, name string, pos bigint")
    asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(queries)], "query_id string, text string")
    found = search.suggest(asked, items, limit).orderBy("query_id", "rank").collect()
    return [[r.item_id for r in found if r.query_id == str(i)] for i in range(len(queries))]


def test_suggestions(spark):
    catalog = [("a", "Alpha"), ("b", "Bravo"), ("c", "Alpine"), ("d", "Albatross"), ("x", "Côte d’Ivoire")]
    assert suggestions(spark, catalog, [" alpine", "alpha", "al", "cote d'ivoire", "cote divoire", "cote ivoire", "zz", "br"]) == [
        ["c"], ["a"], ["d", "a", "c"], ["x"], ["x"], [], [], ["b"]]
    assert suggestions(spark, catalog, ["a", "bravo", "", "!"], limit=2) == [["d", "a"], ["b"], ["a", "b"], ["a", "b"]]


def test_suggestions_equal_a_full_scan(spark):
    catalog = [(f"n{i}", f"{'ab' * (i % 4)}{i:03d}{'xyz'[i % 3]}") for i in range(120)]
    queries = [name[k:k + n] for _, name in catalog[::7] for k in (0, 2) for n in (1, 2, 3, 5, 7)]
    expected = []
    for query in queries:
        hits = [(name != query, name, item) for item, name in catalog if query in name]
        expected.append([item for _, _, item in sorted(hits)[:8]])
    assert suggestions(spark, catalog, queries) == expected

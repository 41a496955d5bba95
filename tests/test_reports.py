"""Documents: the same bytes under any partitioning, names in order at every level."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions.documents import canonical, number
from plumbline.plans import fixtures as fx
from plumbline.sources import reports


def test_numbers_have_one_format(spark):
    values = [0.0, -0.0, 1.5, -2.25, 0.0000005, -0.0000001, 123456789.123456, -1e-6, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(number(F.col("x"))).collect()]
    assert got == ["0.000000", "0.000000", "1.500000", "-2.250000", "0.000001", "0.000000", "123456789.123456", "-0.000001", None]
    for bad in (float("nan"), float("inf"), 1e15):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "x double").select(number(F.col("x"))).collect()


def test_names_are_in_order_at_every_level(spark):
    df = spark.sql("""SELECT named_struct('z', array(named_struct('b', 1, 'a', 'q"\\\\x'), NULL), 'm', map('y', 1.0D, 'x', CAST(NULL AS DOUBLE)), 'd', DATE'2024-01-02',
                      'none', CAST(NULL AS STRING), 'flag', true) AS s""")
    value = df.select(canonical(F.col("s"), df.schema["s"].dataType)).first()[0]
    assert value == '{"d":"2024-01-02","flag":true,"m":{"x":null,"y":1.000000},"none":null,"z":[{"a":"q\\"\\\\x","b":1},null]}'
    assert json.loads(value)["z"][0]["a"] == 'q"\\x'


def test_sections(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string").repartition(3)
    doc = reports.document("k", {"all": reports.rows(df, ["n"]), "none": reports.single(df.filter("n > 5")), "one": reports.single(df.filter("n = 1")),
                                 "empty": reports.rows(df.filter("n > 5"), ["n"])}, {"seed": 3, "a": "x"}).first()
    assert doc["value"] == '{"all":[{"n":1,"s":"a"},{"n":2,"s":"b"}],"artifact_version":1,"empty":[],"kind":"k","none":null,"one":{"n":1,"s":"a"},"provenance":{"a":"x","seed":3}}'
    with pytest.raises(Exception, match="several"):
        reports.single(df).collect()
    with pytest.raises(ValueError, match="kind"):
        reports.document("k", {"kind": reports.rows(df, ["n"])})


def test_a_fit_gives_the_same_bytes_under_any_partitioning(spark, data, tmp_path):
    def documents(parts):
        records = fx.records_long(spark, data).repartition(parts)
        return {r["kind"]: r["value"] for r in reports.fit_documents(records, fx.CHEAP, fx.STRONG, fx.LADDER, fx.STRONG, 0.7).collect()}

    first, second = documents(1), documents(17)
    assert first == second and set(first) == {"pareto", "policy"}
    pareto, policy = json.loads(first["pareto"]), json.loads(first["policy"])
    assert len(pareto["points"]) == 42 and {p["split"] for p in pareto["points"]} == {"dev", "test"}
    if pareto["chosen"]["threshold"] is None:
        assert pareto["held_out"] is None
    else:
        assert pareto["held_out"]["threshold"] == pareto["chosen"]["threshold"]
    assert {r["route_key"] for r in policy["rungs"]} == {r["route_key"] for r in policy["routes"]}


def test_a_document_is_one_line_of_one_file(spark, tmp_path):
    doc = reports.document("k", {"all": reports.rows(spark.range(3).withColumnRenamed("id", "n"), ["n"])})
    reports.write_document(doc, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == [doc.first()["value"]]

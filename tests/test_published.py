"""Published sets: manifests, secrets at any depth, and what an audit must not lose."""

import json

import pytest
from pyspark.sql import functions as F

from quaymark.functions import digests, nested, text
from quaymark.sources import publish

DEEP = "endpoints array<struct<path:string,notes:map<string,array<struct<said:string>>>>>, n int"


def deep(spark, said, key="k"):
    return spark.createDataFrame([([("/a", {key: [(said,)], "other": None}), None], 1), (None, 2)], DEEP)


def test_secrets_are_hidden_at_any_depth(spark, tmp_path):
    df = deep(spark, "x password=hunter2 y", "api_key=abc")
    assert nested.rows_with(df, text.secret_like).count() == 1
    publish.publish(spark, f"file://{tmp_path}/out", {"a": df})
    written = "".join(p.read_text() for p in tmp_path.rglob("*.json"))
    assert "hunter2" not in written and "abc" not in written and '"said":"x password=[REDACTED] y"' in written and '"api_key=[REDACTED]"' in written
    assert publish.require_manifest(spark, f"{tmp_path}/out") == ["a"]


def test_keys_that_become_equal_are_one(spark):
    df = spark.createDataFrame([({"password=a": "1", "password=b": "2"},)], "m map<string,string>")
    assert list(nested.mapped(df, text.redact).first().m) == ["password=[REDACTED]"]


def test_a_secret_that_comes_back_stops_the_publication(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/out"
    publish.publish(spark, target, {"a": deep(spark, "fine")})
    before = sorted((p.name, p.read_text()) for p in tmp_path.rglob("*.json"))
    monkeypatch.setattr(publish, "redacted", lambda df: df)
    with pytest.raises(publish.SecretFound):
        publish.publish(spark, target, {"a": deep(spark, "password=hunter2")})
    assert sorted((p.name, p.read_text()) for p in tmp_path.rglob("*.json")) == before


def test_a_changed_row_or_a_lost_part_stops_the_publication(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    publish.publish(spark, target, {"a": deep(spark, "old"), "b": deep(spark, "old")})

    def flip(staging):
        for p in tmp_path.rglob("*.json"):
            if "staging" in str(p) and "/a/" in str(p) and "fine" in p.read_text():
                p.write_text(p.read_text().replace("fine", "find"))
                (p.parent / f".{p.name}.crc").unlink(missing_ok=True)

    def drop(staging):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{staging}/b")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    for spoil in (flip, drop):
        with pytest.raises(publish.NotWhole):
            publish.publish(spark, target, {"a": deep(spark, "fine"), "b": deep(spark, "fine")}, check=spoil)
        assert "old" in "".join(p.read_text() for p in tmp_path.rglob("*.json")) and publish.require_manifest(spark, f"{tmp_path}/out") == ["a", "b"]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_digests_do_not_depend_on_order_but_on_every_row(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("t"), F.when(F.col("id") % 3 == 0, 1).alias("n"))
    one = digests.set_digest(rows, []).first()
    assert digests.set_digest(rows.orderBy(F.desc("id")).repartition(7), []).first() == one
    for other in (rows.where("id <> 5"), rows.union(rows.where("id = 5")), rows.withColumn("t", F.when(F.col("id") == 5, "x").otherwise(F.col("t"))), rows.withColumn("n", F.coalesce("n", F.lit(0)))):
        assert digests.set_digest(other, []).first().digest != one.digest
    assert digests.set_digest(rows.limit(0), []).first().rows == 0
    assert json.loads(rows.select(digests.row_text(rows.columns)).first()[0]) == {"id": 0, "n": 1, "t": "0"}

"""Total orders: numbers over partitions, and single files."""

from pyspark.sql import functions as F

from quaymark.sources import ordered


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("a"), (F.col("id") % 3).alias("b"))
    found = ordered.numbered(rows, ["b", "a"]).collect()
    assert [(r.b, r.a) for r in sorted(found, key=lambda r: r.number)] == sorted((r.b, r.a) for r in found) and sorted(r.number for r in found) == list(range(1, 5001))
    assert ordered.numbered(rows.limit(0), ["b", "a"]).collect() == []


def test_lines_become_one_file_in_order(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 5).select("id", F.when(F.col("id") % 100 != 7, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("line"))
    target = tmp_path / "page.txt"
    target.write_text("old")
    ordered.write_lines(spark, f"file://{target}", rows.orderBy(F.rand(3)), ["id"])
    assert target.read_text().split("\n") == [f"é{k}" for k in range(3000) if k % 100 != 7] + [""]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["page.txt"]
    ordered.write_lines(spark, f"file://{target}", rows.limit(0), ["id"])
    assert target.read_text() == ""

from starlode.functions.predicates import Range
from starlode.operators import bitmap
from starlode.streaming import upkeep


def test_index_of_a_stream(spark, tmp_path):
    layout = {"v": bitmap.Bins((0, 5, 10))}
    source, schema = str(tmp_path / "rows"), "row_id long, v long"
    for lo, hi in ((1, 30001), (30001, 40001)):
        spark.range(lo, hi).selectExpr("id as row_id", "id % 10 as v").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upkeep.keep(stream, layout, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    index = upkeep.current(spark, str(tmp_path / "index"))
    assert bitmap.cardinality(Range("v", 0, 5), index, layout, 40000).first()["possible"] == 20000

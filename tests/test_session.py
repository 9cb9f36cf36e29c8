from pyspark.sql import functions as F

from tallyforge.session import cut_lineage


def test_cut_tables_are_not_broadcast_by_a_guess(spark, tmp_path):
    """Lists made in Python and exploded are many times what the files below a cut table suggest (p5 at 6 GB)."""
    spark.range(1000).select("id", F.lit("some name").alias("v")).write.parquet(str(tmp_path / "t"))

    def keys(frames):
        for pdf in frames:
            yield pdf.assign(keys=[[k for k in range(200)] for _ in pdf["id"]])

    d = cut_lineage(spark.read.parquet(str(tmp_path / "t")).mapInPandas(keys, "id long, v string, keys array<long>"))
    x = d.select("id", F.explode("keys").alias("k"))
    j = x.join(x.select(F.col("id").alias("other"), F.col("k").alias("l")), (F.col("k") == F.col("l")) & (F.col("id") == F.col("other")))
    assert "Broadcast" not in j._jdf.queryExecution().sparkPlan().toString()
    assert j.count() == 200_000 and d.columns == ["id", "v", "keys"] and d.count() == 1000

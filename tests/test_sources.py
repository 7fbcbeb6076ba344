import numpy as np
from pyspark.sql import functions as F

from causeway.operators.moments import Covariance
from causeway.plans import graphs
from causeway.sources import readers, writers
from causeway.streaming import incremental


def test_sections(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("// a comment\n/variables\nX1:Continuous\nX2:0 1\n/data\nX1 X2\n0.5 1\n* 0\n\n1.5 1\n/knowledge\naddtemporal\n0 X1\n1 X2\n")
    df, k = readers.read_sections(spark, str(p))
    rows = df.orderBy("_row").collect()
    assert [r.X1 for r in rows] == [0.5, None, 1.5] and [r.X2 for r in rows] == ["1", "0", "1"]
    assert k.tiers == {"X1": 0, "X2": 1} and k.is_forbidden("X2", "X1") and not k.is_forbidden("X1", "X2")


def test_table_types(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("a\tb\tc\n1\t0.25\tx\n2\t*\ty\n1\t3\tx\n")
    df = readers.read_table(spark, str(p), readers.ReadOptions(delimiter="tab"))
    assert dict(df.dtypes) == {"_row": "bigint", "a": "int", "b": "double", "c": "string"}
    writers.write_table(df, str(tmp_path / "out"))
    again = readers.read_data_folder(spark, str(tmp_path / "out"))
    assert again.count() == 3 and again.filter("b is null").count() == 1
    long = tmp_path / "v.txt"
    long.write_text("x 1 2 3\ny 0.5 0.25 *\n")
    wide = readers.read_transposed(spark, str(long)).orderBy("_row").collect()
    assert [r.x for r in wide] == [1, 2, 3] and [r.y for r in wide] == [0.5, 0.25, None]


def test_censored(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("survival_days censored x\n5 1 0.5\n7 0 0.25\n")
    row = readers.read_censored(spark, str(p)).orderBy("_row").first()
    assert (row.survival_days.time, row.survival_days.event) == (5.0, 1)


def test_covariance_text():
    cov = Covariance(["a", "b"], np.array([[2.0, 0.5], [0.5, 1.0]]), 40)
    again = readers.parse_covariance(writers.covariance_text(cov))
    assert again.names == cov.names and again.n == 40 and np.allclose(again.matrix, cov.matrix)


def test_knowledge_text():
    k = graphs.Knowledge({"a": 0, "b": 1}, [("x", "y")], [("p", "q")], [1])
    again = readers.parse_knowledge(writers.knowledge_text(k))
    assert again.tiers == k.tiers and again.forbidden == k.forbidden and again.required == k.required and again.within == {1}


def test_graph_files(spark, tmp_path):
    g = graphs.from_spec("A-->B,B<->C,C---D")
    for form in ("text", "json", "xml"):
        writers.write_graph(spark, g, str(tmp_path / form), form)
        assert readers.read_graph(spark, str(tmp_path / form)) == g
    writers.write_edges(g.to_frame(spark), str(tmp_path / "edges"))
    assert graphs.from_frame(readers.read_edges(spark, str(tmp_path / "edges"))) == g
    p = tmp_path / "lags.txt"
    p.write_text("Gene2 <-- Gene1:1\nGene3 <-- Gene1:2\n")
    assert {tuple(r) for r in readers.read_lag_edges(spark, str(p)).collect()} == {("Gene2", "Gene1", 1), ("Gene3", "Gene1", 2)}


def test_stream(spark, tmp_path):
    data = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2 + F.col("id") % 3).cast("double").alias("y"))
    data.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = incremental.to_memory(incremental.running_moments(stream, ["x", "y"]), "moments")
    q.processAllAvailable()
    cov = incremental.covariance_of(spark.table("moments").first(), ["x", "y"])
    q.stop()
    assert np.allclose(cov.matrix, np.cov(np.array([tuple(r) for r in data.collect()]).T))

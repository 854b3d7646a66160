from quillgraph import Model
from quillgraph.streaming import stream_ntriples, stream_template


def test_files_are_added_as_they_come(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.nt").write_text("<http://e/a> <http://e/p> <http://e/b> .\n")
    m = Model(spark)
    stream_ntriples(m, str(folder), str(tmp_path / "c")).awaitTermination()
    assert m.size() == 1
    (folder / "b.nt").write_text('<http://e/a> <http://e/p> <http://e/b> .\n<http://e/a> <http://e/n> "1" .\n')
    stream_ntriples(m, str(folder), str(tmp_path / "c")).awaitTermination()
    assert m.size() == 2


def test_streaming_rows_through_a_template(spark, tmp_path):
    m = Model(spark)
    m.add_template("@prefix ex:<http://e/> . ex:T [ottr:IRI ?s, ?n] :: { ottr:Triple(?s, ex:n, ?n) } .")
    spark.range(3).selectExpr("concat('http://e/', id) AS s", "id AS n").write.parquet(str(tmp_path / "t"))
    rows = spark.readStream.schema("s string, n long").parquet(str(tmp_path / "t"))
    stream_template(m, "ex:T", rows, str(tmp_path / "c2")).awaitTermination()
    assert m.size() == 3

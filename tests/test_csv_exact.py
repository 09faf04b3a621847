from pyspark.sql import Row

from tocsin.sinks import writers
from tocsin.sources import readers


def test_csv_keeps_texts_as_they_are(spark, tmp_path):
    texts = ["  lead and trail  ", "   ", "a \"quoted\", text", "two\nlines", ""]
    writers.write_csv(spark.createDataFrame([Row(id=str(i), text=t) for i, t in enumerate(texts)]), str(tmp_path / "t"))
    back = {r["id"]: r["text"] for r in readers.read_csv(spark, str(tmp_path / "t")).collect()}
    assert [back[str(i)] or "" for i in range(len(texts))] == texts

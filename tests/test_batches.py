"""Tasks work on small parts of a batch, so their memory does not grow with it."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tocsin.functions import batches, vectors
from tocsin.operators import name_scan, word_vectors


def peak_mb(job):
    tracemalloc.start()
    try:
        job()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


class Shared:
    def __init__(self, value):
        self.value = value


def test_bounds_cover_all_rows_in_order():
    assert list(batches.bounds(np.array([3, 3, 9, 0, 1, 4]), 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(batches.bounds(np.array([], int), 6)) == []
    assert list(batches.bounds(np.array([0, 0]), 6)) == [(0, 2)]


def test_names_are_found_in_parts_of_a_batch():
    texts = [f"{i} fire near Lyon \U0001F525 " + "word " * 2000 for i in range(4000)]  # 40 MB, 4 bytes a character in Python
    batch = pa.RecordBatch.from_pydict({"message_id": pa.array(range(4000), pa.int64()), "_text": texts})
    del texts
    names = [Shared([("lyon", "LOC", 0.7)])]
    rows = []
    peak = peak_mb(lambda: rows.extend(n for b in name_scan.scan(iter([batch]), names) for n in b.to_pylist()))
    assert [r["message_id"] for r in rows] == list(range(4000)) and {r["text"] for r in rows} == {"Lyon"}
    assert peak < 40


@pytest.mark.parametrize("count", [1, 5])
def test_parts_and_shards_give_the_same_names(monkeypatch, count):
    texts = ["Lyon, İstanbul Lyon", "", "nothing", "İİ Hatay and Port Vila", "port vila " * 30]
    batch = pa.RecordBatch.from_pydict({"message_id": pa.array(range(5), pa.int64()), "_text": texts})
    keys = [("lyon", "LOC", 0.7), ("hatay", "LOC", 0.6), ("port vila", "LOC", 0.5), ("port", "ORG", 0.1), ("vila", "ORG", 0.1)]
    shards = [Shared(keys[i::count]) for i in range(count)]
    found = [r for b in name_scan.scan(iter([batch]), shards) for r in b.to_pylist()]
    monkeypatch.setattr(name_scan, "text_parts", lambda b, _: (b.slice(i, 1) for i in range(b.num_rows)))
    assert [r for b in name_scan.scan(iter([batch]), shards) for r in b.to_pylist()] == found
    assert [r["text"] for r in found][:4] == ["Lyon", "Lyon", "Hatay", "Port Vila"] and len(found) == 34


def test_neighbours_are_counted_in_parts():
    rng = np.random.default_rng(3)
    known = [f"w{i}" for i in range(50)]
    words = rng.integers(0, 50, 3_000_000)
    lists = pa.ListArray.from_arrays(
        pa.array(np.arange(0, 3_000_001, 1000, dtype=np.int32)), pa.array(known, pa.string()).take(pa.array(words))
    )
    batch = pa.RecordBatch.from_arrays([lists], ["words"])
    total = []
    peak = peak_mb(lambda: total.extend(word_vectors._neighbours(iter([batch]), known, 4, 1 << 20)))
    counted = sum(np.array(b.column("n")).sum() for b in total)
    assert counted == 2 * 3000 * sum(1000 - gap for gap in range(1, 5))
    assert peak < 100


def test_codes_of_long_texts_are_counted_in_parts():
    lists = pa.ListArray.from_arrays(
        pa.array(np.arange(0, 8_000_001, 40_000, dtype=np.int32)), pa.array(np.arange(8_000_000, dtype=np.int32) % 512)
    )
    found = []
    peak = peak_mb(lambda: found.append(vectors.to_matrix(lists)))
    assert found[0].shape == (200, vectors.CODE_DIM) and peak < 40


def test_slots_grow_with_the_rows(spark, monkeypatch):
    from tocsin.operators import ordering

    monkeypatch.setattr(ordering, "SLOT_ROWS", 10)
    rows = spark.range(3000).withColumnRenamed("id", "seq")
    sizes = ordering.with_slots(rows, "seq").groupBy("slot").count().collect()
    assert len(sizes) >= 280 and max(r["count"] for r in sizes) <= 20
    numbered = ordering.with_row_index(rows, "seq").collect()
    assert sorted((r.seq, r.row_index) for r in numbered) == [(i, i) for i in range(3000)]


def test_files_of_a_batch_use_all_cores():
    from checks.catalog import batch_files

    assert batch_files(60_000, 12) == 12 and batch_files(4_000_000, 12) == 50
    assert batch_files(100, 12) == 3 and batch_files(100, 2) == 1


def test_one_large_file_is_dealt_into_more_parts(spark, tmp_path):
    from checks import tables

    path = str(tmp_path / "one.parquet")
    spark.range(200_000).selectExpr("id", "sha2(cast(id as string), 256) AS text").coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        given = spark.read.parquet(path)
        assert tables.spread(given).rdd.getNumPartitions() > given.rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")

"""The prefix trie against plain Python: nulls, ties, copies, long conversations, small shards and queues."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tocsin.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, _x string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def said(row):
    role, text = row[2] or "", row[3] or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            own[row[0]].append(row)
    for turns in own.values():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, said(r)))
    said_by = {c: [(r[2] or "", r[3] or "") for r in turns] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in said_by.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt = said_by.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append((c, len(rebuilt)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, found = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * words
        ends = sorted(c for c, n in members[node] if n == len(node))
        found.append((
            min(members[node])[0], len(node), min(members[node[:-1]])[0] if node else None, len(members[node]),
            len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(found, key=str)


def table_rows(seed=5):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 90), 400, 410, 10**12]:
        for t in range(rnd.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["yes please", "no", " ", "a b\tc"]), 9, "z"))
    rows += [(200, t, "user", f"turn {t} of many", 9, "z") for t in range(700)]  # one conversation holds most rows
    rows += [(200 + i, t, "user", f"turn {t} of many", 9, "z") for i in (3, 7) for t in range(300)]
    rows += [(300 + i, 0, None, None, 9, "z") for i in range(19)]  # copies, and turnless ones once rebuilt
    rows += [(500, None, "b", "second"), (500, None, "a", "first"), (500, 3, "a", None), (500, 3, "a", None), (501, 3, None, "x")]
    rows += [(None, 1, "user", "nobody"), (600, 1, "user", "word " * 20_000), (601, 1, "user", "word " * 20_000)]
    rows += [rows[0], rows[1]]
    return [(*r[:4], 9, "z") for r in rows]


@pytest.mark.parametrize(("shard_turns", "queue_rows"), [(50_000, 200_000), (40, 3), (0, 2)])
def test_trie_against_plain_python(spark, shard_turns, queue_rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE_DEPTHS", 16)
    rows = table_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = prefix_trie.conversation_trie(df, shard_turns=shard_turns, queue_rows=queue_rows).select(*COLUMNS)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_trie_of_a_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    found = prefix_trie.conversation_trie(df, shard_turns=20).select(*COLUMNS)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_empty_table_has_no_root(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(empty).columns == COLUMNS
    assert prefix_trie.conversation_trie(empty).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x", 9, "z")], SCHEMA)
    assert prefix_trie.conversation_trie(nobody).count() == 0


def test_queue_spills_and_keeps_its_order():
    queue, rnd = prefix_trie.SpillingQueue(limit=10), random.Random(1)
    waiting, taken = [], []
    for i in range(3_000):
        item = (rnd.randrange(500), i)
        queue.push(item)
        waiting.append(item)
        if rnd.random() < 0.4:
            waiting.sort()
            assert queue.top() == waiting[0]
            taken.append(queue.pop())
            assert taken[-1] == waiting.pop(0)
    while queue.top() is not None:
        taken.append(queue.pop())
    assert sorted(taken) == sorted(taken[: len(taken) - len(waiting)] + waiting) and queue.runs == []


def test_hot_node_ids_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    steps = spark.range(0, 500, numPartitions=6).select(
        F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("length"),
        (F.col("id") % 2).alias("_x"), F.lit(5).cast("long").alias("_y"),
    )
    found = {r["_x"]: r["ends_sha256"] for r in prefix_trie.end_hashes(steps).collect()}
    for x in (0, 1):
        assert found[x] == hashlib.sha256(",".join(str(i) for i in range(x, 500, 2)).encode()).hexdigest()

"""The training-data operators against plain Python on small tables with nulls, ties and odd texts."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tocsin.llm import (
    block_names,
    components,
    jaccard_join,
    language_codes,
    licence_scan,
    packing,
    secret_scan,
    sentence_pieces,
    sharding,
    toxicity,
    vantage_search,
)
from tocsin.llm.common import tokenizer
from tocsin.llm.words import shingle_codes, word_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept string"
LONG = " ".join(f"w{i % 997} x{i}" for i in range(40_000))
TEXTS = [
    None, "", " ", "A b c d e", "a B c d e", "a b c d e", "One two three", "one TWO three", "É a b c d", "é a b c d",
    LONG, LONG + " end", LONG.upper(), "1234 !!", "x", "x", "ünï " * 30, "Released under the MIT License.",
]


def rows_of(texts=TEXTS):
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 5 == 0 else f"s{i % 2}", None, 7, "z") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "a b c d e", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_block_names_against_texts(docs, empty):
    found = block_names.exact_groups(docs, block_bytes=1 << 17).collect()
    groups = {}
    for row in rows_of():
        groups.setdefault(lower(row[1]), []).append(row[0])
    assert len(found) == len(rows_of())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for row in found:
        ids = by_sha[row["text_sha256"]]
        assert row["group_size"] == len(ids)
        assert row["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(dict.fromkeys(by_sha, 1))
    assert block_names.exact_groups(empty).count() == 0


def test_shards(docs, empty, spark):
    many = spark.range(1_000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
    )
    for table, total in ((docs, len(rows_of())), (many, 1_000)):
        found = sharding.interleaved_shards(table, 16, range_rows=100).toPandas()
        sizes = found.groupby("shard").size().reindex(range(16), fill_value=0)
        assert len(found) == total and sizes.max() - sizes.min() <= 1
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in found.groupby("shard"))
    per_source = found.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (per_source.max(axis=1) - per_source.min(axis=1)).max() <= 2
    assert sharding.interleaved_shards(empty).count() == 0


def test_word_codes_cut_long_texts():
    words = LONG.encode().split()
    codes = word_codes(LONG.encode())
    assert len(codes) == len(words) and len(set(codes.tolist())) == len(set(words))
    assert word_codes(b"a  b\x0bc ")[[0, 1, 2]].tolist() == [word_codes(x)[0] for x in (b"a", b"b", b"c")]
    assert len(shingle_codes(word_codes(b"a b"), 5)) == 1 and not len(shingle_codes(word_codes(b""), 5))


def brute_components(rows, width=5, percent=75):
    sets = []
    for row in rows:
        words = lower(row[1]).encode().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    return Counter((row[0], len(sets[i]), least.get(find(i))) for i, row in enumerate(rows))


def test_jaccard_join_against_all_pairs(spark, docs, empty):
    rng = np.random.default_rng(3)
    texts = list(TEXTS)
    for _ in range(12):  # families whose members are about as similar as the threshold asks
        base = [f"v{x}" for x in rng.integers(0, 300, rng.integers(5, 90))]
        for _ in range(6):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 3)):
                words[at] = f"n{rng.integers(0, 9999)}"
            texts.append(" ".join(words))
    rows = rows_of(texts)
    found = jaccard_join.jaccard_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(tuple(r) for r in found) == brute_components(rows)
    assert jaccard_join.jaccard_groups(empty).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7), (300, 200)]
    found = components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    expected = {i: 0 for i in range(1, 51)} | {100 + i: 100 for i in range(1, 80)} | {300: 200}
    assert {r["node"]: r["root"] for r in found} == expected


def test_language(spark, docs, empty):
    texts = {"en": "the house and the garden are near the river", "de": "das haus und der garten sind nahe am fluss"}
    rows = [(i, f"{texts[k]} {i}", k, "s", 1, 1, "") for i in range(60) for k in [("en", "de")[i % 2]]]
    found = language_codes.identify(spark.createDataFrame([*rows, (90, "12 !", "en", "", 1, 1, ""), (91, None, None, "", 1, 1, "")], DOCS))
    by = {r["doc_id"]: r for r in found.collect()}
    assert all(by[r[0]]["lang_pred"] == r[2] and 0 <= by[r[0]]["score"] <= 1 for r in rows)
    assert by[90]["lang_pred"] == by[91]["lang_pred"] == "und"
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in by)
    assert language_codes.identify(docs).count() == len(rows_of()) and language_codes.identify(empty).count() == 0


def test_codewords_differ():
    for count in (2, 4, 6, 20, 100):
        code = language_codes.codewords(count)
        same = code.astype(int) @ code.T
        assert (same[~np.eye(count, dtype=bool)] < code.shape[1]).all()


def test_toxicity(spark, docs, empty):
    rows = [(i, f"word{i % 50} other{i % 31} " + ("vile slur" if i % 4 == 0 else "kind remark"), "", "", 1, 1, "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(1, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(spark.createDataFrame(rows, DOCS), labels).toPandas().set_index("doc_id").sort_index()
    assert (found["predicted"] == [int(i % 4 == 0) for i in range(600)]).all()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(600)]).all()
    assert toxicity.toxicity(docs, labels.limit(0)).filter("score = 0.5").count() == len(rows_of())
    assert toxicity.toxicity(empty, labels).count() == 0


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0"), *[der(2, bytes([9]) * n) for n in (128, 3, 128, 64, 64, 64, 64, 64)])


def test_secret_spans():
    key = base64.b64encode(RSA).decode()
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b"{}", b"sig"))
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----"
    kinds = lambda text: [k for k, _, _ in secret_scan.scan(text)[1]]
    assert "key_block" in kinds(block) and "key_data" in kinds(f"x {key} y") and "signed_token" in kinds(f"é {token}")
    assert "key_data" in kinds(RSA.hex()) and "key_data" not in kinds(key[:-8]) and not kinds("eyJx.a.b " + "QUJD" * 20)
    text = "é token=token: ABCDEFGHIJKL AKIA" + "A" * 14 + " 0123456789abcdef"
    assert secret_scan.scan(text)[0] == [("access", 28, 46), ("hex", 47, 63)]
    assert secret_scan.scan('API_KEY = "aaaa.bbbb=ccc"')[0] == [("assign", 0, 24)]
    assert secret_scan.redact("abcdefgh", [("x", 1, 3), ("y", 2, 4), ("z", 6, 8)]) == "a[secret]ef[secret]"
    assert secret_scan.scan(None) == ([], [])


def openssh():
    field = lambda data: len(data).to_bytes(4, "big") + data
    parts = field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big")
    return secret_scan.OPENSSH + parts + field(b"\7" * 51) + field(bytes(range(144)))


@pytest.mark.parametrize("data", [RSA, RSA[:-1] + b"\xff", openssh()])
@pytest.mark.parametrize("width", [0, 64, 76])
def test_keys_are_found_however_they_are_written(data, width):
    def wrap(text, end="\n"):
        return end.join(text[i : i + width] for i in range(0, len(text), width)) if width else text

    key, url = base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode()
    for text in (wrap(key), wrap(key, "\r\n  "), wrap(key, "\\n"), wrap(url.rstrip("=")), wrap(data.hex()), wrap(data.hex().upper())):
        for before, after in (("PRIVATE_KEY=", "\nNEXT=1"), ("KEY: ", "\nword"), ('"', '\\n"'), ("", "")):
            found = secret_scan.scan(before + text + after)[1]
            assert ("key_data", len(before), len(before) + len(text)) in found
        assert "key_data" not in [k for k, _, _ in secret_scan.scan(text[: len(text) // 3])[1]]


def test_key_blocks_with_headers_and_escaped_lines():
    key = base64.b64encode(RSA).decode()
    lines = [key[i : i + 64] for i in range(0, len(key), 64)]
    label = "RSA PRIVATE KEY-----"
    cipher = base64.b64encode(bytes(range(256))).decode()
    texts = [end.join([f"-----BEGIN {label}", *lines, f"-----END {label}"]) for end in ("\n", "\r\n", "\\n", "\\r\\n", '\\n" +\n  "')]
    texts += [f"-----BEGIN {label}{e}Proc-Type: 4,ENCRYPTED{e}DEK-Info: AES-128-CBC,00FF{e}{e}{cipher}{e}-----END {label}" for e in ("\n", "\\n")]
    for text in texts:
        assert ("key_block", 2, 2 + len(text)) in secret_scan.scan(f"x {text} y")[1]
    assert not secret_scan.scan(f"-----BEGIN {label}\nProc-Type: none\n\n{cipher}\n-----END {label}")[1]
    assert not secret_scan.scan(f"-----BEGIN {label}\nthe key goes here\n-----END {label}")[1]


def test_secret_table(docs, empty):
    found = secret_scan.find_secrets(docs, masked=True).collect()
    assert len(found) == len(rows_of())
    assert {r["base_sha256"] for r in found if not r["spans"]} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.find_secrets(empty).count() == 0


@pytest.mark.parametrize("factor", [1.0, 3.0])
def test_vantage_search(spark, factor):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, 8))
    vectors[100:300] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None]), (None, [1.0] * 8), (950, [1.0, 2.0]), rows[5]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vantage_search.build_index(table, "vec_id", "embedding", shard_rows=150)
    queries = vantage_search.usable_vectors(table.filter("vec_id % 50 = 0"), "vec_id", "embedding")
    found = vantage_search.search(index, queries, 5, factor).toPandas()
    right = total = 0
    for query in range(0, 700, 50):
        others = np.array([i for i in range(700) if i != query])
        scores = vantage_search.exact_cosines(np.repeat(vectors[query : query + 1], 699, 0), vectors[others])
        expected = [others[i] for i in np.lexsort((others, -scores))[:5]]
        got = found[found["query_id"] == query].sort_values("rank")["vec_id"].tolist()
        right, total = right + len(set(got) & set(expected)), total + 5
        assert factor > 1 or got == expected
    assert right >= 0.9 * total and not (found["query_id"] == 950).any()
    assert vantage_search.nearest(table.limit(0), 50).count() == 0


def test_vantage_ties_have_the_smallest_ids(spark):
    rng = np.random.default_rng(8)
    order = rng.permutation(400)  # so that neither tree order nor row order is id order
    near = np.array([3.0, 1.0, 2.0, 5.0])
    vectors = {int(i): (at + 1) * near for at, i in enumerate(order[:150])}  # one direction, 150 points
    vectors |= {int(i): np.eye(4)[at % 4] * (at + 1) for at, i in enumerate(order[150:300])}
    vectors |= {int(i): rng.integers(0, 2, 4).astype(float) + [0, 0, 0, 1] for i in order[300:]}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    found = vantage_search.nearest(table, every=20, k=5).toPandas()
    for query in range(0, 400, 20):
        others = np.array([i for i in range(400) if i != query])
        scores = vantage_search.exact_cosines(np.repeat(vectors[query][None], 399, 0), np.array([vectors[i] for i in others]))
        expected = [others[i] for i in np.lexsort((others, -scores))[:5]]
        assert found[found["query_id"] == query].sort_values("rank")["vec_id"].tolist() == expected


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    found = packing.pack(docs, path, capacity=64).toPandas()
    whole = Tokenizer.from_file(path)
    for doc_id, group in found[found["doc_id"] != 3].dropna().groupby("doc_id"):
        ids = np.array([*whole.encode(TEXTS[int(doc_id)] or "", add_special_tokens=False).ids, 2], np.uint32)
        group = group.sort_values("piece")
        assert group["length"].sum() == len(ids) and (group["length"].iloc[1:] == 64).all()
        for row in group.itertuples():
            assert row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes())
    for _, group in found.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group["offset"] == group["length"].cumsum() - group["length"]).all() and group["length"].sum() <= 64
    assert found["sequence_id"].nunique() == -(-found["length"].sum() // 64)
    assert packing.pack(empty, path).count() == 0


def test_packing_uses_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(200):
        cap = int(rng.integers(8, 40))
        counts = dict(Counter(rng.integers(1, cap + 1, rng.integers(1, 40)).tolist()))
        used = Counter()
        for contents, times in packing.pack_histogram(counts, cap):
            assert sum(contents) <= cap
            used.update({x: times * n for x, n in Counter(contents).items()})
        assert used == counts


@pytest.mark.parametrize("text", ["", "a  b", " lead", "tail ", "new\n\n line", "x<|endoftext|> y", "日本 語", "a b c", "it's 12 'll"])
def test_word_by_word_ids(text):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    ids = np.frombuffer(packing.token_ids(path).encode_batch([text])[0], np.uint32).tolist()
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_sentence_pieces(docs, empty):
    path = tokenizer("piece_bpe_32k.model")
    coder = sentence_pieces.pieces(path)
    found = sentence_pieces.encode(docs, path)
    for row in found.filter("doc_id is not null").collect():
        text = TEXTS[row["doc_id"]] or ""
        assert row["ids"] == coder.peer.encode(text) and row["parity"] and row["round_trip"]
    back = {r["doc_id"]: r["text"] for r in sentence_pieces.decode(found, path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert sentence_pieces.encode(empty, path).count() == 0


def field_bytes(number, kind, value):
    head = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
    return head + (bytes([len(value)]) + value if kind == 2 else value)


def test_unigram_model(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("▁ab", -3.0, 1), ("ab", -4.0, 1)]
    pieces += [(f"<0x{i:02X}>", -9.0, 6) for i in range(256)]
    data = b"".join(
        field_bytes(1, 2, field_bytes(1, 2, p.encode()) + field_bytes(2, 5, np.float32(s).tobytes()) + field_bytes(3, 0, bytes([k])))
        for p, s, k in pieces
    )
    data += field_bytes(2, 2, field_bytes(3, 0, b"\1") + field_bytes(35, 0, b"\1")) + field_bytes(3, 2, field_bytes(1, 2, b"identity"))
    path = tmp_path / "small.model"
    path.write_bytes(data)
    coder = sentence_pieces.Pieces(str(path))
    for text in ("ab a  b", "aab é", "", " ab "):
        ids, parity = coder.encode_batch([text])[0]
        assert np.frombuffer(ids, np.uint32).tolist() == coder.peer.encode(text) and parity
        assert coder.decode(ids) == coder.normal(text)


def test_licences(docs, empty):
    templates = [("A", "Released under the MIT License."), ("B", "alpha beta gamma delta epsilon")]
    text = "Intro words here\n\nreleased under the mit license\nAlpha beta gamma delta zeta"
    found = licence_scan.scan_text(text, licence_scan.Templates(templates, 0.7))
    assert [(m[0], m[2]) for m in found] == [("A", "line"), ("B", "line")] and found[1][5] == 0.75
    for least in (0.5, 0.8):  # pruning by size loses nothing
        known = licence_scan.Templates(templates, least)
        for words in ("released under the", "alpha beta gamma delta epsilon eta theta iota", "under the mit license"):
            grams = licence_scan.bigrams(words)
            dice = {n: 2 * len(grams & licence_scan.bigrams(t)) / (len(grams) + len(licence_scan.bigrams(t))) for n, t in templates}
            best = known.best(grams)
            assert (best and (best[0], best[1])) == (max((d, n) for n, d in dice.items()) if max(dice.values()) >= least else None)
    assert [r["licence"] for r in licence_scan.find_licences(docs).collect()] == ["MIT"]
    assert licence_scan.find_licences(empty).count() == 0


def test_licence_notices_inside_other_text():
    known = licence_scan.Templates(licence_scan.TEMPLATES, licence_scan.LEAST)
    other = " ".join(f"İ word{i} and more" for i in range(300))
    for number, (name, notice) in enumerate(licence_scan.TEMPLATES):
        for before, after in ((f"{other}\n\n", f"\n\n{other}"), (f"{other} ", f" {other}"), ("Copyright 2020 Foo. ", "")):
            start, end = len(before), len(before) + len(notice.rstrip("."))
            found = [m for m in licence_scan.scan_text(before + notice + after, known) if m[0] == name and m[3] < end and m[4] > start]
            assert any(m[1] == number for m in found)
    found = licence_scan.scan_text("Copyright 2020 Foo. All rights reserved.", known)
    assert [(m[0], m[2:5]) for m in found] == [("Proprietary", ("passage", 20, 39))]
    assert len(licence_scan.scan_text(f"{other} All rights reserved. {other} All rights reserved. {other}", known)) == 2
    assert not licence_scan.scan_text(f"{other}\n\n{other} all rights", known)


def test_pipeline(spark):
    import corpus_pipeline

    secret = 'api_key = "0123456789abcdefABCDEF"'
    base = " ".join(f"the word{i} and" for i in range(40))
    texts = [base, base.upper(), base + " more", "the other text and this", f"the place of {secret} here", "12 34", None]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = spark.createDataFrame(stage(spark, table, "").collect(), table.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in table.collect()}
    assert set(kept["language"]) == {0, 1, 2, 3, 4} and set(kept["copies"]) == {1, 2, 3, 4}
    assert set(kept["near_copies"]) == {1, 3, 4} and kept["secrets"][4] == "the place of [secret]\" here"
    packed = corpus_pipeline.STAGES[-1][1](spark, table, "").collect()
    assert {r["doc_id"] for r in packed} == {1, 3, 4} and len({r["sequence_id"] for r in packed}) == 1


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_keeps_letters_without_any_language(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 34", None, "s", 5), (None, None, None, None, None)], DOCUMENTS)
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()] == [1]


def test_pipeline_near_copies_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    base, other = (" ".join(f"{x}{i} and then" for i in range(40)) for x in ("word", "thing"))
    rows = [(3, base), (3, other), (3, base), (None, base + " more"), (5, other + " more"), (None, "alone here"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    found = sorted(((r["doc_id"], r["text"]) for r in kept), key=str)
    assert found == sorted([(3, base), (3, other), (None, "alone here"), (7, None), (8, "")], key=str)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def seconds(job) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


@pytest.mark.parametrize("unit", [
    "30 84 00 00 ff ff 02 01 00 ", "30 84 00 0f 00 00 02 01 00 ", "-MA", "MIIEow_", "b3BlbnNzaC1rZXktdjEA-", "eyJ.", "30:82:",
])
def test_secret_scan_is_linear_in_repetitive_texts(unit):
    def scan(size):
        text = unit * (size // len(unit))
        return seconds(lambda: secret_scan.confirmed_spans(text, [s for s in secret_scan.base_spans(text) if s[0] == "hex"]))

    scan(50_000)
    small, large = scan(250_000), scan(1_000_000)
    assert large < 4 and large < 10 * small + 0.3


def test_licence_scan_is_linear_in_repetitive_texts():
    templates = licence_scan.Templates(list(licence_scan.TEMPLATES), 0.8)

    def scan(size):
        return seconds(lambda: licence_scan.scan_text("all " + "rights reserved " * (size // 16), templates))

    scan(20_000)
    small, large = scan(250_000), scan(1_000_000)
    assert large < 10 * small + 0.3


def windows_of_every_stretch(grams, known, least):
    """Best end of each start, by trying all of them."""
    best = []
    for start, gram in enumerate(grams):
        if gram in known:
            tries = [
                (2 * len(set(grams[start : end + 1]) & known) / (len(set(grams[start : end + 1])) + len(known)), -end)
                for end in range(start, len(grams))
            ]
            dice, end = max(tries)
            if dice >= least:
                best.append((dice, start, -end))
    kept = []
    for dice, start, end in sorted(best, key=lambda x: (-x[0], x[1])):
        if all(end < a or start > b for _, a, b in kept):
            kept.append((round(dice, 9), start, end))
    return kept


def test_licence_windows_against_every_stretch():
    rnd = random.Random(4)
    for _ in range(120):
        words = [rnd.randrange(rnd.choice([2, 3, 6, 14])) for _ in range(rnd.randrange(2, 50))]
        grams, last, before = list(zip(words, words[1:])), {}, np.empty(len(words) - 1, np.int64)
        for i, gram in enumerate(grams):
            before[i] = last.get(gram, -1)
            last[gram] = i
        known = set(rnd.sample(sorted({(a, b) for a in range(14) for b in range(14)}), 5)) | set(rnd.sample(grams, min(3, len(grams))))
        found = licence_scan.windows(grams, before, known, 0.4)
        assert [(round(d, 9), a, b) for d, _, a, b in found] == windows_of_every_stretch(grams, known, 0.4)


def test_base_secret_spans_against_plain_python(spark, sf_dir):
    kinds = ["assign", "access", "hex"]
    patterns = [
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"),
    ]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(tuple(r) for r in df.select("doc_id", "text").collect())
    for row in secret_scan.find_secrets(df).collect():
        spans = []
        for order, (kind, pattern, least, group) in enumerate(zip(kinds, patterns, (12, 18, 16), (2, 0, 0))):
            spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(texts[row["doc_id"]] or "")
                      if len(m[group]) >= least]
        assert row["base_sha256"] == hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()


def test_shards_against_plain_python(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(tuple(r) for r in df.select("doc_id", "text").collect())
    rows = sharding.interleaved_shards(df, shards=16).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, count in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(count))
    for source, of in Counter(r["source"] for r in rows).items():
        held = Counter(r["shard"] for r in rows if r["source"] == source)
        assert max(abs(held[s] - of / 16) for s in range(16)) < 2


def plain_ftrl(rows, passes):
    """FTRL-proximal row by row on dictionaries; ``rows`` are (places, label) in order."""
    z, n = {}, {}

    def weight(i):
        s = z.get(i, 0.0)
        if abs(s) <= toxicity.L1:
            return 0.0
        return -(s - math.copysign(toxicity.L1, s)) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(passes):
        for places, label in rows:
            weights = {i: weight(i) for i in [*places, "intercept"]}
            g = 1 / (1 + math.exp(-sum(weights.values()))) - label
            for i, w in weights.items():
                rate = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - rate * w, n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_toxicity_learns_like_a_plain_learner(spark):
    made = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(400):
        bad = i % 3 == 0
        rows.append((" ".join(made.choice(words, 12)) + (" rotten" if bad and i % 5 else ""), float(bad), i))
    df = spark.createDataFrame(rows, "text string, label double, order long").repartition(3)
    found = toxicity.train(df)
    counts = Counter(p for text, *_ in rows for p in set(toxicity.feature_places(text).tolist()))
    parts = {r.order: r.part for r in df.select("order", F.pmod(F.xxhash64("order"), F.lit(toxicity.PARTS)).alias("part")).collect()}
    ordered = [
        ([p for p in sorted(set(toxicity.feature_places(text).tolist())) if counts[p] >= toxicity.LEAST_TEXTS], label)
        for text, label, order in sorted(rows, key=lambda r: (parts[r[2]], r[2]))
    ]
    want = plain_ftrl(ordered, toxicity.PASSES)
    assert found.intercept == pytest.approx(want.pop("intercept", 0.0))
    assert dict(zip(found.places.tolist(), found.values.tolist(), strict=True)) == pytest.approx(want)
    assert toxicity.feature_places("rotten")[0] in want


def test_toxicity_repeated_and_null_ids(spark):
    """Texts that share an id teach once; the sample's order does not depend on how rows lie."""
    rows = [(i % 300, f"text {i % 300} " + ("rotten thing" if i % 300 % 4 == 0 else "fine thing")) for i in range(900)]
    rows = [r[:2] for r in rows] + [(None, "rotten thing"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1)], "doc_id long, toxic int")
    chosen = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic")
    assert chosen.count() == chosen.select("order").distinct().count()
    a = toxicity.toxicity(docs, labels).collect()
    b = toxicity.toxicity(docs.repartition(7), labels).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b)) and len(a) == 902


def test_too_many_languages_raise(spark):
    rows = [(i, "some words here", f"l{i}") for i in range(2 * language_codes.MAX_LANGUAGES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    with pytest.raises(Exception, match="more than 256 languages"):
        language_codes.identify(docs).count()


def test_packing_encodes_parts_of_a_batch():
    import tracemalloc

    texts = [" ".join(f"w{(7 * i + j) % 90}" for j in range(4000)) for i in range(1500)]  # 25 MB
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1500), pa.int64()), "_text": texts})
    path = tokenizer("byte_bpe_50k.json")
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in packing._piece_rows(iter([batch]), path, 1024, 2))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert rows > 1500 and peak < 75

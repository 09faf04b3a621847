"""Token alignment against plain Python: odd white space, special strings, long texts cut into ranges, the monoid's laws."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tocsin.llm import token_alignment as ta
from tocsin.llm.common import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, codes string, block int"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    None, "", " ", "  ", "\n", "hello world", "hello  world", " leading", "trailing ", "a\nb\nc d", "a\n\nb", "a \n b", "tab\there now",
    "<|endoftext|> and <s> </s> <unk> <0x0A>", "x▁y z", "▁", "naïve café 日本語 テキスト", "👩‍👩‍👧 family 🇫🇷", "it's we'll don't 'quoted'",
    "1234567890 3.14 a1b2c3", "nul\x00byte \x1c sep\x85nel ls\xa0nb", "ﬁne ½ ² Å Å", "hello world", "the the the the",
    "word " * 3_000, "nospace" * 2_000, "line one\nline two\n" * 400, "ü\tö " * 500, "é", "﻿bom", "a b" * 7,
]


def brute(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = ta.byte_alphabet()
    found, counts, most = [], Counter(), {}
    for doc_id, text, *_ in rows:
        groups, links = [], []
        a_ids = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b_ids = second.encode(text or "")
        a_bytes = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a_ids]
        b_bytes = [
            bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
            for i in b_ids
        ]
        said = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != said or b"".join(b_bytes) != said:
            found.append((doc_id, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        at_a = at_b = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a_ids[at_a:i])) + "|" + ",".join(map(str, b_ids[at_b:j])))
            links.append((a_ids[i - 1], b_ids[j - 1]))
            at_a, at_b = i, j
        counts.update(links)
        found.append((doc_id, len(a_ids), len(b_ids), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (d, na, nb, len(ls), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), sha)
        for d, na, nb, ls, sha in found
    ]


@pytest.mark.parametrize("long_text", [1 << 18, 40])
def test_alignment_against_plain_python(spark, long_text):
    rows = [(i, t, "c", 7) for i, t in enumerate(TEXTS)] + [(5, "hello world", "c", 7), (None, "no id", "c", 7), (None, None, "c", 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = ta.align(df, A, B, long_text=long_text, range_chars=50)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ta.align(empty, A, B).collect() == []


def test_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    found = ta.align(df, A, B, long_text=5_000, range_chars=900).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows))


@pytest.mark.parametrize("seed", range(6))
def test_fragments_compose_in_any_order(seed):
    """Ranges cut at different places for either side give the whole text's alignment, however they are put together."""
    coder, rnd = ta.tokenizers_of(A, B), random.Random(seed)
    pieces = ["alpha", "Beta42", "x\ny", "naïve", "\t", "  ", "日本", "don't", "supercalifragilistic", "a\nb\nc\nd\ne"]
    text = " ".join(rnd.choice(pieces) for _ in range(300))
    fragments = [ta.fragment_of(coder, *part) for part in ta.ranges_of(text, rnd.choice([3, 20, 64]))]
    assert sum(any(len(s.ids) for s in f.prefix + f.suffix) for f in fragments) > 1
    whole = ta.compose(fragments).whole()
    while len(fragments) > 1:
        at = rnd.randrange(len(fragments) - 1)
        fragments[at : at + 2] = [fragments[at] + fragments[at + 1]]
    assert fragments[0].whole() == whole == ta.align_texts(coder, ta.pa.array([text]))[0]


def test_ranges_without_a_common_end_stay_open():
    """Tokens dealt to ranges at any place, with all ends of the one side between those of the other."""
    coder = ta.tokenizers_of(A, B)
    a = ta.Stream(np.array([5, 6, 7, 8]), np.array([2, 4, 6, 9]))
    b = ta.Stream(np.array([1, 2, 3]), np.array([3, 5, 9]))
    whole = ta.Fragment.of(coder, a, b).whole()
    assert whole.closed == b"5,6,7,8|1,2,3;" and len(whole.codes) == 4
    for i in range(5):
        for j in range(4):
            left = ta.Fragment.of(coder, ta.Stream(a.ids[:i], a.ends[:i]), ta.Stream(b.ids[:j], b.ends[:j]))
            right = ta.Fragment.of(coder, ta.Stream(a.ids[i:], a.ends[i:]), ta.Stream(b.ids[j:], b.ends[j:]))
            assert (left + right).whole() == whole

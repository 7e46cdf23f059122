import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing
from lodestone.llm.queries import packing_files

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_exact_complements_come_first():
    assert packing.plan({600: 2, 400: 2}, 1000) == [((600, 400), 2)]
    assert packing.plan({600: 3, 300: 3, 100: 3}, 1000) == [((600, 300, 100), 3)]
    assert packing.plan({400: 1, 300: 1, 200: 1, 100: 1}, 1000) == [((400, 300, 200, 100), 1)]
    assert packing.plan({500: 5}, 1000) == [((500, 500), 2), ((500,), 1)]
    assert packing.plan({250: 4, 1000: 2}, 1000) == [((1000,), 2), ((250, 250, 250, 250), 1)]
    assert packing.plan({}, 1000) == []


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once_and_stay_near_the_bound(seed):
    rng = random.Random(seed)
    counts = Counter(min(1024, max(1, int(rng.lognormvariate(5 + seed * 0.3, 1)))) for _ in range(4000))
    plan = packing.plan(counts, 1024)
    used = Counter()
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= 1024
        for x in lengths:
            used[x] += n
    assert used == counts
    big = sum(n for x, n in counts.items() if x > 512)
    bound = max(big, math.ceil(sum(x * n for x, n in counts.items()) / 1024))
    assert sum(n for _, n in plan) <= bound * 1.01 + 1


def brute_plan(counts, capacity):
    """The first phase piece by piece: single, pair, then triple complements, each with its largest members."""
    left, out = Counter(counts), Counter()

    def fits(lengths):
        return all(left[x] >= n for x, n in Counter(lengths).items())

    for a in range(capacity, 0, -1):
        while left[a]:
            gap = capacity - a
            some = [()] if not gap else [(gap,)] if fits((a, gap)) else []
            some = some or [(x, gap - x) for x in range(gap - 1, 0, -1) if 2 * x >= gap and fits((a, x, gap - x))]
            some = some or [(x, y, gap - x - y) for x in range(gap - 2, 0, -1) for y in range(min(x, gap - x - 1), 0, -1) if y >= gap - x - y and fits((a, x, y, gap - x - y))]
            if not some:
                break
            out[(a, *some[0])] += 1
            left.subtract((a, *some[0]))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_exact_phase_agrees_with_brute_force(seed):
    rng = random.Random(seed)
    counts = {x: rng.randrange(1, 4) for x in rng.sample(range(1, 49), 14)}
    got = Counter()
    for lengths, n in packing.plan(counts, 48):
        if sum(lengths) == 48 and len(lengths) <= 4:
            got[lengths] += n
    want = brute_plan(counts, 48)
    assert all(got[x] >= n for x, n in want.items()) and packing.plan(counts, 48)[: len(want)] == [(x, got[x]) for x in want]


def test_ids_agree_with_the_tokenizer_file_on_a_whole_table():
    """The faster library stands in for the tokenizer file: the same ids for every document."""
    table = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(table):
        pytest.skip("no test tables")
    texts = [t or "" for t in pq.read_table(table, columns=["text"])["text"].to_pylist()]
    ids_of = packing.TokenIds(*packing_files())
    want = TOKENIZER.encode_batch(texts, add_special_tokens=False)
    assert all(ids_of(t).tolist() == w.ids for t, w in zip(texts, want, strict=True))


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(12, 4) == [(0, 4), (4, 4), (8, 4)]


def test_documents(spark):
    rng = random.Random(4)
    texts = [None, "", "<|endoftext|> x<|endoftext|>", "word " * 5000, "é " * 900] + [" ".join(rng.choice(["the", "of", "Xq", "né"]) for _ in range(rng.randrange(1, 1500))) for _ in range(120)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (7, texts[7], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(4)
    got = packing.pack(packing.pieces(df, packing_files()), 1024).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by) <= max(sum(r["length"] > 512 for r in got), math.ceil(sum(r["length"] for r in got) / 1024)) * 1.05 + 1
    assert packing.pack(packing.pieces(df.limit(0), packing_files())).count() == 0


def test_ids_come_along_if_asked_for(spark):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    (r,) = packing.pack(packing.pieces(df, packing_files(), keep_ids=True)).collect()
    assert r["ids"] == [*TOKENIZER.encode("some words here", add_special_tokens=False).ids, 2]

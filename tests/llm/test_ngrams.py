import random

import numpy as np
import pyarrow as pa
import pytest
from lodestone.llm import licenses, ngrams

from test_licenses import brute

N = ngrams.SEGMENT
LONG = [
    "a" * 1_000_000, "é" * 300_000, "x," * 400_000, "pad-" * 65_535 + "cc,by,nc" + ",tail" * 60_000, "日本語" * 70_000 + " cc by nc",
    "," * (N + 5) + "cc-by-nc", "," + "b" * (N + 1) + ",cc,by,nc", "b" * N, "b" * N + ",c", "b" * (N - 1) + ",c", "b" * (N + 1), "c d" * 120_000, ("q" * 300_000 + ";") * 4,
]


def test_texts_without_whitespace_keep_their_words(spark):
    rows = list(enumerate(LONG))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    have = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got)
    assert have == [(i, *brute(t)) for i, t in rows]


@pytest.mark.parametrize("shapes", [False, True])
def test_hashes_do_not_depend_on_the_segment(monkeypatch, shapes):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB1é-, .") for _ in range(rng.randrange(300))) + "aA1" * rng.randrange(40) for _ in range(200)] + ["", "a" * 90, ",,"]
    raw, at = ngrams.text_bytes(pa.array(texts))
    want = ngrams.word_hashes(raw, at, licenses._NO_WORD, shapes)
    for size in (7, 16, 61):
        monkeypatch.setattr(ngrams, "SEGMENT", size)
        for x, y in zip(want, ngrams.word_hashes(raw, at, licenses._NO_WORD, shapes), strict=True):
            assert np.array_equal(x, y)

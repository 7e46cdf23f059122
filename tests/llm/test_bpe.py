import hashlib
import random
import time

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "a", "Hello, world's  end\n\n\tx1234", "é" * 700, "ab" * 3000, "\x1c\x85   x", "<|endoftext|>", "日本語 \U0001f600" * 9, "a" * 20000, "don't  we'll"]


def brute(piece):
    """Merge the leftmost pair of least rank until none is left."""
    if piece in RANKS:
        return [RANKS[piece]]
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, i = min((RANKS.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [RANKS[p] for p in parts]


def test_pieces_agree_with_brute_force():
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b"aeinst r\xc3\xa9\xff") for _ in range(rng.randrange(0, 70))) for _ in range(400)] + [b"x" * 300, b"ab" * 129]
    assert [x.tolist() for x in bpe.encode_pieces(pieces, CODEC.table)] == [brute(p) for p in pieces]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_texts_agree_with_the_library(text):
    if any("\ud800" <= c <= "\udfff" for c in text):
        return
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_documents(spark, monkeypatch):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 2), (4, TEXTS[4], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_documents(df, PATH, public_tokenizers.PATTERN).collect()}
    want = set()
    for i, t, _ in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), bytes(r["text"])) for r in back) == sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    assert bpe.digest_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_a_full_cache_forgets_and_still_encodes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    first = c.digests(["one two three four five six", "seven"])
    assert len(c.known) == len(c.first) == len(c.count) <= 3 and c.digests(["one two three four five six", "seven"]) == first


def test_long_pieces_agree_with_the_library_and_with_the_shared_trees():
    """Unbroken texts, up to one million bytes, which take seconds."""
    rng = random.Random(6)
    for n in (511, 512, 513, 700, 4097):
        piece = bytes(rng.choice(b"aeinstr") for _ in range(n))
        assert bpe.encode_pieces([piece], CODEC.table)[0].tolist() == brute(piece)
    for text in ("".join(rng.choice("aeinstrdlou") for _ in range(1_000_000)), "a" * 300_000, "\u65e5\u672c" * 50_000):
        began = time.perf_counter()
        ids = CODEC.encode(text)
        assert time.perf_counter() - began < 60
        assert ids == LIBRARY.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_decoding_takes_the_ids():
    """The second digest is of the bytes that the id sequence stands for, not of the text."""
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    c.tokens = bpe._Bytes([b"<%d>" % i for i in range(max(RANKS.values()) + 1)])
    ids = LIBRARY.encode_ordinary("one two")
    assert c.digests(["one two"])[0][2] == hashlib.sha256("".join(f"<{i}>" for i in ids).encode()).hexdigest()

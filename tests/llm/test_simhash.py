import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps):
    """fps: list of (doc_id, fp)."""
    f = np.array([x for _, x in fps], dtype=np.uint64)
    close = np.bitwise_count(f[:, None] ^ f) <= 4
    label = np.arange(len(f))
    while (new := np.where(close, label, len(f)).min(axis=1)).tolist() != label.tolist():
        label = new
    least = {}
    for (d, _), r in zip(fps, label.tolist(), strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, format(x, "016x"), least.get(r)) for (d, x), r in zip(fps, label.tolist(), strict=True)), key=str)


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [rng.choice(["Ab", "cd", "é", "fgh", "X1", "zz"]) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            out.append("\t".join(copy))
    return out


def test_groups_agree_with_brute_force(spark):
    rows = list(enumerate([None, "", " \n", "One", "ONE", " ", "a b c", *texts(150, 1)])) + [(None, "null id"), (None, "One"), (3, "One"), (3, "One")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute_groups([(i, brute_fp(t)) for i, t in rows])


@pytest.mark.parametrize("dense", [512, 3])
def test_links_keep_every_connection(spark, monkeypatch, dense):
    """Planted fingerprints at exact distances, chains, and crowded buckets (also where the pairwise way is cut short)."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for c in list(fps)[:25]:
        for d in (1, 2, 3, 4, 5):
            x = c
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            fps.add(x)
    c = rng.getrandbits(64)
    fps |= {c ^ 1 << i ^ 1 << j for i in range(0, 64, 3) for j in range(0, 64, 5)} | {0, 15, 2**64 - 1}
    chain = rng.getrandbits(64)
    for i in range(0, 60, 4):
        chain ^= 15 << i
        fps.add(chain)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "DENSE", dense)
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    groups = {}
    for (s,), x in zip(signed, fps, strict=True):
        groups.setdefault(roots.get(s, s), []).append(x)
    want = {}
    for d, _, r in brute_groups(list(enumerate(fps))):
        want.setdefault(r, []).append(fps[d])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_crowded_buckets_as_they_are(spark):
    """A third of all fingerprints share the upper half up to one bit: more than are compared pair by pair."""
    rng = random.Random(8)
    c = rng.getrandbits(64)
    fps = {c ^ 1 << i ^ 1 << j for i in range(32) for j in range(64)} | {rng.getrandbits(64) for _ in range(3000)} | {c ^ 0x1F, c ^ 0x1F00000001, c ^ 0x3FF}
    assert len(fps) > 4000
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.links(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long"))).collect()}
    got = {}
    for x in fps:
        s = int(np.uint64(x).view(np.int64))
        got.setdefault(roots.get(s, s), set()).add(x)
    want = {}
    fps = sorted(fps)
    for d, _, r in brute_groups(list(enumerate(fps))):
        want.setdefault(r, set()).add(fps[d])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_very_long_text():
    text = "\t".join(f"Word{i % 977}" for i in range(200_000))
    assert simhash.fingerprint(text) == brute_fp(text)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0

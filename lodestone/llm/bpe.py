"""Byte-level byte-pair encoding with a segment tree of pair ranks, for many pieces at once."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

_NONE = np.int64(1 << 62)
#: Leaves of the segment trees that are built together.
LEAVES = 1 << 17
#: From this many bytes on a piece has its tree alone, in flat arrays.
LONG = 512
#: Pieces whose encodings a worker keeps, and the longest that it keeps; others are encoded again.
CACHE, CACHE_CHARS = 600_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Rank of each pair of neighbouring tokens whose joined bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = np.full(256, -1, dtype=np.int64)
        for b in range(256):
            self.single[b] = ranks.get(bytes([b]), -1)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [(ranks[t[:j]] << 32 | ranks[t[j:]], i) for t, i in ranks.items() for j in range(1, len(t)) if t[:j] in ranks and t[j:] in ranks]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [_NONE], dtype=np.int64)
        self.values = np.array([v for _, v in pairs] + [0], dtype=np.int64)
        self.of_pair = dict(pairs)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token, which is the rank too; ``_NONE`` where the pair does not merge."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)


def _merge_all(rows: np.ndarray, size: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and live positions of pieces of the same width; ``rows`` holds single-byte tokens, -1 behind the end.

    Leaf i of a piece's tree holds (rank, i) of the pair that starts at byte i; a node holds the least of its children,
    so the root is the leftmost pair of minimum rank. A merge drops the right token and changes three leaves: the
    merged pair's, its right part's and its left neighbour's; each update walks from the leaf to the root.
    """
    n, width = rows.shape
    shift = width.bit_length()
    pos = np.arange(width, dtype=np.int64)
    tok = rows.copy()
    live = pos < size[:, None]
    nxt, prv = np.tile(pos + 1, (n, 1)), np.tile(pos - 1, (n, 1))

    def leaf(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = table.rank(left, right)
        return np.where(r == _NONE, _NONE, r << shift | at)

    tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
    if width > 1:
        pair = leaf(np.maximum(tok[:, :-1], 0), np.maximum(tok[:, 1:], 0), pos[:-1])
        tree[:, width : 2 * width - 1] = np.where(live[:, 1:], pair, _NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def update(who: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        i = at + width
        tree[who, i] = value
        i = i >> 1
        while i.size and i[0] > 0:
            tree[who, i] = np.minimum(tree[who, 2 * i], tree[who, 2 * i + 1])
            i = i >> 1

    who = np.arange(n)
    while True:
        root = tree[who, 1]
        going = root < _NONE
        who, root = who[going], root[going]
        if not len(who):
            return tok, live
        p, merged = root & ((1 << shift) - 1), root >> shift
        q = nxt[who, p]
        after = nxt[who, q]
        tok[who, p], nxt[who, p], live[who, q] = merged, after, False
        update(who, q, np.full(len(who), _NONE))
        inside = after < size[who]
        prv[who[inside], after[inside]] = p[inside]
        right = np.where(inside, tok[who, np.minimum(after, width - 1)], 0)
        update(who, p, np.where(inside, leaf(merged, right, p), _NONE))
        before = prv[who, p]
        some = before >= 0
        if some.any():
            w, b = who[some], before[some]
            update(w, b, leaf(tok[w, b], merged[some], b))


def _merge_one(tok: array, table: PairTable) -> array:
    """Tokens of one piece, from its single-byte tokens, by the same tree and updates as ``_merge_all``.

    A walk to the root ends early where a node keeps its least child, so most updates stay near their leaf.
    """
    n = len(tok)
    width = 1 << max(0, n - 1).bit_length()
    shift, mask, none, rank = width.bit_length(), width * 2 - 1, int(_NONE), table.of_pair.get
    tree = array("q", [none]) * (2 * width)
    for i in range(n - 1):
        if (r := rank(tok[i] << 32 | tok[i + 1])) is not None:
            tree[width + i] = r << shift | i
    level = np.frombuffer(tree, dtype=np.int64)
    at = width
    while at > 1:
        level[at // 2 : at] = np.minimum(level[at : 2 * at : 2], level[at + 1 : 2 * at : 2])
        at //= 2
    del level
    nxt, prv = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

    def update(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            if b < a:
                a = b
            if tree[i] == a:
                return
            tree[i] = a
            i >>= 1

    while (root := tree[1]) != none:
        p, merged = root & mask, root >> shift
        q = nxt[p]
        after = nxt[q]
        tok[p], nxt[p], tok[q] = merged, after, -1
        update(q, none)
        if after < n:
            prv[after] = p
            r = rank(merged << 32 | tok[after])
        else:
            r = None
        update(p, none if r is None else r << shift | p)
        before = prv[p]
        if before >= 0:
            r = rank(tok[before] << 32 | merged)
            update(before, none if r is None else r << shift | before)
    return array("q", (t for t in tok if t >= 0))


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of every run, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def encode_flat(pieces: list[bytes], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after the other, and how many each has.

    A piece that is a token is that token. Pieces of like length share the building of their trees; long ones have
    theirs alone.
    """
    whole = np.array([table.ranks.get(p, -1) for p in pieces], dtype=np.int64)
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    count = (whole >= 0).astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
    open_ = np.flatnonzero((whole < 0) & (size > 0))
    for i in open_[size[open_] >= LONG].tolist():
        ids = np.frombuffer(_merge_one(array("q", table.single[np.frombuffer(pieces[i], dtype=np.uint8)].tobytes()), table), dtype=np.int64)
        count[i] = len(ids)
        done.append((np.array([i]), ids))
    open_ = open_[size[open_] < LONG]
    raw = table.single[np.frombuffer(b"".join([pieces[i] for i in open_.tolist()]), dtype=np.uint8)]
    start = np.cumsum(size[open_]) - size[open_]
    classes = np.ceil(np.log2(np.maximum(size[open_], 1))).astype(np.int64)
    for c in np.unique(classes).tolist():
        width = 1 << c
        members = np.flatnonzero(classes == c)
        some = max(1, LEAVES // width)
        for k in range(0, len(members), some):
            part = members[k : k + some]
            n = size[open_[part]]
            rows = np.full((len(part), width), -1, dtype=np.int64)
            rows[np.arange(width) < n[:, None]] = raw[_places(start[part], n)]
            tok, live = _merge_all(rows, n, table)
            count[open_[part]] = live.sum(axis=1)
            done.append((open_[part], tok[live]))
    out = np.empty(int(count.sum()), dtype=np.int64)
    first = np.cumsum(count) - count
    for who, ids in done:
        out[_places(first[who], count[who])] = ids
    return out, count


def encode_pieces(pieces: list[bytes], table: PairTable) -> list[np.ndarray]:
    """Token ids of every piece."""
    ids, count = encode_flat(pieces, table)
    return np.split(ids, np.cumsum(count)[:-1]) if pieces else []


class _Bytes:
    """Byte strings by number, joined for whole sequences of numbers at once."""

    def __init__(self, items: list[bytes]):
        self.size = np.array([len(x) for x in items], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(items), dtype=np.uint8)

    def join(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The joined bytes of each part of ``ids``, parted at ``bounds``."""
        size = self.size[ids]
        data = memoryview(self.flat[_places(self.first[ids], size)])
        at = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class _Numbered(dict):
    """Pieces by the order in which they were first asked for."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


class Codec:
    """Encodes texts piece by piece and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table, self.find = PairTable(ranks), regex.compile(pattern).findall
        most = max(ranks.values()) + 1
        self.tokens = _Bytes([self.table.tokens.get(i, b"") for i in range(most)])
        self.decimals = _Bytes([b"%d," % i for i in range(most)])
        self.known = _Numbered()
        self.ids, self.first, self.count = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def sequences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the bounds between them.

        Encodings of the pieces met first are kept; those of a batch's other pieces are forgotten after it.
        """
        old = len(self.known)
        number = self.known.__getitem__
        which, ends = [], [0]
        for t in texts:
            which += map(number, self.find(t))
            ends.append(len(which))
        new = list(self.known)[old:] if len(self.known) > old else []
        ids, count = encode_flat([p.encode() for p in new], self.table)
        all_ids, all_count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
        all_first = np.concatenate([self.first, np.cumsum(count) - count + len(self.ids)])
        if len(self.known) > CACHE or any(len(p) > CACHE_CHARS for p in new):
            kept = [r for r, p in enumerate(new) if len(p) <= CACHE_CHARS][: max(0, CACHE - old)]
            for p in new:
                del self.known[p]
            for r in kept:
                self.known[new[r]] = len(self.known)
            kept = np.array(kept, dtype=np.int64)
            self.ids = np.concatenate([self.ids, ids[_places((np.cumsum(count) - count)[kept], count[kept])]])
            self.first = np.concatenate([self.first, len(all_ids) - len(ids) + np.cumsum(count[kept]) - count[kept]])
            self.count = np.concatenate([self.count, count[kept]])
        else:
            self.ids, self.first, self.count = all_ids, all_first, all_count
        which = np.fromiter(which, dtype=np.int64, count=len(which))
        size = all_count[which]
        bounds = np.concatenate([[0], np.cumsum(size)])[np.array(ends)]
        return all_ids[_places(all_first[which], size)], bounds

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        return self.tokens.join(ids, np.array([0, len(ids)]))[0].tobytes()

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, SHA-256 of the ids, SHA-256 of the bytes decoded from these ids) of every text."""
        ids, bounds = self.sequences(texts)
        sha = hashlib.sha256
        numbers, back = self.decimals.join(ids, bounds), self.tokens.join(ids, bounds)
        return [(n, sha(a[:-1]).hexdigest(), sha(b).hexdigest()) for n, a, b in zip(np.diff(bounds).tolist(), numbers, back, strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.sequences([text])[0].tolist()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's own codec; it and what it has learned outlive a task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens (ids) of every row's whole text. Null text counts as empty; each row stands alone, so null and
    repeated ids do not matter. An empty table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, tokens array<int>")


def decode_documents(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text (bytes) from doc_id and tokens; null tokens count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(t or ()) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "text"])

    prepare(tokens.sparkSession)
    return tokens.select("doc_id", "tokens").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text binary")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text, without keeping the ids.

    A document's pieces become its id sequence; both digests are taken of that sequence, the second after decoding it. A
    worker keeps the encodings of the pieces that it meets first, up to ``CACHE`` of them; the rest of a batch's new
    pieces are encoded together and forgotten. An unbroken text is one long piece: its merges cost a few tree nodes
    each, so time grows in proportion to its length. Null text counts as empty; each row stands alone, so null and
    repeated ids do not matter. An empty table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            n, ids, back = zip(*c.digests([t or "" for t in b.column(1).to_pylist()]), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

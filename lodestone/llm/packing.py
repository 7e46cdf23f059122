"""Best-fit packing of token pieces with exact complements first, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import load_ranks
from .common import pinned, prepare, with_computed


class SumIndex:
    """The lengths still available, and by their sums the pairs and triples of them.

    ``left`` holds the number of pieces of each length; it is the caller's and only falls. The combinations of a sum are
    listed when it is first asked for, those with the largest member first. One whose members are used up is taken off
    its list for good when a lookup meets it, so lists stay in step with the counts.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.lengths = np.flatnonzero(left).tolist()[::-1]
        self.pair_lists: dict[int, list[tuple[int, int]]] = {}
        self.triple_lists: dict[int, list[int]] = {}

    def free(self, length: int, held: tuple[int, ...]) -> int:
        return int(self.left[length]) - held.count(length)

    def single(self, total: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        return (total,) if self.free(total, held) > 0 else None

    def pair(self, total: int, held: tuple[int, ...], below: int | None = None) -> tuple[int, ...] | None:
        """The pair of this sum whose larger member is largest (and at most ``below``), besides what is ``held``."""
        listed = self.pair_lists.get(total)
        if listed is None:
            listed = self.pair_lists[total] = [(x, total - x) for x in self.lengths if total <= 2 * x < 2 * total and self.left[total - x] > 0]
        alive = found = None
        for i, (x, y) in enumerate(listed):
            if self.left[x] < 1 + (x == y) or self.left[y] < 1:
                alive = listed[:i] if alive is None else alive
                continue
            if alive is not None:
                alive.append((x, y))
            if found is None and (below is None or x <= below) and self.free(x, held) > (x == y) and self.free(y, held) > 0:
                found = (x, y)
                if alive is None:
                    break
        if alive is not None:
            self.pair_lists[total] = alive
        return found

    def triple(self, total: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """The triple of this sum whose largest member is largest."""
        listed = self.triple_lists.get(total, [x for x in self.lengths if total <= 3 * x < 3 * total])
        listed = self.triple_lists[total] = [x for x in listed if self.left[x] > 0]
        for x in listed:
            if self.pair_lists.get(total - x) != [] and self.free(x, held) > 0 and (p := self.pair(total - x, (*held, x), x)) is not None:
                return (x, *p)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences) for all pieces of the histogram.

    For each length from the longest down, the gap that it leaves is looked up among the single lengths, then the pair
    sums, then the triple sums of the index; a combination that fills the gap exactly is taken as often as its members
    allow. What has no exact complement is placed by best fit, longest first: into the sequence with the least
    sufficient room, or else a new one. The cost depends on the number of lengths, not of pieces.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    index = SumIndex(left)
    out: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while left[length]:
            gap, held = capacity - length, (length,)
            found = (index.single(gap, held) or index.pair(gap, held) or index.triple(gap, held)) if gap else ()
            if found is None:
                break
            lengths = (length, *found)
            n = min(int(left[x]) // lengths.count(x) for x in lengths)
            for x in lengths:
                left[x] -= n
            out.append((lengths, n))

    room: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                per = min(n, capacity // length)
                put, opened = ((length,) * per, n // per)
                n -= per * opened
                room.setdefault(capacity - per * length, []).append([put, opened])
                continue
            lengths, have = room[fit].pop()
            if not room[fit]:
                del room[fit]
            used = min(have, n)
            if have > used:
                room.setdefault(fit, []).append([lengths, have - used])
            room.setdefault(fit - length, []).append([(*lengths, length), used])
            n -= used
    return out + [(tuple(lengths), n) for kept in room.values() for lengths, n in kept]


class Placement:
    """Sequence and offset of the piece of a given length and rank (its number among the pieces of that length)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        at: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for lengths, n in plan(counts, capacity):
            offset = 0
            for x in lengths:
                at.setdefault(x, []).append((taken.get(x, 0), first, offset))
                taken[x] = taken.get(x, 0) + n
                offset += x
            first += n
        self.sequences = first
        self.at = {x: np.array(v, dtype=np.int64).T for x, v in at.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for x in np.unique(length).tolist():
            own = length == x
            start, first, place = self.at[x]
            i = np.searchsorted(start, rank[own], side="right") - 1
            sequence[own], offset[own] = first[i] + rank[own] - start[i], place[i]
        return sequence, offset


class TokenIds:
    """Ids of a byte-level BPE, with the tokenizer file's special strings taken as such.

    The same vocabulary as ranks and the tokenizer's own pattern give the same ids in a fraction of the time.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        special = {t.content: i for i, t in Tokenizer.from_file(tokenizer_path).get_added_tokens_decoder().items() if t.special}
        self.encoding = tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first that may be shorter."""
    head = (n - 1) % capacity + 1
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


_TOKENS: dict[tuple[str, ...], TokenIds] = {}


def pieces(docs: DataFrame, files: tuple[str, str, str], capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, local_rank[, ids] of every piece of every row.

    part and local_rank number the pieces of each length within a task. ``files`` are the tokenizer's file, the same
    vocabulary as ranks, and the pattern that splits text. A null text counts as empty and has the one piece of
    ``end_id``; a text of any length is encoded whole and cut. Each row stands alone, so null and repeated ids do not
    matter; an empty table gives no rows; other columns are ignored.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _TOKENS.get(files) or _TOKENS.setdefault(files, TokenIds(*files))
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(ids_of(text or ""), end_id).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    own = ids[s : s + n]
                    out.append((doc, k, s, n, zlib.crc32(own.tobytes()), part, seen[n], *([own.tolist()] * keep_ids)))
                    seen[n] += 1
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kinds[j]) for j in range(len(names))], names)

    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, local_rank long" + ", ids array<long>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, fields)


def pack(cut_pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset; each sequence's pieces lie gapless from 0.

    The driver sees how many pieces there are of each length (``capacity`` numbers) and plans on them. Every piece then
    finds its place from its length and its rank among the pieces of that length: the counts of earlier parts, summed
    per length, plus its rank in its own part. No length's pieces ever meet in one task.

    An empty table gives no rows. Equal pieces are interchangeable; ids may be null or repeated.
    """
    held = pinned(cut_pieces)
    per_part = held.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Placement(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shared = held.sparkSession.sparkContext.broadcast(places)
    kept = [c for c in held.columns if c not in ("part", "local_rank")]
    ranked = held.join(base, ["part", "length"]).select(*kept, (F.col("base") + F.col("local_rank")).alias("_rank"))
    length, rank = kept.index("length"), len(kept)

    def place(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(x) for x in shared.value.find(b.column(length).to_numpy(), b.column(rank).to_numpy())]

    return with_computed(ranked, place, sequence_id="long", offset="long").drop("_rank")

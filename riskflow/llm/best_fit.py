"""Best-fit packing of documents into sequences by length-histogram planning.

A document is its token ids and one end id; longer ones than a sequence are cut into pieces of the
sequence's size, of which the first may be shorter.  Only the number of pieces of each length goes to
the driver: at most ``size`` rows, whatever the corpus.  ``plan`` runs best-fit decreasing over these
counts: pieces of one length go together into the open sequences with the least sufficient room, and
sequences that are filled alike are one range of sequence numbers.  So the plan lists runs: these
ranks of this length, so many a sequence, from this sequence and this offset on.  A piece's rank among
those of its length is its place in its writing task and the sum over the tasks before; pieces then
join the runs on length and rank.  The joins' keys hold at most ``STRIDE`` pieces, so no length is hot.

A null text is empty and consists of the end id.  Repeated rows and rows with a null doc_id are
packed like any other.  An empty table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.blocks import Block, Prefix, blocks, stored
from riskflow.llm.token_counts import compiled

SIZE = 1024
END_ID = 2
STRIDE = 4096  # ranks in one key of the join with the plan
KEPT_IDS = 4_000_000  # of pre-tokens that a worker remembers


class Encoder:
    """Token ids of a block; the library's model is asked once for each distinct pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.counter = compiled(path)  # its first transducer finds the pre-tokens
        # the fixed printable alphabet of byte-level vocabularies
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.clear()

    def clear(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes of pre-tokens, and their numbers
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, raw: bytes, special: bool) -> list[int]:
        if special:
            return [self.lib.token_to_id(raw.decode())]
        return [t.id for t in self.lib.model.tokenize(raw.decode("latin-1").translate(self.letter))]

    def _places(self, h: np.ndarray, text: bytes, s: np.ndarray, e: np.ndarray, special: np.ndarray) -> np.ndarray:
        """Numbers of distinct pre-tokens by their sorted hashes."""
        if len(self.ids) > KEPT_IDS:
            self.clear()
        at = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != h[inside]
        if new.any():
            made = [self._learn(text[i:j], x) for i, j, x in zip(s[new].tolist(), e[new].tolist(), special[new].tolist(), strict=True)]
            size = np.array([len(x) for x in made], np.int64)
            self.place = np.insert(self.place, at[new], len(self.size) + np.arange(len(made), dtype=np.int32))
            self.known = np.insert(self.known, at[new], h[new])
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.array([i for x in made for i in x], np.uint32)])
            at = np.searchsorted(self.known, h)
        return self.place[at]

    def encode(self, b: Block, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, each with its end id, and the number of ids of each."""
        s, e, special = self.counter.pretokens(b)
        h = Prefix(b.data).sub(s, e) + (2 * (e - s) + special).astype(np.uint64)
        h, one, back = np.unique(h, return_index=True, return_inverse=True)
        place = self._places(h, b.data.tobytes(), s[one], e[one], special[one])[back]
        size = self.size[place]
        last = np.searchsorted(s, b.off[1:])  # documents end between pre-tokens; their end ids go there
        n = np.concatenate([[0], np.cumsum(size)])
        shift = self.first[place] - n[:-1] - np.repeat(np.arange(b.n), np.diff(last, prepend=0))
        ends = n[last] + np.arange(b.n)
        out = np.empty(int(n[-1]) + b.n, np.uint32)
        text = np.ones(len(out), bool)
        text[ends] = False
        where = np.flatnonzero(text)
        out[ends] = end
        where += np.repeat(shift, size)
        out[text] = self.ids[where]
        return out, np.diff(ends, prepend=-1)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, size: int = SIZE, end: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids of every piece; part and pos: its writing task and its place
    among the pieces of its length there.  ``path``: as for the token counts."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, part int, pos long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = path
        if at is None:
            import public_tokenizers

            at = public_tokenizers.path("byte_bpe_50k.json")
        enc = encoder(os.path.abspath(at))
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in blocks(batches):
            ids, n = enc.encode(b, end)
            many = -(-n // size)
            doc = np.repeat(np.arange(b.n), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            head = n - size * (many - 1)  # of the first piece
            start = np.where(piece > 0, head[doc] + size * (piece - 1), 0)
            length = np.where(piece > 0, size, head[doc])
            lo = (np.cumsum(n) - n)[doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            count = np.bincount(length, minlength=size + 1)
            pos = np.empty(len(length), np.int64)
            pos[order] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count, count)
            pos += seen[length]
            seen += count
            off = np.append(lo, len(ids)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                b.cols["doc_id"].cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32))), pa.array(np.full(len(doc), part, np.int32)), pa.array(pos),
            ], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end of ranks, pieces a sequence, first sequence, offset) by best-fit decreasing.

    Among sequences of equal room the fullest group found last is taken first; a sequence takes one length as
    often as it fits before the next sequence of that room is touched, as best-fit has it piece by piece.
    """
    runs, rooms, groups, made = [], [], {}, 0  # rooms: sorted, of open sequences; groups: ranges of them by room

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} ids does not fit a sequence of {size}")
        rank, n = 0, histogram[length]
        while rank < n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, there = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, first, there = size, made, -(-(n - rank) // (size // length))
                made += there
            each = room // length
            whole = min(there, (n - rank) // each)
            if whole:
                runs.append((length, rank, rank + whole * each, each, first, size - room))
                put(room - each * length, first, whole)
                rank += whole * each
            else:  # the last pieces of this length
                whole, each = 1, n - rank
                runs.append((length, rank, n, each, first, size - room))
                put(room - each * length, first, 1)
                rank = n
            put(room, first + whole, there - whole)
    return runs


def pack(docs: DataFrame, size: int = SIZE, end: int = END_ID, path: str | None = None) -> DataFrame:
    """Every piece with its ids and its place: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, size, end, path))
    tasks = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = tasks.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("pos")).withColumn("stripe", F.expr(f"rank div {STRIDE}"))
    runs = spark.createDataFrame(plan(histogram, size), "length long, lo long, hi long, each long, first long, room long")
    runs = runs.withColumn("stripe", F.explode(F.expr(f"sequence(lo div {STRIDE}, (hi - 1) div {STRIDE})")))
    return ranked.join(runs, ["length", "stripe"]).where("rank >= lo and rank < hi").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", F.expr("first + (rank - lo) div each").alias("sequence_id"), F.expr("room + (rank - lo) % each * length").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids and ids of each whole sequence; a group holds one sequence, ``size`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids"))

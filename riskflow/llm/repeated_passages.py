"""Removal of repeated byte passages by a range-partitioned suffix sort.

Every byte that lies in a string of ``SPAN`` bytes which also starts anywhere else, in any text,
is removed.  Sorting every suffix would move a multiple of the corpus, so only suffixes at
content-chosen anchors take part: among the ``SPAN - GRAM + 1`` grams of a window the one with
the least hash (the leftmost, on ties) is the window's anchor.  Equal windows have the same anchor at
the same place, so nothing is lost; an anchor owns a run of consecutive windows.

1. Anchors whose gram occurs once are dropped: none of their windows repeats.
2. Anchors whose whole owned string occurs more than once are repeated in full; copies need no text.
3. For grams with several different owned strings, one text piece a string is fetched.  Sampled
   splitters range-partition these suffixes by their leading bytes; a bucket sorts them locally by
   multikey quicksort, once to the right of the anchor and once (reversed) to its left.  The common
   prefixes of neighbours give, for each offset d, which suffixes agree in d bytes to the left and
   SPAN - d to the right: these are the repeated windows.  Equal leading bytes go to the same
   bucket, so no match crosses a boundary.
4. A gram with more than ``HOT`` different owned strings does not go into one bucket: its windows
   are counted by hash in an aggregation.
5. Anchors, owned strings and windows meet the table of what repeats in a join; keys with very many rows are dealt in parts.

Null texts are empty.  Texts shorter than SPAN keep all bytes.  Repeated rows are documents of
their own, so long ones lose all their bytes.  Texts are cut for work into segments of ``SEGMENT``
windows that overlap by SPAN - 1 bytes: memory does not depend on the length of a text's match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.blocks import Block, Prefix, blocks, discard, flat, mix, repeated, stored

SPAN = 400
GRAM = 200
SEGMENT = 2 << 20
HOT = 50_000
CHUNK_ROWS = 20_000
PART = 100
SHARES = 100_000
_U = np.uint64
_LOW = _U((1 << 24) - 1)


def _segments(b: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, document number, valid window starts and the offset of the bytes in each document's text."""
    if len(b.data) <= SEGMENT + SPAN:
        doc = np.repeat(np.arange(b.n), np.diff(b.off))
        room = len(b.data) - SPAN + 1
        ok = doc[:room] == doc[SPAN - 1:] if room > 0 else np.zeros(0, bool)
        yield b.data, doc, np.flatnonzero(ok), b.off[:-1]
        return
    for d in range(b.n):
        lo, hi = b.off[d], b.off[d + 1]
        for s in range(lo, max(hi - SPAN + 1, lo), SEGMENT):
            part = b.data[s:min(hi, s + SEGMENT + SPAN - 1)]
            base = np.zeros(b.n, np.int64)
            base[d] = lo - s
            yield part, np.full(len(part), d), np.arange(max(0, min(len(part) - SPAN + 1, SEGMENT))), base


def anchors(b: Block) -> Iterator[tuple[np.ndarray, ...]]:
    """Gram hash, owned-string hash, document, position in the text, and the greatest and least offset owned."""
    for data, doc, starts, base in _segments(b):
        if not len(starts):
            continue
        pre = Prefix(data)
        n = len(data) - GRAM + 1
        at = np.arange(n)
        gram = pre.sub(at, at + GRAM)
        low = (gram & ~_LOW) | at.astype(np.uint64)
        width, want = 1, SPAN - GRAM + 1
        while width * 2 <= want:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < want:
            low = np.minimum(low[:-(want - width)], low[want - width:])
        pos = (low[starts] & _LOW).astype(np.int64)
        new = np.ones(len(pos), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pos)) - 1
        p, lo, hi = pos[first], starts[first], starts[last]
        own = mix(pre.sub(lo, hi + SPAN) + mix((p - lo).astype(np.uint64) << _U(16) | (p - hi).astype(np.uint64)))
        yield gram[p], own, doc[p], p - base[doc[p]], p - lo, p - hi


def _anchors(docs: DataFrame) -> DataFrame:
    """h, o, rk and the packed place (position, greatest and least offset) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            rk = b.cols["rk"].to_numpy(zero_copy_only=False)
            for h, o, d, p, lo, hi in anchors(b):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(o.view(np.int64)), pa.array(rk[d]), pa.array(p << 16 | lo << 8 | hi)], ["h", "o", "rk", "at"])

    return docs.mapInArrow(run, "h long, o long, rk long, at long")


def _pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The owned strings at the wanted places, with the suffix's leading bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            rks = batch.column("rk").to_pylist()
            out = []
            for i, items in enumerate(batch.column("items").to_pylist()):
                text = data[off[i]:off[i + 1]].tobytes()
                for x in items:
                    p, lo, hi = x["at"] >> 16, x["at"] >> 8 & 255, x["at"] & 255
                    out.append((x["h"], x["c"], x["k"], rks[i], x["at"], text[p:p + 16], text[p - lo:p - hi + SPAN]))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 5 + (pa.binary(),) * 2, strict=True)], ["h", "c", "k", "rk", "at", "lead", "body"])

    by_doc = stored(wanted.groupBy("rk").agg(F.collect_list(F.struct("h", "c", "k", "at")).alias("items")))
    once = docs.select("rk", "text").join(by_doc, "rk").dropDuplicates(["rk"])  # equal rows share rk and need one piece a string
    out = stored(once.mapInArrow(run, "h long, c long, k long, rk long, at long, lead binary, body binary"))
    discard(by_doc)
    return out


def multikey_order(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of byte strings (rows of a matrix, padded with 0): ties go on to the next eight bytes.

    Rows that agree with their padding stay in order of size, so a string comes before those that go on with NUL bytes.
    """
    n = len(rows)
    keys = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.lexsort((size, keys[:, 0]))
    start = np.ones(n, bool)
    start[1:] = keys[order[1:], 0] != keys[order[:-1], 0]
    for k in range(1, keys.shape[1]):
        group = np.cumsum(start) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        sub = np.lexsort((keys[order[tied], k], group[tied]))
        order[tied] = order[tied][sub]
        now = order[tied]
        start[tied[1:]] |= (keys[now[1:], k] != keys[now[:-1], k])
    return order


def _classes(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and common prefix of each row with the one before it in that order."""
    order = multikey_order(rows, size)
    common = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), 4096):
        a, b = order[lo - 1:lo + 4095], order[lo:lo + 4096]
        a = a[:len(b)]
        differ = rows[a] != rows[b]
        where = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        common[lo:lo + len(b)] = np.minimum(where, np.minimum(size[a], size[b]))
    return order, common


def repeated_offsets(bodies: list[bytes], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows x (SPAN - GRAM + 1): whether the window at offset d before the anchor occurs in two rows of a group."""
    n = len(bodies)
    right = np.zeros((n, SPAN), np.uint8)
    left = np.zeros((n, -(-(SPAN - GRAM) // 8) * 8 or 8), np.uint8)
    for i, x in enumerate(bodies):
        raw = np.frombuffer(x, np.uint8)
        right[i, :len(raw) - lo[i]] = raw[lo[i]:]
        left[i, :lo[i]] = raw[:lo[i]][::-1]
    out = np.zeros((n, SPAN - GRAM + 1), bool)
    ro, rc = _classes(right, SPAN - hi)
    lo_, lc = _classes(left, lo)
    r, l_ = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(SPAN - GRAM + 1):
        mine = np.flatnonzero((hi <= d) & (d <= lo))
        if len(mine) < 2:
            continue
        r[ro] = np.cumsum(rc < SPAN - d)
        l_[lo_] = np.cumsum(lc < d)
        key = r[mine] * n + l_[mine]  # equal right parts are of one group
        out[mine, d] = repeated(key)[0]
    return out


def _intervals(rk: list[int], at: list[int], flags: np.ndarray) -> pa.RecordBatch:
    """Removed bytes of each row's text: windows at the flagged offsets, adjoining ones as one."""
    row, d = np.nonzero(flags[:, ::-1])  # by falling offset: by rising start
    d = flags.shape[1] - 1 - d
    at, rk = np.array(at, np.int64), np.array(rk, np.int64)
    s = (at[row] >> 16) - d
    new = np.ones(len(s), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] > s[:-1] + SPAN)
    first = np.flatnonzero(new)
    end = s[np.append(first[1:], len(s))[:len(first)] - 1] + SPAN
    return pa.RecordBatch.from_arrays([pa.array(rk[row[first]]), pa.array(s[first]), pa.array(end)], ["rk", "s", "e"])


def _sorted_matches(pieces: DataFrame) -> DataFrame:
    """rk, s, e of the repeated windows among the pieces, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def work(rows: list[tuple]) -> pa.RecordBatch:
            _, c, rk, at, body = zip(*rows, strict=True)
            a = np.array(at, np.int64)
            flags = repeated_offsets(list(body), a >> 8 & 255, a & 255)
            flags[np.array(c) > 1] = False  # repeated in full already
            return _intervals(rk, at, flags)

        for batch in batches:
            rows = zip(*(batch.column(x).to_pylist() for x in ("h", "c", "rk", "at", "body")), strict=True)
            for x in rows:
                if len(held) >= CHUNK_ROWS and held[-1][0] != x[0]:
                    yield work(held)
                    held = []
                held.append(x)
        if held:
            yield work(held)

    dealt = pieces.repartitionByRange("lead", "h").sortWithinPartitions("lead", "h")
    return dealt.select("h", "c", "rk", "at", "body").mapInArrow(run, "rk long, s long, e long")


def _repeats(rows: DataFrame, counts: DataFrame, keys: list[str], spread: list[str], c: str = "c") -> DataFrame:
    """Rows whose key is in ``counts``, a table of distinct keys and their numbers of rows ``c``, with that number.

    A key with more than a ``SHARES``-th of these rows (and ``PART``) is dealt in parts by the hash of ``spread``: a line
    that fills many texts does not land in one task.  There are fewer than ``SHARES`` such keys, whatever the input.
    """
    most = max(PART, (counts.agg(F.sum(c)).first()[0] or 0) // SHARES)
    parts = F.expr(f"({c} + {most - 1}) div {most}")
    heavy = counts.where(F.col(c) > most).select(*keys, parts.alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("parts")), F.lit(0))
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("part", part).drop("parts")
    every = counts.select(*keys, c, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return dealt.join(every, [*keys, "part"]).drop("part")


def _counted_matches(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for grams with very many different strings: windows are counted by their hashes; also the table of counts."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, rk, at, c = (batch.column(x).to_numpy() for x in ("h", "rk", "at", "c"))
            for i, body in enumerate(batch.column("body").to_pylist()):
                raw = np.frombuffer(body, np.uint8)
                lo, hi = int(at[i]) >> 8 & 255, int(at[i]) & 255
                s = np.arange(lo - hi + 1)
                pre, turned = Prefix(raw), Prefix(raw[::-1].copy())
                x, y = pre.sub(s, s + SPAN), turned.sub(len(raw) - s - SPAN, len(raw) - s)
                m = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, h[i])), pa.array(lo - s), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(m, rk[i])), pa.array((int(at[i]) >> 16) - lo + s), pa.array(np.full(m, c[i]))], ["h", "d", "x", "y", "rk", "s", "c"])

    w = pieces.select("h", "c", "rk", "at", "body").mapInArrow(windows, "h long, d long, x long, y long, rk long, s long, c long")
    keys = ["h", "d", "x", "y"]
    counts = stored(w.groupBy(keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    return _repeats(w.where("c = 1").drop("c"), counts, keys, ["rk", "s"]).select("rk", "s", (F.col("s") + SPAN).alias("e")), counts


def removed(docs: DataFrame) -> DataFrame:
    """rk (row key) and the removed byte ranges of every changed row, as found (they may overlap)."""
    a = stored(_anchors(docs))
    many = stored(a.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))  # a table: the join can then split a hot gram
    some = stored(a.join(many, "h"))
    discard(a, many)
    owned = stored(some.groupBy("h", "o").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rk", "at")).alias("one")))
    whole = _repeats(some, owned.where("c > 1").select("h", "o", "c"), ["h", "o"], ["rk", "at"])
    place = F.shiftright("at", 16)
    full = whole.select("rk", (place - F.expr("shiftright(at, 8) & 255")).alias("s"), (place - F.expr("at & 255") + SPAN).alias("e"))
    mixed = stored(owned.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    wanted = _repeats(owned, mixed, ["h"], ["o"], "k").select("h", "c", "k", "one.rk", "one.at")
    pieces = _pieces(docs, wanted)
    counted, counts = _counted_matches(pieces.where(F.col("k") > HOT))
    found = full.unionByName(_sorted_matches(pieces.where(F.col("k") <= HOT))).unionByName(counted)
    cuts = stored(found.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("cuts")))
    discard(some, owned, mixed, pieces, counts)
    return cuts


def _merged(cuts: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in cuts:
        if out and x["s"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["e"]))
        else:
            out.append((x["s"], x["e"]))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges) of every row."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"))
    cuts = removed(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            out = []
            for i, (rk, found) in enumerate(zip(batch.column("rk").to_pylist(), batch.column("cuts").to_pylist(), strict=True)):
                text = data[off[i]:off[i + 1]].tobytes()
                spans, digest, at = _merged(found), hashlib.sha256(), 0
                for s, e in spans:
                    digest.update(text[at:s])
                    at = e
                digest.update(text[at:])
                out.append((rk, sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["rk", "n_removed", "n_spans", "sha", "spans"])

    changed = keyed.select("rk", "text").join(cuts, "rk").mapInArrow(run, "rk long, n_removed long, n_spans long, sha string, spans array<struct<start:long,end:long>>")
    changed = changed.dropDuplicates(["rk"])
    text = F.coalesce("text", F.lit(""))
    every = keyed.select("doc_id", "rk", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(changed, "rk", "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"), "spans")

"""SentencePiece encoding and decoding: a batched Viterbi in numpy over equal-length words.

A text is normalised as the model file says (a space in front, spaces as U+2581) and cut into
words.  Words not met before are grouped by length; all words of one length advance together,
one character at a time.  For every end position the substrings of all piece lengths are hashed
and probed in the sorted piece keys, and the vectorised maximum over the candidates stores the
backpointer.

The model's pieces come from ranked merges, so the best path is the one that the merges leave:
a step is allowed only if merging its piece with the previous piece changes neither (weight 0,
else minus infinity); exactly one candidate survives at each position, and the path equals the
library's.  Runs of U+2581 have equal ranks among themselves and are cut greedily.  Characters
without a piece become their UTF-8 byte pieces.

Null and empty texts have no ids and decode to the empty text.  Rows are independent; repeated
rows get equal results.  ``round_trip`` is false where the format itself loses text (a literal
U+2581 decodes to a space).  The word cache of a worker is bounded by ``CACHE_WORDS``.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskflow.llm.bpe import Merges

BAR = "▁"
CACHE_WORDS = 800_000
BATCH_CHARS = 6 << 20
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)
_NONE = np.int32(-1)
_UNKNOWN = np.int32(-2)


def _hash(points: np.ndarray) -> np.ndarray:
    """Polynomial hash of the last axis."""
    h = np.zeros(points.shape[:-1], np.uint64)
    for k in range(points.shape[-1]):
        h = h * _B + points[..., k].astype(np.uint64) + _U(1)
    return h


class Pieces:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.byte_id = {}
        self.pieces: list[str | None] = [None] * n
        normal = {}
        for i in range(n):
            t = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(t[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[i] = t
                normal[t] = i
        self.id, score = normal, {t: sp.get_score(i) for t, i in normal.items()}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.merges = Merges(lambda a, b: -score[a + b] if a + b in score else None)
        keys = np.array([self._key(t) for t in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_id = keys[order], np.array(list(normal.values()), np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)  # by the top bits of a key: most substrings are no piece
        self.maybe[self.keys >> _U(44)] = True
        self.longest = max(map(len, normal))
        self.runs = max(len(t) for t in normal if not t.strip(BAR))
        alone = "".join(c for c in "\n\t\r" if c not in normal)  # without a piece: no merge crosses them
        self.cut = re.compile(f"[{alone}]|{BAR}+[^{BAR}{alone}]*|[^{BAR}{alone}]+" if alone else f"{BAR}+[^{BAR}]*").findall
        self.pair_keys, self.pair_ok = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)  # last answer by hash
        self.clear()

    def clear(self) -> None:
        """Forget the words; their ids lie one after the other in ``flat``."""
        self.cache: dict[str, int] = {}
        self.start, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _key(t: str) -> int:
        return int(_hash(np.array([[ord(c) for c in t]], np.uint32))[0])

    def _allowed(self, prev: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Whether each (previous piece or -1 at the beginning, piece) stays apart."""
        key = (prev.astype(np.int64) + 2) << 32 | cand.astype(np.int64)
        at = ((key.astype(np.uint64) * _B) >> _U(43)).astype(np.int64)
        ok = self.pair_ok[at]
        miss = np.flatnonzero(self.pair_keys[at] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            said = np.empty(len(new), bool)
            for k, x in enumerate(new.tolist()):
                p, c = (x >> 32) - 2, x & 0xFFFFFFFF
                said[k] = self.merges.apart(None if p < 0 else self.pieces[p], self.pieces[c], list)
            ok[miss] = said[back]
            slot = ((new.astype(np.uint64) * _B) >> _U(43)).astype(np.int64)
            self.pair_keys[slot], self.pair_ok[slot] = new, said
            clash = self.pair_keys[slot] != new  # two new keys in one slot: the answer must be the key's own
            if clash.any():
                self.pair_keys[slot[clash]] = -1
        return ok

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words of one length (rows of code points), one word after the other, and how many each has; -2 stands for an unknown character."""
        rows, n = points.shape
        last = np.full((n + 1, rows), _NONE, np.int32)  # last piece of the best path to each position
        size = np.zeros((n + 1, rows), np.int16)
        for end in range(1, n + 1):
            h, power = np.zeros(rows, np.uint64), _U(1)
            best = np.full(rows, -np.inf)
            for length in range(1, min(self.longest, end) + 1):
                h = h + (points[:, end - length].astype(np.uint64) + _U(1)) * power
                power = _U(int(power) * int(_B) & (1 << 64) - 1)
                hit = np.flatnonzero(self.maybe[h >> _U(44)])
                at = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
                real = self.keys[at] == h[hit]
                hit, at = hit[real], at[real]
                if length == 1:
                    lost = np.ones(rows, bool)
                    lost[hit] = False
                    last[end, lost], size[end, lost], best[lost] = _UNKNOWN, 1, 0
                if not len(hit):
                    continue
                cand, prev = self.key_id[at], last[end - length, hit]
                weight = np.where(self._allowed(np.maximum(prev, -1), cand), 0.0, -np.inf)
                win = weight > best[hit]
                hit, cand = hit[win], cand[win]
                last[end, hit], size[end, hit], best[hit] = cand, length, 0
        steps, at, rest = [], np.full(rows, n), np.arange(rows)
        while len(rest):
            steps.append((rest, last[at[rest], rest]))
            at[rest] -= size[at[rest], rest]
            rest = rest[at[rest] > 0]
        row = np.concatenate([r for r, _ in steps[::-1]])
        return np.concatenate([i for _, i in steps[::-1]])[np.argsort(row, kind="stable")], np.bincount(row, minlength=rows)

    def _learn(self, words: list[str]) -> None:
        """Put the ids of new words (one leading U+2581 at most) into the cache."""
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(len(w), []).append(w)
        flats, sizes = [], []
        for n, group in groups.items():
            rows = max(1, BATCH_CHARS // (n * 16))
            for lo in range(0, len(group), rows):
                part = group[lo:lo + rows]
                points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                ids, count = self.viterbi(points)
                if (ids == _UNKNOWN).any():
                    ids, count = self._bytes(part, ids, count)
                self.cache.update(zip(part, range(len(self.cache), len(self.cache) + len(part)), strict=True))
                flats.append(ids)
                sizes.append(count)
        self._store(flats, sizes)

    def _store(self, flats: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        self.flat = np.concatenate([self.flat, *flats])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])

    def _bytes(self, part: list[str], ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of unknown characters."""
        ends = np.cumsum(count)
        flats, sizes = [], count.copy()
        for k, w in enumerate(part):
            own = ids[ends[k] - count[k]:ends[k]]
            if (own == _UNKNOWN).any():
                out, at = [], 0
                for i in own.tolist():
                    if i == _UNKNOWN:
                        out += [self.byte_id[x] for x in w[at].encode()]
                        at += 1
                    else:
                        out.append(i)
                        at += len(self.pieces[i])
                own = np.array(out, np.int32)
                sizes[k] = len(own)
            flats.append(own)
        return np.concatenate(flats), sizes

    def _words(self, text: str) -> list[str]:
        """Words with their leading spaces' marks, in order."""
        if not text:
            return []
        return self.cut(BAR + text.replace(" ", BAR))

    def _spaced(self, w: str) -> np.ndarray:
        """Ids of a word with two or more marks in front, or of marks only."""
        body = w.lstrip(BAR)
        run = len(w) - len(body)
        tail = np.zeros(0, np.int32)
        if body:
            at = self.cache[BAR + body]
            tail = self.flat[self.start[at]:self.start[at + 1]]
            if tail[0] == self.id[BAR]:
                tail = tail[1:]
            else:
                run -= 1
        marks = [self.id[BAR * min(self.runs, run - k)] for k in range(0, run, self.runs)]
        return np.concatenate([np.array(marks, np.int32), tail])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one text after the other, and how many each has; equal to the library's."""
        if len(self.cache) > CACHE_WORDS:
            self.clear()
        cache = self.cache
        split = [self._words(t) for t in texts]
        new = list(set().union(*split) - cache.keys())
        wide = [w for w in new if w.startswith(BAR * 2) or w == BAR]
        plain = {w for w in new if not w.startswith(BAR * 2)} | {BAR + w.lstrip(BAR) for w in wide}
        self._learn([w for w in plain if w != BAR and w not in cache])
        marked = [self._spaced(w) for w in wide]
        cache.update(zip(wide, range(len(cache), len(cache) + len(wide)), strict=True))
        self._store(marked, [np.array([len(x) for x in marked], np.int64)])
        codes = np.fromiter(map(cache.__getitem__, chain.from_iterable(split)), np.int64)
        size = self.start[codes + 1] - self.start[codes]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[codes] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        doc = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        return ids, np.bincount(doc, size, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        out, raw = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i] or "")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(BAR, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def model_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return os.path.abspath(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        lo, texts = 0, batch.column("text").fill_null("").to_pylist()
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_CHARS):
                size += len(texts[hi])
                hi += 1
            yield batch.slice(lo, hi - lo), texts[lo:hi]
            lo = hi


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256 (of the text that the ids decode to) and round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_path(path))
        for batch, texts in _slices(batches):
            ids, size = model.encode(texts)
            ends = np.cumsum(size)
            back = [model.decode(ids[z - n:z]) for z, n in zip(ends.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(size),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids)),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([t == x for t, x in zip(back, texts, strict=True)]),
            ], ["doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of ``doc_id, ids``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_path(path))
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

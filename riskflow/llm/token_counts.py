"""Token counts of a byte-level BPE tokenizer by finite-state transducers.

Two deterministic transducers are compiled from the tokenizer's file:

* ``PRETOKENS``: over character classes; its transitions emit the bounds of pre-tokens.  A block
  of text is cut into equal chunks; every chunk's state map (entry state to exit state) is found
  for all chunks at once, the maps compose by a parallel prefix scan, and a second pass with the
  now known entry states emits the bounds.
* ``CountTransducer``: over the bytes of a pre-token; each transition carries the change of the
  number of tokens.  A state is all that later bytes can depend on: the longest suffix that
  begins a vocabulary entry, and the last token and relative count at each position in it.
  States and transitions are compiled when first met; all distinct pre-tokens of a block step
  through the table together.

Counts equal the library's ``encode(text, add_special_tokens=False)``: special strings inside a
text count as one token each.  Null and empty texts have 0 tokens.  Rows are independent, so
repeated rows get equal counts; other columns are not read.  The compiled table is dropped and
built anew when it passes ``MAX_STATES`` states, which bounds the memory of a worker.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskflow.llm.blocks import Block, Prefix, blocks
from riskflow.llm.bpe import Merges

CHUNK = 128
MAX_STATES = 600_000

# Character classes: E ends a text; R stands for r and v, T for s, t, m and d, G for l, H for e.
E, SP, W, N, L, O, AP, T, R, H, G = range(11)
# States: after a letter, digit, other sign; after an apostrophe that begins a pre-token, and the
# same with r/v or l read; after a contraction; after one space or other blank, or two and more.
START, LET, DIG, OTH, QUO, QRV, QL, CON, ONE_SP, ONE_W, MANY_SP, MANY_W = range(12)
HERE, BACK = 1, 2  # a bound before this character; before the previous one


def _pretokens() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by (state, class)."""
    nxt, emit = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    letters = (L, T, R, H, G)
    kind = {N: DIG, O: OTH, AP: OTH} | dict.fromkeys(letters, LET)
    for s in range(12):
        for c in range(1, 11):
            blank = c in (SP, W)
            to, out = ((ONE_SP if c == SP else ONE_W) if blank else kind[c]), HERE
            if c == AP:
                to = QUO
            if s in (LET, DIG, OTH) and not blank and kind[c] == s:
                to, out = s, 0
            elif s == QUO and kind.get(c) == OTH:
                to, out = OTH, 0
            elif s == QUO and c in (T, R, G):
                to, out = {T: CON, R: QRV, G: QL}[c], 0
            elif s == QRV and c == H or s == QL and c == G:
                to, out = CON, 0
            elif s in (QRV, QL):
                to, out = (LET, BACK) if kind.get(c) == LET else (to, BACK | HERE)
            elif s in (ONE_SP, ONE_W, MANY_SP, MANY_W):
                if blank:
                    to, out = (MANY_SP if c == SP else MANY_W), 0
                else:
                    joined = s in (ONE_SP, MANY_SP)
                    to = kind[c] if joined else to
                    out = (0 if joined else HERE) | (BACK if s in (MANY_SP, MANY_W) else 0)
            nxt[s, c], emit[s, c] = to, out
        nxt[s, E], emit[s, E] = START, HERE | (BACK if s in (QRV, QL) else 0)
    # a quote followed by r, v or l that is no contraction stands alone: its bound lies before that letter
    return nxt, emit


PRETOKENS = _pretokens()


def scan(classes: np.ndarray) -> np.ndarray:
    """Bounds before each position, by chunk state maps and their prefix composition."""
    nxt, emit = PRETOKENS
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, E, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    table, states = nxt.T.ravel(), nxt.shape[0]  # by class * states + state
    table = table.astype(np.intp)
    maps = np.tile(np.arange(states), (rows, 1))
    for column in grid:
        maps += (column.astype(np.intp) * states)[:, None]
        maps = table.take(maps)
    step = 1
    while step < rows:  # maps[i] becomes the map from the beginning to the end of chunk i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), 1)
        step *= 2
    state = np.full(rows, START)
    state[1:] = maps[:-1, START]
    out = np.empty((CHUNK, rows), np.uint8)
    signs = emit.T.ravel()
    for k, column in enumerate(grid):
        at = column.astype(np.intp) * states + state
        out[k] = signs.take(at)
        state = table.take(at)
    flags = out.T.ravel()[:n]
    bound = (flags & HERE) > 0
    bound[:-1] |= (flags[1:] & BACK) > 0
    return bound


class CountTransducer:
    """Lazily determinised automaton over bytes with token-count increments on its transitions."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.vocab = vocab
        self.begins = {t[:k] for t in vocab for k in range(1, len(t))}
        self.merges = Merges(lambda a, b: ranks.get((a, b)))
        self.clear()

    def clear(self) -> None:
        self.states = {(b"", (None,), (0,)): 0}
        self.known = [(b"", (None,), (0,))]
        self.keys, self.to, self.add = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, count = self.known[state]  # last[k], count[k]: at the position k bytes before the end
        text = suffix + bytes([byte])
        token = found = None
        for n in range(min(len(text), len(last)), 0, -1):
            t = text[-n:]
            if t in self.vocab and self.merges.apart(last[n - 1], t, lambda x: [x[i:i + 1] for i in range(len(x))]):
                token, found = t, count[n - 1] + 1
                break
        if token is None:
            raise ValueError("the vocabulary lacks a byte")
        keep = len(text)
        while keep and text[-keep:] not in self.begins:
            keep -= 1
        keep = min(keep, len(last))
        key = (text[len(text) - keep:], (token, *last[:keep]), (0, *(c - found for c in count[:keep])))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.known)
            self.known.append(key)
        return to, found - count[0]

    def lookup(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state * 256 + byte
        at = np.searchsorted(self.keys, key)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == key[hit]
        if not hit.all():
            new = np.unique(key[~hit])
            made = np.array([self.compile(int(k) >> 8, int(k) & 255) for k in new], np.int64).reshape(-1, 2)
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.to = np.concatenate([self.to, made[:, 0].astype(np.int32)])[order]
            self.add = np.concatenate([self.add, made[:, 1].astype(np.int32)])[order]
            at = np.searchsorted(self.keys, key)
        return self.to[at].astype(np.int64), self.add[at]

    def counts(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Tokens of data[s:e] for each pair; all step together, the longest first."""
        if len(self.known) > MAX_STATES:
            self.clear()
        size = e - s
        order = np.argsort(-size, kind="stable")
        first, left = s[order], size[order]
        state, total = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        live = len(s)
        for k in range(int(left[0]) if len(left) else 0):
            while live and left[live - 1] <= k:
                live = int(np.searchsorted(-left, -k, "left"))
            state[:live], add = self.lookup(state[:live], data[first[:live] + k].astype(np.int64))
            total[:live] += add
        out = np.empty(len(s), np.int64)
        out[order] = total
        return out


class Counter:
    """The compiled tokenizer of a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the fixed printable alphabet of byte-level vocabularies
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        byte = {c: b for b, c in letter.items()}
        raw = lambda t: bytes(byte[c] for c in t)
        self.special = [a["content"].encode() for a in spec["added_tokens"]]
        special = {a["content"] for a in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.automaton = CountTransducer(vocab, {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)})
        self.split = Tokenizer.from_file(path).pre_tokenizer
        self.classes = np.full(0x110000, 255, np.uint8)
        for c, k in ((" ", SP), ("'", AP), ("s", T), ("t", T), ("m", T), ("d", T), ("r", R), ("v", R), ("e", H), ("l", G)):
            self.classes[ord(c)] = k

    def classify(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point; those not met before are put to the library's splitter once."""
        got = self.classes[points]
        if (got == 255).any():
            for p in np.unique(points[got == 255]):
                c = chr(p)
                parts = lambda x: len(self.split.pre_tokenize_str(x))
                kind = L if parts("a" + c) == 1 else N if parts("1" + c) == 1 else O if parts("#" + c) == 1 else W
                self.classes[p] = kind
            got = self.classes[points]
        return got

    def pretokens(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and a mark for special strings, of every pre-token in the order of the block; they cover it."""
        text = b.data.tobytes()
        cuts = [b.off]
        for mark in self.special:
            at = text.find(mark)
            while at >= 0:
                doc = int(np.searchsorted(b.off, at, "right")) - 1
                if at + len(mark) <= b.off[doc + 1]:
                    cuts.append(np.array([at, at + len(mark)]))
                    at = text.find(mark, at + len(mark))
                else:
                    at = text.find(mark, at + 1)
        ends = np.unique(np.concatenate(cuts))
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((b.data & 0xC0) != 0x80)  # byte of each code point
        # a text end goes between the code points as a symbol of its own
        slot = np.searchsorted(lead, ends)
        classes = np.insert(self.classify(points), slot, E)
        where = np.insert(lead, slot, ends)
        bound = scan(classes) & (classes != E)
        mark = np.zeros(len(b.data) + 1, bool)
        mark[where[bound]] = mark[ends] = True
        inside = np.zeros(len(b.data) + 1, bool)  # of a special string
        for first, last in cuts[1:]:
            inside[first:last] = True
            mark[first + 1:last] = False
        s = np.flatnonzero(mark)
        return s[:-1], s[1:], inside[s[:-1]]

    def count(self, b: Block) -> np.ndarray:
        s, e, special = self.pretokens(b)
        doc = np.searchsorted(b.off, s, "right") - 1
        fixed = np.bincount(doc[special], minlength=b.n).astype(np.int64)
        s, e, doc = s[~special], e[~special], doc[~special]
        h = Prefix(b.data).sub(s, e) + (e - s).astype(np.uint64)
        _, one, back = np.unique(h, return_index=True, return_inverse=True)
        n = self.automaton.counts(b.data, s[one], e[one])
        return fixed + np.bincount(doc, n[back], b.n).astype(np.int64)


@lru_cache(maxsize=2)
def compiled(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text; ``path``: a byte-level BPE .json file
    that every executor can read (unset: the installed byte_bpe_50k.json, looked up where the task runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = path
        if at is None:
            import public_tokenizers

            at = public_tokenizers.path("byte_bpe_50k.json")
        counter = compiled(os.path.abspath(at))
        for b in blocks(batches):
            n = counter.count(b)
            yield pa.RecordBatch.from_arrays([b.cols["doc_id"].cast(pa.int64()), pa.array(np.diff(b.off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Best-fit packing: ids and pieces against the library, places by their definition, and the plan against piece-by-piece best-fit."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskflow.llm import best_fit

P = pytest.importorskip("public_tokenizers")


def texts():
    rnd = random.Random(9)
    bits = ["the", " of", "é", "梦", "'re", "'", "  ", "\n", "12", "#", "<|endoftext|>", " word", "🎉", "x" * 30, "\t"]
    out = [None, "", " ", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "a" * 5000, " ".join(f"w{i}" for i in range(4000))]
    out += ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 400))) for _ in range(120)]
    return out + ["same words here"] * 40 + [" x" * n for n in (1022, 1023, 1024, 2046, 2047, 2048)]


def cut(ids, size):
    first = (len(ids) - 1) % size + 1
    return [ids[:first], *(ids[k:k + size] for k in range(first, len(ids), size))]


@pytest.mark.parametrize(("size", "stride"), [(1024, 4096), (50, 3)])
def test_pieces_and_places(spark, monkeypatch, size, stride):
    from tokenizers import Tokenizer

    monkeypatch.setattr(best_fit, "STRIDE", stride)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [*enumerate(texts()), (None, "no id"), (5, "a" * 5000)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, length int, rank string, part int, lo int").repartition(5)
    packed = best_fit.pack(docs, size)
    got = packed.collect()
    want = []
    for i, t in rows:
        at = 0
        for k, ids in enumerate(cut([*lib.encode(t or "", add_special_tokens=False).ids, 2], size)):
            want.append((-1 if i is None else i, k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
            at += len(ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got) == sorted(want)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    assert len(by) == len(one_by_one([len(x[5]) for x in want], size))
    whole = {r.sequence_id: r for r in best_fit.sequences(packed).collect()}
    for r in got:
        assert list(whole[r.sequence_id].ids[r.offset:r.offset + r.length]) == list(r.ids)
    assert sum(len(r.ids) for r in whole.values()) == sum(len(x[5]) for x in want)


def test_no_rows(spark):
    assert best_fit.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def one_by_one(lengths, size):
    """Room left of every sequence, best-fit decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            k = min(fit, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(size - n)
    return rooms


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_equals_best_fit_of_single_pieces(histogram):
    size = 40
    runs = best_fit.plan(histogram, size)
    fill: dict[int, list] = {}
    for length in histogram:
        mine = sorted(r for r in runs if r[0] == length)
        assert [r[1] for r in mine] == [0, *(r[2] for r in mine)][:-1] and mine[-1][2] == histogram[length]
        for _, lo, hi, each, first, room in mine:
            for rank in range(lo, hi):
                fill.setdefault(first + (rank - lo) // each, []).append((room + (rank - lo) % each * length, length))
    for places in fill.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= size
    rooms = one_by_one([n for n, k in histogram.items() for _ in range(k)], size)
    assert sorted(rooms) == sorted(size - sum(n for _, n in x) for x in fill.values())


def test_plan_does_not_follow_the_number_of_documents():
    few = best_fit.plan({n: 1 + n % 7 for n in range(1, 1025)})
    many = best_fit.plan({n: (1 + n % 7) * 10**9 for n in range(1, 1025)})
    assert len(many) < 20 * len(few) < 10**6
    with pytest.raises(ValueError, match="does not fit"):
        best_fit.plan({1025: 1})

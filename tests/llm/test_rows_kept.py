"""Rows and items that must not get lost: repeated ids, null item ids, NUL bytes, and stages on odd tables."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest

from riskflow.llm import decontaminate, near_duplicates, repeated_passages

WORDS = [f"w{i}" for i in range(500)]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_keep_first_of_repeated_ids(spark):
    rnd = random.Random(1)
    a, b, c = (prose(rnd, 100) for _ in range(3))
    near_a = a.replace(a.split()[50], "swap", 1)
    rows = [(1, a), (5, b), (5, c), (5, near_a), (5, c), (6, b), (7, ""), (7, None), (None, a), (None, a), (8, "Two words"), (8, "two words")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, th string, s1 int").repartition(3)
    kept = near_duplicates.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in kept.collect())
    assert (8, "Two words") in got or (8, "two words") in got
    assert [x for x in got if x[0] != 8] == sorted([(1, a), (5, b), (5, c), (7, ""), (-1, a), (-1, a)]) and len(got) == 7


def test_items_without_id_and_short_items(spark):
    rnd = random.Random(2)
    passage = prose(rnd, 20)
    docs = [(1, "before it " + passage), (2, "the clean one " + "other " * 30), (3, None), (None, passage)]
    items = [(None, passage), (4, "the"), (5, "other other other other other other other")]
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, n_same int, item_id string, n_item int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.n_item) for r in decontaminate.matches(d, b).collect()}
    assert got == {(1, None, 20), (None, None, 20), (2, 4, 1), (2, 5, 7)}
    key = lambda x: (x is None, x)
    assert sorted((r.doc_id for r in decontaminate.keep_clean(d, b).collect()), key=key) == [2, 3, None]
    assert sorted((r.doc_id for r in decontaminate.keep_clean(d, b, least=1).collect()), key=key) == [3, None]


def brute(texts, span=400):
    """Removed bytes and runs by all strings of ``span`` bytes."""
    raw = [t.encode() for t in texts]
    seen = defaultdict(int)
    for t in raw:
        for k in range(len(t) - span + 1):
            seen[t[k:k + span]] += 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if seen[t[k:k + span]] > 1:
                gone[k:k + span] = b"\x01" * span
        runs = bytes(gone).split(b"\x00")
        out.append((sum(gone), sum(1 for r in runs if r)))
    return out


@pytest.mark.parametrize("filler", ["\x00", "n"])
def test_repeats_around_nul_bytes(spark, filler):
    rnd = random.Random(3)
    texts = []
    for _ in range(25):
        common = "".join(rnd.choice("abcdefgh") for _ in range(330))
        tail = lambda: "".join(rnd.choice("ABCDEFGH") for _ in range(rnd.randint(60, 160)))
        texts += [filler * 100 + common + tail(), filler * 100 + common + tail(), common + tail(), common + tail(), common + filler * 80 + tail(), common + filler * 80]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, rk string, h int").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeated_passages.dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_many_equal_rows_share_a_gram_with_other_texts(spark):
    rnd = random.Random(4)
    mid = "".join(rnd.choice("abcd") for _ in range(260))
    texts = ["L" * 200 + mid + "R" * 200] * 300 + ["l" * 180 + mid + "R" * 210, "x" * 150 + mid + "y" * 150]
    docs = spark.createDataFrame([(7 if i < 300 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in repeated_passages.dedup(docs).collect())
    assert got == sorted((7 if i < 300 else i, n, k) for i, (n, k) in enumerate(brute(texts)))


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated ids with unequal texts and columns with the names that operators use inside."""
    rnd = random.Random(5)
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = prose(rnd, 30)
    spark.createDataFrame([(1, item), (None, prose(rnd, 30)), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [prose(rnd, 120) for _ in range(40)]
    rows = [(i, texts[i], "en", "s", 1) for i in range(40)] + [(3, texts[4], "en", "s", 1), (50, None, None, None, None), (51, "", "de", None, 0), (None, texts[6], "en", "s", 1), (52, "a " + item, "en", "s", 1), (53, "mail a@b.cd " + texts[7][:50], "en", "s", 1)]
    extra = [(*r, "e", 0.5, 9, "t") for r in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, th string, score double, spans int, text__spans string").repartition(3)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert {0, 50, 51, None} <= kept and (52 in kept) == (name != "decontaminated"), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    stay = {(r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, str(tmp_path)).collect()}
    assert {(3, texts[3]), (3, texts[4]), (2, texts[2])} <= stay and (4, texts[4]) not in stay

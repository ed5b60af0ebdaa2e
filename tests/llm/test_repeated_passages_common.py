"""A line that fills many texts: its rows are shared among tasks, and the removed bytes stay exact."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskflow.llm import repeated_passages
from tests.llm.test_rows_kept import brute


@pytest.fixture
def shuffled(spark):
    """Joins by exchange, without partitions put together afterwards."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_common_key_is_shared_among_tasks(shuffled, monkeypatch):
    monkeypatch.setattr(repeated_passages, "PART", 50)
    raw = [(1, 1, i % 40, i) for i in range(3000)] + [(2, i // 2, i, i) for i in range(400)] + [(3, i, i, i) for i in range(100)]
    rows = shuffled.createDataFrame(raw, "h long, o long, rk long, at long")
    counts = rows.groupBy("h", "o").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    got = repeated_passages._repeats(rows, counts, ["h", "o"], ["rk", "at"]).select(*rows.columns, F.spark_partition_id().alias("task")).collect()
    assert sorted(r[:4] for r in got) == sorted(x for x in raw if x[0] < 3)
    assert max(Counter(r.task for r in got if r.h == 1).values()) < 600


def test_strings_of_a_common_gram_are_shared_among_tasks(shuffled, monkeypatch):
    """A passage with a thousand contexts: no task gets all of its gram's strings, and every string is fetched once."""
    rnd = random.Random(21)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line = word(300)
    texts = [word(150) + line + word(150) for _ in range(1000)] + [word(600) for _ in range(50)]
    docs = shuffled.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = []

    def fetch(docs, wanted):
        seen.extend(wanted.withColumn("task", F.spark_partition_id()).collect())
        return pieces(docs, wanted)

    pieces = repeated_passages._pieces
    monkeypatch.setattr(repeated_passages, "_pieces", fetch)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeated_passages.dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    gram, n = Counter(r.h for r in seen).most_common(1)[0]
    assert n > 600 and {r.k for r in seen if r.h == gram} == {n}
    assert len({(r.h, r.rk, r["at"]) for r in seen}) == len(seen)
    assert max(Counter(r.task for r in seen if r.h == gram).values()) < n / 2


@pytest.mark.parametrize("hot", [3, 50_000])
def test_a_line_that_fills_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(repeated_passages, "HOT", hot)
    monkeypatch.setattr(repeated_passages, "PART", 4)
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line = word(90) + "\n"
    texts = [word(rnd.randint(0, 300)) + line * rnd.randint(3, 30) + word(rnd.randint(0, 300)) for _ in range(30)] + [word(700) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeated_passages.dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_passages_of_over_fifty_words_go_from_400_bytes_on(spark):
    """60 words can be fewer than 400 bytes: the contract's length is in bytes."""
    rnd = random.Random(12)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    long = words(60)[:400]
    texts = [words(40) + "1" + long + "2" + words(30), words(5) + "3" + long + "4", words(40) + "5" + long[:399] + "6", words(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeated_passages.dedup(docs).collect()}
    assert got == {0: (400, 1), 1: (400, 1), 2: (0, 0), 3: (0, 0)}

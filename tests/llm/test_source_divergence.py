"""The divergence audit against a plain Python version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskflow.llm import source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def reference(rows, top=200, least=3):
    """rows: (text, lang, source)."""
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        got = Counter("".join(c.lower() if c < "\x80" else c for c in w) for w in TERM.findall(text))
        docs[lang].update(got.keys())
        count[lang, source].update(got)
    out = []
    for lang in {k[0] for k in count}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (k, s), c in count.items() if k == lang}

        def levels(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: levels(c) for s, c in groups.items()}
        q = levels(sum(groups.values(), Counter()))
        price = lambda x, y: (x - y) ** 2 // y
        for s in groups:
            pairs = sorted(((-sum(price(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            terms = sorted((-price(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


def texts():
    rnd = random.Random(5)
    vocab = [f"{a}{b}" for a in ("naïve", "Ab", "zz", "日本", "q") for b in "abcdefghijklmnop"]
    rows = [(" ".join(rnd.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=rnd.randint(0, 150))), rnd.choice(["en", "en", "de", None]), f"s{rnd.choice([0, 0, 0, 1, 2, 3, 4])}") for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "en", None), ("123 !!!", "fr", "a"), ("once", "fr", "b"), ("I'm x_y2z w", None, None), ("Aa " * 40_000, "de", "s1"), ("same text here", "en", "copy")]
    return rows + [("same text here", "en", "copy")] * 3


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize(("sources", "chunk"), [(512, (4096, 64)), (2, (7, 3))])
def test_equal_to_plain_python(spark, monkeypatch, sources, chunk):
    monkeypatch.setattr(source_divergence, "SOURCES", sources)
    monkeypatch.setattr(source_divergence, "CHUNK", chunk)
    rows = [(i % 50, t, a, s, 1, "x", 2) for i, (t, a, s) in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, term string, p int").repartition(4)
    assert got(source_divergence.audit(docs)) == reference(texts())
    assert got(source_divergence.audit(docs, top=3, min_docs=1)) == reference(texts(), 3, 1)


def test_no_rows(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert got(source_divergence.audit(none)) == []


def test_tiles_hold_every_cell(monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(source_divergence, "TILE", 4)
    p = {(t, s): rnd.choice([10, 20, 30]) for t in "abcdefgh" for s in range(3) if rnd.random() < 0.7}
    rows = pa.table({"term": [t for t, _ in p], "idx": [s for _, s in p], "p": list(p.values()), "lang": ["x"] * len(p), "low": [0] * len(p), "high": [0] * len(p)})
    heads = pa.table({"idx": [2, 0, 1], "p0": [7, 5, 6], "block": [0, 0, 0]})
    out = source_divergence._priced(rows, heads)
    terms = sorted({t for t, _ in p})
    level = lambda t, s: p.get((t, s), 5 + s)
    want = {(a, b): sum((level(t, a) - level(t, b)) ** 2 // level(t, b) for t in terms) for a in range(3) for b in range(3) if a != b}
    assert {(r["a"], r["b"]): r["value"] for r in out.to_pylist()} == want
    assert set(out.column("seen").to_pylist()) == {len(terms)}


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(9 * 10**11, 2 * 10**13, 10**9)], "n long, total long, v long").withColumn("p", source_divergence._level("n"))
    assert df.first().p == 1 + 10**9 * (9 * 10**11 + 1) // (2 * 10**13 + 10**9)
    x = np.array([10**9 + 1])
    assert source_divergence._price(x, np.array([1]))[0] == 10**18

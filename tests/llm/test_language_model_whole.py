"""The query's language model takes words and contexts by absolute counts, not by their share of the corpus."""

import math
import random
import zlib
from collections import Counter, defaultdict

from riskflow.llm import catalog, language_model


def reference(rows):
    """Scores of a model whose states, in contexts of any length, are all words seen five times in training."""
    toks = {i: [*t.split(), "\0"] for i, t in rows}
    train = [x for i, x in toks.items() if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    states = {w for w in c if c[w] >= 5} - {"\0"}
    ends = states | {"\0"}
    b2 = Counter((x[k - 1], x[k]) for x in train for k in range(1, len(x)) if x[k - 1] in states and x[k] in ends)
    b3 = Counter(tuple(x[k - 2:k + 1]) for x in train for k in range(2, len(x)) if x[k - 2] in states and x[k - 1] in states and x[k] in ends)
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = {g: (k - 0.5) / c[g[0]] for g, k in b2.items() if k > 1}
    p3 = {g: (k - 0.5) / b2[g[:2]] for g, k in b3.items() if k > 1}
    sums = defaultdict(lambda: [0.0, 0.0])
    for g, p in [*p2.items(), *p3.items()]:
        sums[g[:-1]][0] += p
        sums[g[:-1]][1] += p1(g[1]) if len(g) == 2 else p2[g[1:]]
    back = lambda h: (1 - sums[h][0]) / (1 - sums[h][1]) if h in sums else 1.0
    q2 = lambda a, w: (p2.get((a, w)) or back((a,)) * p1(w)) if a in states else p1(w)
    q3 = lambda a, b, w: p3.get((a, b, w)) or (back((a, b)) if a in states and b in states else 1.0) * q2(b, w)
    score = lambda x: sum(math.log10(q3(x[k - 2], x[k - 1], w) if k > 1 else q2(x[0], w) if k else p1(w)) for k, w in enumerate(x))
    return {i: score(x) for i, x in toks.items()}, c, n


def scored(spark, rows):
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, blk string").repartition(3)
    return {r.doc_id: r for r in language_model.score(docs).collect()}


def test_long_texts_are_cut_without_a_trace(spark, monkeypatch):
    """Segments of seven tokens begin two words early and give the sums of whole texts."""
    monkeypatch.setattr(language_model, "SEGMENT", 7)
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices([f"w{k}" for k in range(12)], k=rnd.choice([0, 1, 5, 6, 7, 8, 13, 14, 15, 300])))) for i in range(120)]
    got, (want, _, _) = scored(spark, rows), reference(rows)
    assert all(math.isclose(got[i].score, want[i], rel_tol=1e-9) for i in want)


def test_contexts_before_unknown_words(spark, monkeypatch):
    """Blocks of a few texts, where a context is followed by words without a state or by pairs that are not kept."""
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 30)
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 500)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice([rnd.choice("abcdef"), f"once{rnd.randint(0, 10**6)}", rnd.choice([f"w{k}" for k in range(40)])]) for _ in range(rnd.randint(0, 12)))) for i in range(150)]
    got, (want, _, _) = scored(spark, rows), reference(rows)
    assert all(math.isclose(got[i].score, want[i], rel_tol=1e-9) for i in want)


def test_no_training_texts(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = scored(spark, [(i, "some words here") for i in held])
    assert len(got) == len(held) and all((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 4, 0, 0) and abs(r.score) < 1e-12 for r in got.values())


def test_states_and_contexts_by_absolute_count(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 9000)
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 20_000)
    rnd = random.Random(11)
    common = [f"c{i}" for i in range(30)]
    rare = [f"rare{i} pair{i} next{i}" for i in range(60)]  # words of some 6 to 20 occurrences in 90,000 tokens
    rows = [(i, " ".join([*rnd.choices(common, k=200), rnd.choice(rare), *rnd.choices(common, k=20), rnd.choice(rare)])) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in catalog.op8_language_model(spark, str(tmp_path)).collect()}
    want, c, n = reference(rows)
    assert sum(5 <= k < 1e-3 * n for k in c.values()) > 100  # a share would shut them out of the longer contexts
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)

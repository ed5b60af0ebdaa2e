"""The operators against plain Python versions on small fixtures that hold nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import (
    decontaminate,
    language_model,
    near_duplicates,
    personal_data,
    quality_classifier,
    quality_rules,
    repeated_passages,
    sentence_pieces,
    token_counts,
    url_filters,
)

P = pytest.importorskip("public_tokenizers")
WORD = r"[^\x20\x09-\x0D]+"


def low(t):
    return "".join(c.lower() if c < "\x80" else c for c in t or "")


def texts():
    rnd = random.Random(7)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)] + ["the", "of"] * 60
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    shared = make(120)
    out = [None, "", " ", "\n\n", "one", "two words", "a" * 3000, "ab" * 500, "x" * 400, "The the THE", "tab\there\nline\nline\n\nline"]
    for _ in range(70):
        t = make(rnd.randint(0, 260))
        out.append(t + " " + shared[rnd.randint(0, 60):] if rnd.random() < 0.3 else t)
    for i in range(15, 25):
        w = out[i].split()
        for k in range(0, len(w), 40):
            w[k] = "swap"
        out.append(" ".join(w))
    out += [out[30], out[31], "$$$ ### " * 60, make(30000)]
    return out


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts())) + [(30, texts()[30])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, "x", None, None, "n", 1) for i, t in rows]  # names that the operators use inside
    return spark.createDataFrame(extra, "doc_id long, text string, n string, h string, rk string, score string, id int").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = token_counts.token_counts(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(empty).count() == 0


def test_token_counts_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from riskflow.llm.blocks import blocks

    path = P.path("byte_bpe_50k.json")
    lib, mine, rnd = Tokenizer.from_file(path), token_counts.Counter(path), random.Random(1)
    bits = ["a", "s", "t", "re", "ll", "l", "r", "e", "'", "'", " ", "  ", "\n", "1", "é", "梦", "#", " the", "²", "🎉", "\r", "x" * 30, "<|endoftext|>", "\u0085", "Ⅷ"]
    odd = ["'r", "'rx", "a'r ", "a\n's", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|> c", " " * 300] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 50))) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(odd))), pa.array(odd)], ["doc_id", "text"])
    got = [int(n) for b in blocks(iter([batch]), limit=1 << 14) for n in mine.count(b)]
    assert got == [len(lib.encode(t, add_special_tokens=False).ids) for t in odd]


def test_sentence_pieces(spark, docs, rows, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    enc = sentence_pieces.encode(docs)
    got = sorted((r.doc_id, list(r.ids), r.round_trip) for r in enc.collect())
    assert got == sorted((i, list(lib.encode(t or "")), True) for i, t in rows)
    back = sentence_pieces.decode(enc)
    assert sorted(map(tuple, back.collect())) == sorted((i, t or "") for i, t in rows)
    assert sentence_pieces.encode(empty).count() == 0
    rnd = random.Random(2)
    bits = ["a", "the", "ing", "é", "梦", " ", "  ", "\n", "1", "!!", " " * 17, "▁", "🎉", "<s>", "<0x0A>", "\x00", "Hello"]
    odd = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    ids, size = sentence_pieces.Pieces(P.path("piece_bpe_32k.model")).encode(odd)
    at = 0
    for t, n in zip(odd, size, strict=True):
        assert ids[at:at + n].tolist() == lib.encode(t)
        at += n


def test_url_filters(spark):
    pages = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?q=1"), (4, "https://x.example.org/en/12#t"), (5, "http://org"), (6, "http://a.com/fr/de"),
             (7, "http://b.com/de/"), (8, "http://notexample.org/es/"), (9, "a://b://c/d")]
    pages += [(100 + i, f"http://h{i % 9}.test/{'bad' if i % 3 == 0 else 'good'}/{i}?k=v") for i in range(90)] + [(100, "http://h0.test/bad/0?k=v")]
    labels = [(100 + i, 0 if i % 3 == 0 else 1, 0) for i in range(60)] + [(None, 0, 0), (101, None, 0)]
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(p, lab).collect()}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("org", "", None, "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[8][2:] == ("org/", "allow")
    assert got[9][:2] == ("b:", "//c/d")
    assert all(got[100 + i][3] == ("block" if i % 3 == 0 else "allow") for i in range(90))  # learned from 60, met in 90
    assert url_filters.judge(p.limit(0), lab).count() == 0
    assert url_filters.judge(p, lab.limit(0)).where("verdict = 'block'").count() == 3

    import duckdb

    con = duckdb.connect()
    con.register("pages", p.toPandas())
    con.register("labels", lab.toPandas())
    want = Counter(con.execute(url_filters.oracle()).fetchall())
    assert Counter(tuple(r) for r in url_filters.judge(p, lab).collect()) == want


def test_decontaminate(spark):
    rnd = random.Random(3)
    words = [f"b{i}" for i in range(300)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(15, 40)))) for k in range(12)] + [(50, None), (51, ""), (52, "too short")]
    clean = [f"c{i}" for i in range(300)]
    prose = lambda n: " ".join(rnd.choice(clean) for _ in range(n))
    docs, want = [(900, None), (901, ""), (902, "x" * 200_000)], set()
    for k in range(60):
        i, t = rnd.choice(items[:12])
        w = t.split()
        if k % 3 == 0:
            docs.append((k, prose(200)))
            continue
        if k % 3 == 2:
            w[len(w) // 2] = "other"  # one word replaced
        docs.append((k, prose(50) + "\n" + ", ".join(w).upper() + ". " + prose(40)))
        want.add((k, i))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(d, b).collect()} == want
    kept = decontaminate.keep_clean(d, b)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.matches(d.limit(0), b).count() == 0


def test_decontaminate_frequent_seeds_in_parts(monkeypatch):
    from riskflow.llm.blocks import Block

    rnd = random.Random(5)
    items = decontaminate.Items([7, 8, 9], ["the " * 40, " ".join(f"b{i}" for i in range(30)), "of the " * 20])
    texts = ["the " * 500, "of the " * 300, " ".join(rnd.choice(["the", "of", "b3"]) for _ in range(400)), "c " * 50 + " ".join(f"b{i}" for i in range(10, 30))]
    raw = [t.encode() for t in texts]
    b = Block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), {})
    whole = items.match(*decontaminate.token_hashes(b))
    monkeypatch.setattr(decontaminate, "HITS", 7)
    parts = items.match(*decontaminate.token_hashes(b))
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
    found = set(zip(whole[0].tolist(), whole[1].tolist(), whole[2].tolist(), strict=True))
    assert {(0, 0, 13), (1, 2, 13), (3, 1, 13)} <= found


def base_rules(t):
    t = t or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    tri = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for j in range(3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_rules(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1) for i, _ in rows[12:60]], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted((i, *base_rules(t)) for i, t in rows)
    ratio = quality_rules.log_ratios(docs, labels)
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        keys = []
        for n in quality_rules.GRAMS:
            for k in range(len(raw) - n + 1):
                x = int.from_bytes(raw[k:k + n], "little") + n * 0x9E3779B1 & 0xFFFFFFFF
                x = x * 0x85EBCA6B & 0xFFFFFFFF
                keys.append(((x ^ x >> 15) * 0xC2B2AE35 & 0xFFFFFFFF) >> 16)
        want = sum(ratio[k] for k in keys) / max(len(keys), 1)
        assert math.isclose(r.llr, want, abs_tol=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    assert quality_rules.judge(empty, labels).count() == 0
    assert {r.llr for r in quality_rules.judge(docs, labels.limit(0)).collect()} == {0.0}


def test_quality_classifier(spark, docs, rows, empty):
    tables = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]
    got = quality_classifier.classify(*tables).join(tables[1], "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert got >= 0.97
    one = quality_classifier.classify(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")).collect()
    assert len(one) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in one)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.classify(docs, none).collect()} == {0.5}
    assert quality_classifier.classify(empty, none).count() == 0


def test_near_duplicates(docs, rows, empty):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, low(t))
        sets[i] = frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_duplicates.link(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), r.doc_id == find(r.doc_id))
    kept = near_duplicates.keep_first(docs, 4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if find(i) == i) and kept.columns == docs.columns
    assert near_duplicates.link(empty).count() == 0


def test_sketch_fills_every_coordinate():
    import numpy as np

    key = np.arange(1, 402, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.concatenate([np.zeros(1, np.int64), np.ones(400, np.int64)])
    sk = near_duplicates.sketch(key, doc, 3)
    assert (sk[:2] != near_duplicates._EMPTY).all() and (sk[2] == near_duplicates._EMPTY).all()
    half = near_duplicates.sketch(np.concatenate([key[1:], key[101:]]), np.concatenate([np.zeros(400, np.int64), np.ones(300, np.int64)]), 2)
    assert abs((half[0] == half[1]).mean() - 0.75) < 0.12


def test_language_model(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 3000)
    end = "\0"
    toks = [(i, re.findall(WORD, low(t)) + [end]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, x in toks if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    states = {w for w in c if c[w] >= max(5, 1e-4 * n)} - {end}
    wide = {w for w in states if c[w] >= max(5, 1e-3 * n)}
    b2, b3 = Counter(), Counter()
    for i, x in toks:
        if not held[i]:
            for k in range(1, len(x)):
                if x[k - 1] in states and x[k] in states | {end}:
                    b2[x[k - 1], x[k]] += 1
                if k > 1 and x[k - 2] in wide and x[k - 1] in wide and x[k] in states | {end}:
                    b3[x[k - 2], x[k - 1], x[k]] += 1
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = {g: (k - 0.5) / c[g[0]] for g, k in b2.items() if k > 1}
    p3 = {g: (k - 0.5) / b2[g[:2]] for g, k in b3.items() if k > 1}
    s2, s3 = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    for (a, w), p in p2.items():
        s2[a][0] += p
        s2[a][1] += p1(w)
    for (a, b, w), p in p3.items():
        s3[a, b][0] += p
        s3[a, b][1] += p2[b, w]
    back = lambda s, h: (1 - s[h][0]) / (1 - s[h][1]) if h in s else 1.0
    q2 = lambda a, w: p2.get((a, w)) or back(s2, a) * p1(w)
    q3 = lambda a, b, w: p3.get((a, b, w)) or back(s3, (a, b)) * q2(b, w)

    def total(x):
        out = 0.0
        for k, w in enumerate(x):
            if k > 1 and x[k - 2] in wide and x[k - 1] in wide:
                out += math.log10(q3(x[k - 2], x[k - 1], w))
            else:
                out += math.log10(q2(x[k - 1], w) if k and x[k - 1] in states else p1(w))
        return out

    got = sorted(map(tuple, language_model.score(docs, shares=(1e-4, 1e-3)).collect()))
    want = sorted((i, held[i], len(x), sum(c[w] > 0 for w in x), n, sum(math.log10(p1(w)) for w in x), total(x)) for i, x in toks)
    assert p2 and p3
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)
    assert language_model.score(empty).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def confirmed(kind, m):
    d = re.sub("[^0-9]", "", m)
    return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15


def test_personal_data(spark):
    rnd = random.Random(3)
    bits = ["a", "b.c", "@", "@x.y", "x@y.z", " ", "-", ".", "1", "12", "255", "0300", "4111111111111111", "4111 1111 1111 1111", "+1 (706) 555-3138", "+", "(", ")", "😀", "é", "\n", "%", "\x01", "192.168.0.1", "GB82 WEST 1234 5698 7654 32"]
    rows = list(enumerate([None, "", "+1", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "a@b..c", "1 " * 5000, "a" * 30000 + "@b.c"] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(1500)]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: r for r in personal_data.digest(docs).collect()}
    for i, t in rows:
        found = [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], t or "") if confirmed(k, m.group())]
        assert got[i].base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert got[i].spans.startswith(",".join(found))
        assert got[i].n_email == sum(x.startswith("email") for x in found)
    ex = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32, GB83 WEST 1234 5698 7654 32"), (2, "my ssn 123-45-6789"), (3, "part 123-45-6789"), (4, None), (5, "mail x@y.z now")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in personal_data.digest(ex).collect()}
    assert spans[1] == "iban:5:32" and spans[2] == "ssn:7:18" and spans[3] == ""
    clean = {r.doc_id: r.text for r in personal_data.redact(ex).collect()}
    assert clean == {1: "iban [IBAN], GB83 WEST 1234 5698 7654 32", 2: "my ssn [SSN]", 3: "part 123-45-6789", 4: None, 5: "mail [EMAIL] now"}
    assert personal_data.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [3, 50_000])
def test_repeated_passages(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(repeated_passages, "HOT", hot)
    monkeypatch.setattr(repeated_passages, "CHUNK_ROWS", 40)
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k:k + 400] for _, t in raw for k in range(len(t) - 399))
    want = []
    for i, t in raw:
        mask = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k:k + 400]] > 1:
                mask[k:k + 400] = b"\1" * 400
        kept = bytes(c for c, m in zip(t, mask, strict=True) if not m)
        want.append((i, len(t), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r)[:5] for r in repeated_passages.dedup(docs).collect()) == sorted(want)
    assert sum(w[2] for w in want)
    assert repeated_passages.dedup(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, sf))
        assert docs.columns == start.columns, name
    ids = cp.run(spark, sf)
    assert {r.doc_id for r in ids.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    kept = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert not any(personal_data.BASE[0] in (t or "") and re.search(BASE["email"], t) for t in kept.values())
    assert len(set(kept.values())) == len(kept)
    assert set(labels[labels.quality == 0].doc_id).isdisjoint(kept) or len(set(labels[labels.quality == 0].doc_id) & set(kept)) <= 2
    odd = start.limit(20).unionByName(start.limit(1).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))
    assert cp.quality(spark, odd, sf).where("doc_id is null").count() == 1  # not judged: stays
    assert cp.run  # an empty table passes through every stage
    none = start.limit(0)
    for _, stage in cp.STAGES:
        none = stage(spark, none, sf)
    assert none.count() == 0

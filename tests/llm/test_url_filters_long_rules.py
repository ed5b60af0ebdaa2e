"""Mined rules of more than three tokens decide too."""

from itertools import combinations

from riskflow.llm import url_filters


def test_rule_of_four_tokens_blocks(spark):
    whole = ("host:a", "host:b", "path:c", "path:d")
    urls = {"http://a.b/c/d": 0, "http://b/c/d": 1, "http://a/c/d": 1, "http://a.b/d": 1, "http://a.b/c": 1}
    of = dict(zip(urls, [whole, *(tuple(t for t in whole if t != x) for x in whole)], strict=True))
    pages = [(k * 10 + j, u) for k, u in enumerate(urls, 1) for j in range(8)]
    labels = [(i, urls[u]) for i, u in pages]
    bad = lambda c: [urls[u] == 0 for _, u in pages if set(c) <= set(of[u])]
    rate = sum(bad(())) / len(pages)
    want = [c for n in range(1, 5) for c in combinations(whole, n) if sum(x := bad(c)) >= 5 and sum(x) / len(x) >= 0.6 and sum(x) / len(x) / rate >= 1.5]
    assert want == [whole]
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    assert [tuple(r.tokens) for r in url_filters.mine(p, lab).collect()] == want
    assert {i: r for i, r in url_filters.judge(p, lab, ()).select("page_id", "verdict").collect()} == {i: "block" if urls[u] == 0 else "allow" for i, u in pages}

"""The fixed rules with the words of the contract: in the code, and in the SQL that is made of them."""

import duckdb

from riskflow.llm import url_filters

CONTRACT = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def test_rules_are_those_of_the_contract(spark):
    pages = [(i, f"http://{r}x") for i, r in enumerate(CONTRACT)] + [(9, "http://example.org/en/2")]
    p = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    want = {(i, r, CONTRACT[r]) for i, r in enumerate(CONTRACT)} | {(9, "org/", "allow")}
    assert {tuple(r) for r in url_filters.judge(p, lab).select("page_id", "rule", "verdict").collect()} == want
    con = duckdb.connect()
    con.register("pages", p.toPandas())
    con.sql("create table labels (doc_id bigint, quality int)")
    assert set(con.execute(f"select page_id, rule, verdict from ({url_filters.oracle()})").fetchall()) == want

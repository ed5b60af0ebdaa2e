"""URL filters: a fixed rule list, then association rules mined by FP-growth, by DataFrame expressions only.

``mine`` takes labelled URLs as transactions of tokens (host labels, path segments with digits
as ``#``, query keys) plus the label; FP-growth finds the frequent combinations, and the
rules "tokens -> block" of any length stay that pass support, confidence and lift.  ``judge`` matches them by an
inverted index: each rule is filed under its rarest token, a URL meets only the rules filed under
one of its tokens, and the remaining tokens are then tested.

A null URL, or one without ``://``, has an empty host and path, no tokens, no rule and the verdict
allow.  ``n_matched`` counts the matching rules of at most ``COUNTED_TOKENS`` tokens, as the SQL twin does; the
verdict follows the matching rules of any length.  Without labels nothing is mined.  Repeated rows get equal verdicts.  Pages are read by
``page_id`` and ``url`` alone; a page is labelled by the label row whose doc_id is its page_id.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.blocks import stored

#: (verdict, rule); a rule is a host and a path, fits the host and its subdomains, the longest fitting one wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT = 0.002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
COUNTED_TOKENS = 3
LABEL = "label:block"

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(u, _PARTS, 2)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest fitting rule, or nulls."""
    rule = verdict = None
    for what, r in sorted(rules, key=lambda x: -len(x[1])):
        h, p = r[:r.index("/")], r[r.index("/"):]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, sorted."""
    host, path = host_and_path(url)
    some = lambda parts: F.filter(parts, lambda x: x != "")
    hosts = F.transform(some(F.split(host, "\\.")), lambda x: F.concat(F.lit("host:"), x))
    paths = F.transform(some(F.split(path, "/")), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key:"), x))
    return F.array_sort(F.array_distinct(F.concat(hosts, paths, keys)))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules: token (under which the rule is filed), tokens, confidence, lift; written to the shared folder."""
    spark = pages.sparkSession
    bad = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    rows = pages.select("page_id", tokens(F.col("url")).alias("tokens")).join(bad, "page_id")
    rows = stored(rows.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(LABEL))).otherwise(F.col("tokens")).alias("items")))
    n = rows.count()
    empty = spark.createDataFrame([], "token string, tokens array<string>, confidence double, lift double")
    if not n:
        return empty
    least = max(min_count, math.ceil(min_support * n))
    model = FPGrowth(itemsCol="items", minSupport=min((least - 0.5) / n, 1.0), minConfidence=min_confidence).fit(rows)
    single = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    rules = model.associationRules.where((F.col("consequent")[0] == LABEL) & (F.col("lift") >= min_lift))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift")
    rarest = rules.select("*", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens", "confidence", "lift").agg(F.min_by("token", F.struct("freq", "token")).alias("token"))
    return stored(rarest.select("token", "tokens", "confidence", "lift"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the number of mined rules that match."""
    learned = mine(pages, labels)
    urls = pages.select("url", tokens(F.col("url")).alias("own")).where("size(own) > 0")
    met = urls.select("url", "own", F.explode("own").alias("token")).join(learned, "token")
    met = met.where(F.size(F.array_except("tokens", "own")) == 0).select("url", "tokens").distinct().groupBy("url").agg(F.count_if(F.size("tokens") <= COUNTED_TOKENS).alias("n_matched"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(met, "url", "left")
    n = F.coalesce(F.col("n_matched"), F.lit(0)).cast("long")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("n_matched").isNotNull(), "block").otherwise("allow")).alias("verdict"), n.alias("n_matched"))


def oracle() -> str:
    """The same in DuckDB SQL: combinations of up to three tokens are counted one by one."""
    def fits(r: str) -> str:
        h, p = r[:r.index("/")], r[r.index("/"):]
        return f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"

    order = sorted(RULES, key=lambda x: -len(x[1]))
    rule = "case " + " ".join(f"when {fits(r)} then '{r}'" for _, r in order) + " end"
    verdict = "case " + " ".join(f"when {fits(r)} then '{v}'" for v, r in order) + " end"
    return f"""
with parts as (
  select page_id, url, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(coalesce(url, ''), '{_PARTS}', 2) as path from pages),
own as (
  select *, row_number() over () as k, list_sort(list_distinct(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x)
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '#', 'g'))
    || list_transform(regexp_extract_all(coalesce(url, ''), '[?&]([^=&#]+)', 1), lambda x: 'key:' || x))) as tokens from parts),
tok as (select k, unnest(tokens) as t from own),
combos as (
  select k, [t] as c from tok
  union all select a.k, [a.t, b.t] from tok a join tok b on a.k = b.k and a.t < b.t
  union all select a.k, [a.t, b.t, d.t] from tok a join tok b on a.k = b.k and a.t < b.t join tok d on b.k = d.k and b.t < d.t),
lab as (select o.k, quality = 0 as bad from own o join labels l on l.doc_id = o.page_id where quality is not null),
total as (select count(*) as n, greatest({MIN_COUNT}, ceil({MIN_SUPPORT} * count(*))) as least, avg(case when bad then 1.0 else 0.0 end) as rate from lab),
mined as (
  select c from combos join lab using (k), total group by c, n, least, rate
  having sum(bad::int) >= least and sum(bad::int)::double / count(*) >= {MIN_CONFIDENCE} and sum(bad::int)::double / count(*) / rate >= {MIN_LIFT}),
met as (select k, count(*) as n_matched from combos join mined using (c) group by k)
select page_id, host, path, {rule} as rule,
       coalesce({verdict}, case when n_matched > 0 then 'block' else 'allow' end) as verdict, coalesce(n_matched, 0)::bigint as n_matched
from own left join met using (k)
"""

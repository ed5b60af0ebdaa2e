"""Divergence audit of the sources of each language by one-hot level products.

Terms are runs of letters and of code points above ASCII, A-Z lower-cased.  A language keeps the terms
of at least ``MIN_DOCS`` of its documents.  A group (language and source) gives each kept term, with
``count`` occurrences there (zero included), p = 1 + floor(``SCALE`` * (count + 1) / (N + V)); N is the
group's sum over the V kept terms.  A level is a group's p for a count.  The divergence of p from q on
a term is floor((p - q)^2 / q).

The kept terms are the rows of a 0/1 matrix with a column for each (source, level): its product with its
transpose holds, for any two sources, how many terms have each pair of levels (their joint table), and a
pair's divergence is this table priced cell by cell.  The product is made in blocks: chunks of terms of
similar frequency (so that a chunk has few levels) times blocks of sources, one Spark group each, and
column tiles inside.  A chunk has at most ``CHUNK`` terms on average, so float32 sums of ones are exact;
prices are integers, and added up in Spark.  Terms in neither source lie in one cell, which is counted as
the rest of V.

Word counts are summed per text block, per task and per (language, source, term) before terms meet, so
a common word or a hot source is split over many tasks.  A language's result has a row for each ordered
pair of its sources: that the audit asks for.

Null text, lang and source are ''.  Repeated rows count as documents each.  Groups without terms are
there.  An empty table gives an empty result; a language without kept terms gives pairs of value 0.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.blocks import LOWER, blocks, stored, words

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
CHUNK = (1024, 64)  # terms in a chunk: of rare terms, which have few levels, and of others
RARE = 5  # bits of the number of occurrences
SOURCES = 512  # in a block
TILE = 1024  # columns of a tile
_BLOCK = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=_BLOCK):
            s, e, doc = words(b, ~_LETTER)
            if not len(s):
                continue
            group = pa.StructArray.from_arrays([b.cols["lang"], b.cols["source"]], ["lang", "source"])
            names: dict[tuple, int] = {}
            of = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in group.to_pylist()], np.int64)
            # words lie back to back once everything else is left out
            letters = LOWER[b.data][_LETTER[b.data]]
            terms = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(np.append(0, np.cumsum(e - s))), pa.py_buffer(letters.tobytes())).dictionary_encode()
            code, v = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(terms.dictionary)
            here, times = np.unique(doc * v + code, return_counts=True)
            key, back = np.unique(of[here // v] * v + here % v, return_inverse=True)
            langs, sources = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
            at = pa.array(key // v)
            yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), terms.dictionary.cast(pa.string()).take(pa.array(key % v)),
                                              pa.array(np.bincount(back, times).astype(np.int64)), pa.array(np.bincount(back).astype(np.int64))], ["lang", "source", "term", "n", "d"])

    part = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).mapInArrow(run, "lang string, source string, term string, n long, d long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _level(count: str) -> F.Column:
    """p of a count, in decimals: counts times ``SCALE`` pass 64 bits on large corpora."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) div cast(total + v as decimal(20,0))").cast("long")


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _joint(rows: pa.Table, heads: pa.Table) -> tuple[dict[int, np.ndarray], list[tuple[np.ndarray, ...]], int]:
    """Non-empty cells (source, level, source, level, terms) of all joint tables of a chunk, tile by tile, and its number of terms."""
    terms = rows.column("term").combine_chunks().dictionary_encode()
    term, n = terms.indices.to_numpy(zero_copy_only=False), len(terms.dictionary)
    idx, zero = heads.column("idx").to_numpy(), heads.column("p0").to_numpy()
    order = np.argsort(idx)
    idx, zero = idx[order], zero[order]
    level = np.repeat(zero[:, None], n, 1)  # of each source in each term
    level[np.searchsorted(idx, rows.column("idx").to_numpy()), term] = rows.column("p").to_numpy()
    columns = [(k, x, level[k] == x) for k in range(len(idx)) for x in np.unique(level[k])] if n else []
    cells = []
    tiles = [columns[i:i + TILE] for i in range(0, len(columns), TILE)]
    dense = lambda tile: np.array([c[2] for c in tile], np.float32)
    for i, left in enumerate(tiles):
        a = dense(left)
        ka, pa_ = np.array([c[0] for c in left]), np.array([c[1] for c in left])
        for right in tiles[i:]:
            found = a @ (a if right is left else dense(right)).T
            x, y = np.nonzero(found)
            kb, pb = np.array([c[0] for c in right]), np.array([c[1] for c in right])
            cells.append((ka[x], pa_[x], kb[y], pb[y], found[x, y].astype(np.int64), right is left))
    return {"idx": idx}, cells, n


def _priced(rows: pa.Table, heads: pa.Table) -> pa.Table:
    """Divergence sums of every ordered pair of sources of a chunk's two source blocks, and the chunk's number of terms."""
    head, cells, n = _joint(rows, heads)
    idx = head["idx"]
    g = len(idx)
    total = np.zeros(g * g, np.int64)
    for a, p, b, q, times, same in cells:
        np.add.at(total, a * g + b, times * _price(p, q))
        if not same:  # the product is symmetric: the other half of the tiles
            np.add.at(total, b * g + a, times * _price(q, p))
    block = heads.column("block").to_numpy()[np.argsort(heads.column("idx").to_numpy())]
    low, high = rows.column("low")[0].as_py() if len(rows) else 0, rows.column("high")[0].as_py() if len(rows) else 0
    a, b = np.divmod(np.arange(g * g), g)
    mine = (a != b) & (np.minimum(block[a], block[b]) == low) & (np.maximum(block[a], block[b]) == high) if len(rows) else np.zeros(g * g, bool)
    a, b = a[mine], b[mine]
    lang = rows.column("lang")[0].as_py() if len(rows) else ""
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(idx[a]), pa.array(idx[b]), pa.array(total[mine]), pa.array(np.full(len(a), n, np.int64))], ["lang", "a", "b", "value", "seen"])


def audit(docs: DataFrame, top: int = TOP, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    per_term = Window.partitionBy("lang", "term")
    kept = stored(counts(docs)).withColumns({
        "lang_n": F.sum("n").over(per_term), "lang_d": F.sum("d").over(per_term), "lead": F.min("source").over(per_term) == F.col("source")})
    kept = stored(kept.where(F.col("lang_d") >= min_docs).select("lang", "source", "term", "n", "lang_n", "lead"))
    names = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("lead").alias("v"))
    groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "v"])
    groups = stored(groups.withColumn("idx", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")).withColumn("block", F.expr(f"idx div {SOURCES}"))
                    .withColumn("p0", F.when(F.col("v") > 0, _level("0L"))))
    levels = kept.join(groups.select("lang", "source", "total", "lang_total", "v", "idx", "block"), ["lang", "source"]).withColumn("p", _level("n")).withColumn("bits", F.length(F.bin("lang_n")))
    of_lang = levels.drop("total").withColumnRenamed("lang_total", "total").withColumn("q", _level("lang_n")).where("p > q")
    terms = of_lang.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = _pairs(levels, groups).withColumn("rank", F.row_number().over(order))
    one = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return one(pairs, "pair").unionByName(one(terms, "term"))


def _pairs(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value, from blocked products of the level indicators."""
    many = F.expr(f"cast(ceil(terms / if(bits <= {RARE}, {CHUNK[0]}, {CHUNK[1]})) as long)")
    sizes = stored(levels.where("lead").groupBy("lang", "bits").agg(F.count(F.lit(1)).alias("terms")).withColumn("chunks", many))
    wide = stored(groups.groupBy("lang").agg((F.max("block") + 1).alias("wide")))
    both = F.explode(F.expr("transform(sequence(0L, wide - 1), x -> struct(least(x, block) as low, greatest(x, block) as high))"))  # every pair of source blocks with this one
    rows = levels.join(sizes, ["lang", "bits"]).join(wide, "lang")
    rows = rows.withColumn("chunk", F.expr("pmod(xxhash64(term), chunks)")).withColumn("pair", both).select("lang", "bits", "chunk", "pair.low", "pair.high", "term", "idx", "p")
    heads = groups.where("v > 0").join(wide, "lang").withColumn("pair", both).join(sizes, "lang").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
    heads = heads.select(*(F.col(c).alias(c.split(".")[-1]) for c in ("lang", "bits", "chunk", "pair.low", "pair.high", "idx", "block", "p0")))  # columns of its own beside those of rows
    key = ["lang", "bits", "chunk", "low", "high"]
    sums = rows.groupBy(key).cogroup(heads.groupBy(key)).applyInArrow(_priced, "lang string, a long, b long, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    every = groups.join(wide, "lang").withColumn("other", F.explode(F.expr("sequence(0L, wide - 1)")))
    a = every.select("lang", F.col("block").alias("left"), F.col("other").alias("right"), "source", F.col("idx").alias("a"), F.col("p0").alias("pa"), "v")
    b = every.select("lang", F.col("other").alias("left"), F.col("block").alias("right"), F.col("source").alias("item"), F.col("idx").alias("b"), F.col("p0").alias("pb"))
    # every other source of the language; a key has two blocks of sources
    whole = a.join(b, ["lang", "left", "right"]).where("a <> b").join(sums, ["lang", "a", "b"], "left")
    rest = F.expr("(v - coalesce(seen, 0)) * ((pa - pb) * (pa - pb) div pb)")
    return whole.select("lang", "source", "item", F.coalesce(F.coalesce("value", F.lit(0)) + rest, F.lit(0)).alias("value"))


def oracle() -> str:
    return f"""
with words as (
  select rowid_ as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         unnest(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as word
  from (select *, row_number() over () as rowid_ from documents)),
tokens as (select doc, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from words),
kept as (select lang, term, count(*) as n from tokens group by all having count(distinct doc) >= {MIN_DOCS}),
langs as (select lang, sum(n)::hugeint as total, count(*)::hugeint as v from kept group by all),
names as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
counted as (select t.lang, t.source, t.term, count(*) as n from tokens t semi join kept k on t.lang = k.lang and t.term = k.term group by all),
totals as (select lang, source, sum(n)::hugeint as total from counted group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) as p,
         1 + ({SCALE}::hugeint * (k.n + 1)) // (l.total + l.v) as q
  from names g join kept k on k.lang = g.lang join langs l on l.lang = g.lang
  left join totals t on t.lang = g.lang and t.source = g.source
  left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
  from names a join names b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as value
             from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= {TOP}"""

"""Divergence of sources within a language, by count cells.

A term's share in a group depends only on its count there, so its divergence
depends only on two counts.  Terms are therefore grouped into cells of equal
counts, the divergence is evaluated once a cell, cells of equal value merge,
and only the cells at the top of a group's ranking are expanded to terms.

Shares are integers, p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and
f = floor((p - q)^2 / (p + q)): all arithmetic is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import gaps_but, ragged, slices
from .shared import Scratch, n_parts, table

LETTERS = gaps_but((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SLICE = 4 << 20
PAIRS = 1 << 21  # pairs of counts that a task forms at once
TERM_ROWS = 400_000  # (source, term) rows of one work part


def _count_terms(batches):
    """(lang, source, term, n, df) of each run of documents."""
    for batch in batches:
        lang, source = (batch.column(c).fill_null("").dictionary_encode() for c in (0, 1))
        n_sources = len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
        for i, j, words in slices(batch.column(2), lower=True, limit=SLICE, gaps=LETTERS):
            which, code, terms = words.coded()
            n_terms = max(1, len(terms))
            held, tf = np.unique(which * n_terms + code, return_counts=True)
            key, at = np.unique(group[i:j][held // n_terms] * n_terms + held % n_terms, return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, at, tf)
            of = key // n_terms
            yield pa.RecordBatch.from_pydict({
                "lang": lang.dictionary.take(pa.array(of // n_sources)),
                "source": source.dictionary.take(pa.array(of % n_sources)),
                "term": terms.take(pa.array(key % n_terms)).cast(pa.string()),
                "n": pa.array(n), "df": pa.array(np.bincount(at, minlength=len(key)))})


def _shared_cells(block: pa.Table) -> pa.Table:
    """Of a block of terms: how many have count ``na`` in source ``a`` and
    ``nb`` in ``b`` (a < b, both above 0).  Only cells leave the task; the
    pairs of a term's sources are formed in chunks of about ``PAIRS``."""
    sources = block.column("source").combine_chunks().dictionary_encode()
    names = sources.dictionary.to_pylist()
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=lambda i: names[i].encode())] = np.arange(len(names))
    names.sort(key=str.encode)
    source = place[sources.indices.to_numpy()]
    term = block.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    n = block.column("n").to_numpy()
    order = np.lexsort((source, term))
    source, term, n = source[order], term[order], n[order]
    last = np.searchsorted(term, term, "right") - 1
    right = last - np.arange(len(term))  # partners behind each row
    found, cells = np.zeros((4, 0), np.int64), []
    cuts = np.searchsorted(np.cumsum(right), np.arange(PAIRS, int(right.sum()) + PAIRS, PAIRS))
    for a, b in zip([0, *(cuts + 1)], [*(cuts + 1), len(term)]):
        i = np.repeat(np.arange(a, min(b, len(term))), right[a:b])
        if len(i):
            j = i + 1 + ragged(right[a:b])
            cells.append(np.unique(np.stack([source[i], source[j], n[i], n[j]]), axis=1, return_counts=True))
    if cells:
        found, at = np.unique(np.concatenate([c for c, _ in cells], axis=1), axis=1, return_inverse=True)
        m = np.zeros(found.shape[1], np.int64)
        np.add.at(m, at.ravel(), np.concatenate([k for _, k in cells]))
    else:
        m = np.zeros(0, np.int64)
    names = pa.array(names, pa.string())
    lang = pa.array([block.column("lang")[0].as_py()] * len(m), pa.string())
    return pa.Table.from_arrays([lang, names.take(pa.array(found[0])), names.take(pa.array(found[1])),
                                 *map(pa.array, (found[2], found[3], m))], names=["lang", "a", "b", "na", "nb", "m"])


def _share(count: str, total: str) -> str:
    return (f"(1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) "
            f"div cast({total} + 2 * v as decimal(20,0)))")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                      least_docs: int = 10, top: int = 10) -> DataFrame:
    """For every occurring (lang, source): part ``pair``, its divergence from
    each other source of the language over all kept terms, and part ``term``,
    the ``top`` kept terms it over-uses most against the language (lang,
    source, part, item, value, rank).

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a
    language keeps those in at least ``least_docs`` of its rows.  Null lang,
    source and text count as empty strings; a group without terms is compared
    like any other (all its counts are 0); a language without kept terms has
    pairs of value 0 and no terms; each row is a document, also where rows
    repeat.  Equal values rank by item in UTF-8 order.  An empty table gives
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    counts = scratch.write(read.mapInArrow(_count_terms, "lang string, source string, term string, n long, df long")
                           .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("ln"), F.sum("df").alias("df")) \
        .where(F.col("df") >= least_docs).drop("df")
    used = scratch.write(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "used")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("ln").alias("lt"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"))
    # one row a group: v kept terms and lt occurrences in the language, d terms and t occurrences here
    groups = scratch.write(read.select("lang", "source").distinct().join(langs, "lang", "left")
                           .join(totals, ["lang", "source"], "left").fillna(0, ["v", "lt", "t", "d"]), "groups")
    cells = scratch.write(used.groupBy("lang", "source", "n", "ln").agg(F.count(F.lit(1)).alias("m")), "cells")
    return _pairs(used, groups, cells).unionByName(_terms(used, groups, cells, top))


def _terms(used: DataFrame, groups: DataFrame, cells: DataFrame, top: int) -> DataFrame:
    group = Window.partitionBy("lang", "source")
    valued = cells.join(groups, ["lang", "source"]) \
        .withColumn("p", F.expr(_share("n", "t"))).withColumn("q", F.expr(_share("ln", "lt"))) \
        .where("p > q").withColumn("value", F.expr(_f("p", "q")))
    # equal values merge; each has a term at least, so the first ``top`` values hold the first ``top`` terms
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m")) \
        .withColumn("nth", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("nth") <= top) \
        .withColumn("before", F.sum("m").over(group.orderBy(F.desc("value"))) - F.col("m")).where(F.col("before") < top) \
        .select("lang", "source", "value")
    wanted = valued.join(merged, ["lang", "source", "value"]).select("lang", "source", "n", "ln", "value")
    return used.join(wanted, ["lang", "source", "n", "ln"]) \
        .withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top) \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(used: DataFrame, groups: DataFrame, cells: DataFrame) -> DataFrame:
    """Sum over all kept terms of f(count in a, count in b), from the counts
    of each source and the cells of the terms that both hold:
    sum of f(n, 0) over a's terms and f(0, n) over b's, f(0, 0) for the rest,
    and for a shared term f(na, nb) - f(na, 0) - f(0, nb) + f(0, 0)."""
    side = {s: groups.select("lang", F.col("source").alias(s), "v", F.col("t").alias(f"t{s}"), F.col("d").alias(f"d{s}"))
            for s in "ab"}
    pairs = side["a"].join(side["b"].drop("v"), "lang").where("a < b").withColumns(
        {"za": F.when(F.col("v") > 0, F.expr(_share("0", "ta"))), "zb": F.when(F.col("v") > 0, F.expr(_share("0", "tb")))})
    own = cells.groupBy("lang", "source", "n").agg(F.sum("m").alias("m"))
    only = [pairs.join(own.withColumnRenamed("source", s), ["lang", s])
            .select("lang", "a", "b", F.expr(f"m * ({_f(_share('n', 't' + s), 'z' + o)} - {_f('za', 'zb')})").alias("x"))
            for s, o in ("ab", "ba")]
    parts = max(1, -(-used.count() // TERM_ROWS))
    both = used.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part")) \
        .groupBy("lang", "part").applyInArrow(_shared_cells, "lang string, a string, b string, na long, nb long, m long") \
        .groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m"))
    pa_, pb = _share("na", "ta"), _share("nb", "tb")
    joint = pairs.join(both, ["lang", "a", "b"]).select("lang", "a", "b", F.expr(
        f"m * ({_f(pa_, pb)} - {_f(pa_, 'zb')} - {_f('za', pb)} + {_f('za', 'zb')})").alias("x"))
    rest = pairs.select("lang", "a", "b", F.expr(f"case when v > 0 then v * {_f('za', 'zb')} else 0 end").alias("x"))
    total = only[0].unionByName(only[1]).unionByName(joint).unionByName(rest) \
        .groupBy("lang", "a", "b").agg(F.sum("x").alias("value"))
    ways = total.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value") \
        .union(total.select("lang", "b", "a", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: documents, terms in ten documents of a language and more."""
    return source_divergence(table(spark, sf_dir, "documents"))


_P = "(1 + (1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * v))"
_FSQL = "((({0}) - ({1})) * (({0}) - ({1})) // (({0}) + ({1})))"
OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
words AS (SELECT lang, source, r, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS ln FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, k.ln, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (SELECT d.*, {_P.format('n', 't')} AS p, {_P.format('ln', 'lt')} AS q
    FROM dense d JOIN langs USING (lang) JOIN (SELECT lang, source, sum(n) AS t FROM dense GROUP BY ALL) USING (lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum({_FSQL.format('x.p', 'y.p')}) AS value
               FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.s1 = a.source AND s.s2 = b.source),
terms AS (SELECT lang, source, term AS item, {_FSQL.format('p', 'q')} AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL SELECT lang, source, 'term', item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

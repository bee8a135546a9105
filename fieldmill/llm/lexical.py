"""Ranked lexical search: accumulators for short lists, skipping over long ones.

The index is a table.  Its documents are dealt into shards (each cut out of
one input partition); a row holds one term's postings in one shard, as packed
places and counts, and one more row per shard, without term, holds its
documents.  A search keeps the rows of the queries' terms, groups them by
shard and ranks every query in every shard; the best of each shard are ranked
once more.

In a shard a query's short lists are summed first, term at a time; their
accumulators are then one more list, bounded by its largest sum.  This list
and the long ones are read document at a time, in windows of places: lists
whose bounds together stay below the score of the ``k``-th best document found
so far are not read but probed by binary search, and only for documents that
can still reach that score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import gaps_but, slices
from .shared import Scratch, n_parts, table

TERMS = gaps_but((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SHARD_BYTES, SHARD_DOCS = 32 << 20, 1 << 16
QUERY_BYTES = 8 << 20  # text of the queries that are searched for together
SHORT = 1 / 16  # a list is short if it holds this share of a shard's documents at most
WINDOW = 1024
_INDEX = "shard string, term string, places binary, counts binary, named binary, n_docs long, n_terms long"


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``values`` cut at ``ends`` as one byte string each."""
    at = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(values)]) \
        .cast(pa.binary())


class _Shard:
    """Documents and postings gathered for one shard."""

    def __init__(self):
        self.ids, self.named, self.length, self.bytes = [], [], [], 0
        self.codes: dict[str, int] = {}
        self.postings = []

    def add(self, ids: pa.Array, words, n_docs: int) -> None:
        base = sum(map(len, self.ids))
        which, code, terms = words.coded()
        n_terms = max(1, len(terms))
        held, tf = np.unique(which * n_terms + code, return_counts=True)
        own = np.fromiter((self.codes.setdefault(t, len(self.codes)) for t in terms.to_pylist()), np.int32, len(terms))
        if len(held):
            self.postings.append((own[held % n_terms], (base + held // n_terms).astype(np.uint32), tf.astype(np.uint32)))
        self.ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.named.append(np.asarray(ids.is_valid()))
        self.length.append(np.bincount(which, minlength=n_docs))
        self.bytes += len(words.data)

    def rows(self, name: str) -> pa.RecordBatch:
        code, place, tf = (np.concatenate(c) for c in zip(*self.postings)) if self.postings else np.zeros((3, 0), np.uint32)
        order = np.argsort(code, kind="stable")
        terms = [None, *self.codes]
        ends = np.cumsum(np.bincount(code, minlength=len(self.codes))) if len(self.codes) else np.zeros(0, np.int64)
        length = np.concatenate(self.length).astype(np.int64)
        n = len(terms)
        pack = lambda first, rest: pa.concat_arrays([pa.array([first.tobytes()], pa.binary()), _packed(rest[order], ends)])
        only_first = lambda v: pa.array([v] + [None] * (n - 1), pa.int64())
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([name] * n), "term": pa.array(terms, pa.string()),
            "places": pack(np.concatenate(self.ids), place.astype(np.uint32)),
            "counts": pack(length, tf.astype(np.uint32)),
            "named": pa.array([np.concatenate(self.named).tobytes()] + [None] * (n - 1), pa.binary()),
            "n_docs": only_first(int((length > 0).sum())), "n_terms": only_first(int(length.sum()))})


def _index_rows(shard_bytes: int, shard_docs: int):
    def run(batches):
        shard, done = _Shard(), 0
        for batch in batches:
            for i, j, words in slices(batch.column(1), lower=True, limit=min(4 << 20, shard_bytes), gaps=TERMS):
                shard.add(batch.column(0).slice(i, j - i), words, j - i)
                if shard.bytes >= shard_bytes or sum(map(len, shard.ids)) >= shard_docs:
                    yield shard.rows(f"{TaskContext.get().partitionId()}-{done}")
                    shard, done = _Shard(), done + 1
        if shard.ids:
            yield shard.rows(f"{TaskContext.get().partitionId()}-{done}")
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
                shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of all rows and all their terms, written below the shared
    checkpoint folder: one row per (shard, term) and one per shard.

    Terms are runs of digits, letters and non-ASCII characters, A-Z
    lower-cased.  Null and empty texts have no terms; every row is a document
    of its own, also where ids repeat or are null.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "lexical-index")
    return scratch.write(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                         .mapInArrow(_index_rows(shard_bytes, shard_docs), _INDEX), "index")


def _count_query_terms(batches):
    for batch in batches:
        for i, j, words in slices(batch.column(1), lower=True, gaps=TERMS):
            which, code, terms = words.coded()
            n_terms = max(1, len(terms))
            held, tf = np.unique(which * n_terms + code, return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "item": batch.column(0).slice(i, j - i).take(pa.array(held // n_terms)),
                "term": terms.take(pa.array(held % n_terms)).cast(pa.string()), "n": pa.array(tf.astype(np.int64))})


def _lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 75 + (75 n N) div L, exact beyond 64 bits too."""
    if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
        n = n.astype(object)
    return (25 + 75 * n * n_docs // n_terms).astype(np.int64)


class _Best:
    """The ``k`` best (score, order) so far; ``least`` is the score below
    which a document can no longer enter."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.order, self.place = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, score: np.ndarray, order: np.ndarray, place: np.ndarray) -> None:
        score, order, place = (np.concatenate(p) for p in ((self.score, score), (self.order, order), (self.place, place)))
        first = np.lexsort((order, -score))[:self.k]
        self.score, self.order, self.place = score[first], order[first], place[first]
        if len(first) == self.k:
            self.least = max(1, int(self.score[-1]))


def rank_shard(lists: list, n_docs: int, order: np.ndarray, k: int, short: float, window: int) -> _Best:
    """Best documents of one query.  ``lists``: (places ascending, scores,
    window cuts) per term; ``order``: rank of each place among equal scores."""
    best = _Best(k)
    few = [x for x in lists if len(x[0]) <= short * n_docs]
    many = [x for x in lists if len(x[0]) > short * n_docs]
    if few:  # term at a time
        place = np.concatenate([x[0] for x in few])
        by = np.argsort(place, kind="stable")
        place, score = place[by], np.concatenate([x[1] for x in few])[by]
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        place, score = place[new], np.add.reduceat(score, new)
        many.append((place, score, np.searchsorted(place, np.arange(0, n_docs + window, window))))
    bound = np.array([int(x[1].max()) for x in many], np.int64)
    by = np.argsort(bound, kind="stable")
    many, reach = [many[i] for i in by], np.cumsum(bound[by])
    for w in range(-(-n_docs // window)):  # document at a time
        probed = int(np.searchsorted(reach, best.least))  # lists that cannot reach the score together
        if probed == len(many):
            break
        total, base = np.zeros(window, np.int64), w * window
        for place, score, cuts in many[probed:]:
            a, b = cuts[w], cuts[w + 1]
            total[place[a:b] - base] += score[a:b]
        found = np.flatnonzero(total)
        total = total[found]
        for t in range(probed - 1, -1, -1):
            able = total + reach[t] >= best.least
            found, total = found[able], total[able]
            if not len(found):
                break
            place, score, cuts = many[t]
            a, b = cuts[w], cuts[w + 1]
            if a < b:
                at = np.minimum(np.searchsorted(place[a:b], found + base), b - a - 1) + a
                total = total + np.where(place[at] == found + base, score[at], 0)
        able = total >= best.least
        if able.any():
            place = found[able] + base
            best.offer(total[able], order[place], place)
    return best


def _search(queries: list, weight: dict, n_docs: int, n_terms: int, k: int, short: float, window: int):
    """Of one shard: the ``k`` best documents of each query (a list of
    (item, {term: occurrences}))."""
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        terms = block.column("term").to_pylist()
        top = terms.index(None)
        ids, length = (np.frombuffer(block.column(c)[top].as_py(), np.int64) for c in ("places", "counts"))
        named = np.frombuffer(block.column("named")[top].as_py(), bool)
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((ids, ~named))] = np.arange(len(ids))
        m, edges, lists = _lengths(length, n_docs, n_terms), np.arange(0, len(ids) + window, window), {}
        for i, term in enumerate(terms):
            if term is not None and weight[term]:
                place, tf = (np.frombuffer(block.column(c)[i].as_py(), np.uint32).astype(np.int64) for c in ("places", "counts"))
                lists[term] = (place, weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[place])),
                               np.searchsorted(place, edges))
        out = []
        for item, counts in queries:
            own = [lists[t] if n == 1 else (lists[t][0], n * lists[t][1], lists[t][2]) for t, n in counts.items() if t in lists]
            if own:
                best = rank_shard(own, len(ids), order, k, short, window)
                out.append((np.full(len(best.score), item), best.score, ids[best.place], named[best.place]))
        item, score, doc, named = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return pa.Table.from_arrays([pa.array(item.astype(np.int64)), pa.array(score.astype(np.int64)),
                                     pa.array(doc.astype(np.int64), mask=~named.astype(bool))], names=["item", "score", "doc_id"])
    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text",
           query_bytes: int = QUERY_BYTES, short: float = SHORT, window: int = WINDOW) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score
    above 0 for every item, equal scores by ascending id, null ids last.

    Rows that repeat an item id (null is one too) are one query, whose terms
    count as often as they occur in all of them; items without known terms
    give no rows.  Items are searched for in blocks of about ``query_bytes`` of
    text, so what the driver and a task hold of them is bounded; a block reads
    only the postings of its terms.  An empty index or no items give no rows.
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "lexical-search")
    items = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks = n_parts(size, query_bytes, least=1)
    asked = scratch.write(items.mapInArrow(_count_query_terms, "item long, term string, n long").groupBy("item", "term")
                          .agg(F.sum("n").alias("n"))
                          .withColumn("block", F.pmod(F.coalesce(F.xxhash64("item"), F.lit(0)), F.lit(blocks))), "queries")
    sums = index.where("term is null").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t")).first()
    found = spark.createDataFrame([], "item long, score long, doc_id long")
    for b in range(blocks if sums.t else 0):
        by_item: dict[int | None, dict[str, int]] = {}
        for r in asked.where(F.col("block") == b).collect():  # at most about query_bytes of terms
            by_item.setdefault(r.item, {})[r.term] = r.n
        terms = spark.createDataFrame([(t,) for t in {t for q in by_item.values() for t in q}], "term string")
        own = index.join(F.broadcast(terms), "term", "left_semi")
        df = own.groupBy("term").agg(F.sum(F.octet_length("places") / 4).cast("long").alias("df")).collect()
        weight = {r.term: math.floor(1000 * math.log((2 * sums.n + 2) / (2 * r.df + 1))) for r in df}
        names = list(by_item)
        numbered = [(i, {t: n for t, n in by_item[name].items() if t in weight}) for i, name in enumerate(names)]
        own = own.unionByName(index.where("term is null")).groupBy("shard").applyInArrow(
            _search(numbered, weight, sums.n, sums.t, k, short, window), "item long, score long, doc_id long")
        back = spark.createDataFrame(list(enumerate(names)), "number long, id long")
        part = own.join(F.broadcast(back), F.col("item") == F.col("number")).select(F.col("id").alias("item"), "score", "doc_id")
        found = found.union(scratch.write(part, f"block-{b}") if blocks > 1 else part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents for every benchmark item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERM_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERM_SQL} AS terms FROM documents),
sums AS (SELECT count(*)::BIGINT AS nn, sum(len(terms))::BIGINT AS ll FROM docs WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, sums GROUP BY term, nn),
asked AS (SELECT item_id, unnest({_TERM_SQL}) AS term FROM benchmark),
queries AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
scored AS (SELECT q.item_id, d.doc_id, tf.r, sum(q.times * w * ((1000000000 * tf.tf)
        // (1000 * tf.tf + 8 * (25 + (75 * len(d.terms) * nn) // ll))))::BIGINT AS score
    FROM queries q JOIN tf USING (term) JOIN weights USING (term) JOIN docs d ON d.r = tf.r, sums GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""

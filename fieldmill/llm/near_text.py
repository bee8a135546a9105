"""Near-duplicate documents by b-bit MinHash.

One pass turns every whole text into the hash set of its word shingles, 96
minima of that set, 24 band keys of four minima each, and a packed signature
that keeps only the low 8 bits of every minimum.  Documents that share a band
key are candidates; bit counts of the packed signatures give a similarity
estimate corrected for chance agreement, which drops clearly distant
candidates (five standard deviations below the threshold); the rest is decided
on the full shingle sets.

Groups of copies never become pairs: equal sets are one class first, then each
band bucket is compared with its most central member (the one with the most
bucket mates over all bands), which settles nearly every bucket.  Only buckets
that still hold several components are scanned in full, in blocks of at most
``BLOCK`` x ``BLOCK`` members, each pair in the first band it shares, and give
back spanning links instead of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, slices, windows
from .components import components_of, connected
from .shared import Scratch, table

MINIMA, ROWS, BITS = 96, 4, 8
BANDS = MINIMA // ROWS
BLOCK = 1000

_G = np.random.Generator(np.random.PCG64(2024))
_MUL = _G.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
_ADD = _G.integers(0, 2**32, MINIMA, dtype=np.uint32)
_BAND_SALT = _G.integers(0, 2**64, (BANDS, 1), dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int):
    """Sorted distinct shingle hashes of each document of a column."""
    for i, j, words in slices(column, lower=True):
        h = words.hashes()
        every = windows(h, k)
        for d in range(j - i):
            a, b = words.doc[d], words.doc[d + 1]
            if b - a >= k:
                yield np.unique(every[a:b - k + 1])
            elif b > a:
                yield windows(h[a:b], int(b - a), salt=0xC2B2AE3D27D4EB4F)
            else:
                yield h[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        v = np.multiply.outer(low[i:i + 512], _MUL)
        v += _ADD
        np.minimum(best, v.min(axis=0), out=best)
    return best


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            ids, n, digest, sig, bands = batch.column(0), [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                m = minima(s)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(m.astype(np.uint8).tobytes())
                quads = m.reshape(BANDS, ROWS).astype(np.uint64)
                bands.append(mix(mix(quads[:, :1] << np.uint64(32) | quads[:, 1:2])
                                 ^ (quads[:, 2:3] << np.uint64(32) | quads[:, 3:4]) + _BAND_SALT)
                             .view(np.int64).ravel())
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            keys = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), keys],
                names=["id", "n", "digest", "sig", "bands"])
    return run


def _set_rows(k: int):
    def run(batches):
        for batch in batches:
            raw = [s.tobytes() for s in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(xxhash.xxh3_128_digest, raw), pa.binary()), pa.array(raw, pa.binary())],
                names=["id", "digest", "shingles"])
    return run


def _cut(percent: int) -> float:
    j = percent / 100
    return j - 5 * (j * (1 - j) / MINIMA) ** 0.5


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal b-bit minima, less chance equality."""
    chance = 2.0 ** -BITS
    return (equal / MINIMA - chance) / (1 - chance)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each element of ``b``, whether the sorted set ``a`` holds it."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return a[at] == b


def _column_sets(col: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in col]


def _sig_matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), MINIMA)


def _confirm(percent: int):
    """Rows (a, b, set of a, set of b) -> the linked (a, b)."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_column_sets(batch.column(2)), _column_sets(batch.column(3))):
                both = int(_common(x, y).sum()) if len(x) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])
    return run


def _scan(percent: int):
    """One block of a bucket: the links that join different components."""
    cut = _cut(percent)

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        ids = block.column("id").to_numpy()
        comp = block.column("component").to_numpy()
        own, ci, cj = (block.column(c).to_numpy() for c in ("chunk", "ci", "cj"))
        key = block.column("key")[0].as_py()
        sig = _sig_matrix(block.column("sig").combine_chunks())
        bands = np.array(block.column("bands").to_pylist(), np.int64).reshape(len(ids), BANDS)
        here = int(np.flatnonzero(bands[0] == key)[0])
        sets = _column_sets(block.column("shingles").combine_chunks())
        size = np.array([len(s) for s in sets])
        names, root = np.unique(comp, return_inverse=True)  # components, merged as links are found
        out_a, out_b = [], []
        order = np.argsort(ids, kind="stable")
        same = ci[0] == cj[0]
        for p, i in enumerate(order):
            if not same and own[i] != ci[0]:
                continue
            js = order[p + 1:] if same else np.flatnonzero(own == cj[0])
            js = js[root[js] != root[i]]
            js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
            js = js[(bands[js, :here] != bands[i, :here]).all(axis=1)]
            js = js[estimate((sig[js] == sig[i]).sum(axis=1)) >= cut]
            if not len(js):
                continue
            hit = _common(sets[i], np.concatenate([sets[j] for j in js]))
            both = np.add.reduceat(hit, np.cumsum(size[js]) - size[js], dtype=np.int64)
            for j in js[100 * both >= percent * (size[js] + size[i] - both)]:
                if root[j] != root[i]:
                    out_a.append(ids[i])
                    out_b.append(ids[j])
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; two documents link
    if their shingle sets have 100 * common >= percent * union.
    component_id is the smallest id reachable over links, itself included.
    Null and empty texts have no shingles and link with nothing; fewer words
    than ``shingle`` make one shingle of them all; a repeated id is one
    document, each of its rows is returned and each of its texts can link it
    (equal sets always link); a null id links with
    nothing, has a null component and is kept; an empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-text")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = scratch.write(texts.mapInArrow(
        _signatures(shingle), "id long, n long, digest binary, sig binary, bands array<long>"), "signatures")
    usable = sigs.where("digest is not null and id is not null")
    # a class: the rows of equal sets; numbered once, since several may share their smallest id.
    # From here to the components, ids are those numbers
    classes = scratch.write(usable.groupBy("digest").agg(F.min("id").alias("class"))
                            .withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = sigs.withColumnRenamed("id", "class").join(classes, ["class", "digest"]) \
        .select(F.col("node").alias("id"), "class", "digest", "sig", "bands").dropDuplicates(["id"])
    reps = scratch.write(reps, "representatives")

    keyed = reps.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.write(keyed.join(shared, "key").distinct(), "members")
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    pivots = members.join(weight, "id").groupBy("key") \
        .agg(F.max(F.struct("weight", -F.col("id"))).alias("top")) \
        .select("key", (-F.col("top.col2")).alias("pivot"))
    stars = scratch.write(members.join(pivots, "key").where("id <> pivot")
                          .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
                          .distinct(), "stars")

    # the full sets of every document that shares a bucket, computed once
    wanted = reps.select("id", "class", "digest").join(members.select("id").distinct(), "id", "left_semi")
    sets = texts.join(wanted.select(F.col("class").alias("id")).distinct(), "id", "left_semi").mapInArrow(
        _set_rows(shingle), "id long, digest binary, shingles binary")
    sets = scratch.write(sets.withColumnRenamed("id", "class").join(wanted, ["class", "digest"])
                         .dropDuplicates(["id"]).select("id", "shingles"), "sets")
    links = _links_of_stars(stars, reps, sets, percent)
    links = scratch.write(links, "star-links")
    scratch.drop(stars)

    # what the stars left open: buckets with members of several components
    first = connected(links)
    placed = members.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("key")
    blocks = placed.join(mixed, "key") \
        .withColumn("n_chunks", F.ceil(F.col("size") / BLOCK)) \
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("n_chunks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1))) \
        .select("key", "id", "component", "chunk", F.least("chunk", "other").alias("ci"),
                F.greatest("chunk", "other").alias("cj"))
    blocks = blocks.join(reps.drop("digest", "class"), "id").join(sets, "id")
    more = scratch.write(blocks.groupBy("key", "ci", "cj").applyInArrow(_scan(percent), "a long, b long"),
                         "block-links")
    component = components_of(scratch, usable, classes, links.union(more))
    scratch.drop(members, sets, reps)

    rows = sigs.select(F.col("id"), F.col("n"), F.col("digest")) \
        .join(classes.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left") \
        .select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class"),
                F.when(F.col("id").isNotNull(), F.col("node")).alias("node")) \
        .join(component, F.col("node") == F.col("c"), "left") \
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                F.coalesce("component", "class").alias("component_id"))
    return rows.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _links_of_stars(stars: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stars whose estimate passes, confirmed on the full sets."""
    chance = 2.0 ** -BITS
    least = int(np.ceil(MINIMA * (_cut(percent) * (1 - chance) + chance)))
    sig = reps.select("id", "sig")
    near = stars.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a") \
        .join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b") \
        .select("a", "b", "sa", "sb").mapInArrow(_estimated(least), "a long, b long")
    side = sets.select("id", "shingles")
    return near.join(side.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a") \
        .join(side.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b") \
        .select("a", "b", "xa", "xb").mapInArrow(_confirm(percent), "a long, b long")


def _estimated(least: int):
    def run(batches):
        for batch in batches:
            if not len(batch.column(0)):
                continue
            equal = (_sig_matrix(batch.column(2)) == _sig_matrix(batch.column(3))).sum(axis=1)
            keep = pa.array(equal >= least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])
    return run


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: 2-word shingles over all documents, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)

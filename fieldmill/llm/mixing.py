"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash.  A source that may give only part of
its words takes the documents below a hash threshold.  To find it, words are
summed by source and hash bucket (the top 10 bits), the bucket in which the
source's budget runs out is split by the next 10 bits, and so on: only the
documents of boundary buckets are looked at again, nothing is sorted, and the
thresholds are nested (a larger budget takes a superset).  Rows of one id and
text have one hash; where the budget runs out among them, they are numbered
and as many are taken as come nearest to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
STEP, LEVELS = 10, 6  # 60 hash bits
SMALL_TABLE = 100_000  # sources that may be broadcast, about 10 MB


def _ranked(scratch: Scratch, sources: DataFrame) -> DataFrame:
    """0-based rank of each source by code point, null last: range-sorted parts
    and their sizes, no single-task window."""
    tagged = scratch.write(
        sources.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources")
    sizes = {r.part: r["count"] for r in tagged.groupBy("part").count().collect()}  # at most 8 rows
    before = F.lit(0).cast("long")
    for p in sizes:
        before = F.when(F.col("part") == p, sum(n for q, n in sizes.items() if q < p)).otherwise(before)
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return tagged.withColumn("rank", before + F.row_number().over(inside) - 1).drop("part")


def targets(scratch: Scratch, sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: ``share`` of all words dealt by weight; no
    target exceeds ``most`` times its source, the excess goes to the others."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(scratch, sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words per unit of weight of the sources that are not full
    while True:  # one small aggregation per round; each round fills a source or ends
        full = F.col("weight") * F.lit(level) > F.col("cap")
        held, open_weight = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
                                       F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        after = (budget - (held or 0.0)) / open_weight
        if after <= level:
            break
        level = after
    return ranked.select("source", "source_size",
                         F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def _maybe_small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL_TABLE else df


def plan(scratch: Scratch, sized: DataFrame, weights, share, most) -> tuple[DataFrame, int, bool]:
    """Per source: source_size, target, passes (whole takes of every document),
    below (hash threshold of one more take), tied (rows of the hash ``below``
    that are taken besides, null without such); the number of sources, and
    whether any has tied rows.  ``sized``: source, size, u."""
    goal = targets(scratch, sized, weights, share, most)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(0).cast("long")) \
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    goal = scratch.write(goal, "targets")
    n = goal.count()
    # boundary: per source the hash prefix in which the rest runs out
    edge = goal.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), "rest")
    for level in range(1, LEVELS + 1):
        bits = STEP * (LEVELS - level)
        inside = sized.join(_maybe_small(edge, n), F.col("source").eqNullSafe(F.col("s"))
                            & (F.shiftright("u", bits + STEP) == F.col("prefix")))
        histogram = inside.groupBy("s", "rest", F.shiftright("u", bits).alias("bucket")) \
            .agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        order = Window.partitionBy("s").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("words").over(order))
        over = histogram.where("upto > rest").groupBy("s").agg(F.min_by(
            F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"), "words", "docs"),
            "bucket").alias("at"))
        edge = scratch.write(over.select("s", F.col("at.bucket").alias("prefix"), F.col("at.left").alias("rest"),
                                         F.col("at.words").alias("words"), F.col("at.docs").alias("docs")), "edge")
        most_docs = edge.agg(F.max("docs")).first()[0] or 0
        if most_docs <= 1:
            break
    # one document in the last bucket goes to the nearer side, of equal hashes as many as come nearest
    nearer = F.when(F.col("rest") * 2 >= F.col("words"), 1).otherwise(0).cast("long")
    several = F.col("docs") > 1
    edge = edge.select("s", F.when(several, F.col("prefix")).otherwise(F.shiftleft(F.col("prefix") + nearer, bits))
                       .alias("below"),
                       F.when(several, F.floor(F.col("rest") * F.col("docs") / F.col("words") + 0.5)).alias("tied"))
    out = goal.join(_maybe_small(edge, n), F.col("source").eqNullSafe(F.col("s")), "left")
    return scratch.write(out.select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), F.col("passes").alias("mix_passes"),
        # no boundary: the rest is at least what one more pass holds (or zero)
        F.coalesce("below", F.when(F.col("rest") > 0, 1 << (STEP * LEVELS)).otherwise(0)).cast("long")
        .alias("mix_below"), F.col("tied").alias("mix_tied")), "plan"), n, most_docs > 1


def _numbered(scratch: Scratch, tied: DataFrame) -> DataFrame:
    """``tied`` with mix_no, 0-based within mix_source.  The rows are written
    once with their scan part; a part's rows are numbered by themselves, after
    the counts of the parts before it, so that a source of any size is spread."""
    tied = scratch.write(tied.withColumn("mix_part", F.spark_partition_id())
                         .withColumn("mix_row", F.monotonically_increasing_id()), "tied")
    counts = tied.groupBy("mix_source", "mix_part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("mix_source").orderBy("mix_part")) - F.col("rows")
    counts = scratch.write(counts.select(F.col("mix_source").alias("mix_s"), F.col("mix_part").alias("mix_p"),
                                         before.alias("mix_before")), "tied_counts")
    inside = F.row_number().over(Window.partitionBy("mix_source", "mix_part").orderBy("mix_row"))
    return tied.withColumn("mix_no", inside - 1) \
        .join(_maybe_small(counts, counts.count()),
              F.col("mix_source").eqNullSafe(F.col("mix_s")) & (F.col("mix_part") == F.col("mix_p"))) \
        .withColumn("mix_no", F.col("mix_no") + F.col("mix_before")) \
        .drop("mix_s", "mix_p", "mix_before", "mix_part", "mix_row")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with mix_size (words of the text), mix_source, mix_source_size,
    mix_target, mix_passes, mix_below and mix_takes (how often the mix takes
    the document: at most ``most`` times, a whole number).

    Sources by code point, null last, weigh ``weights`` in turn.  A document's
    hash is of its id and text, so null and repeated ids are spread.  Rows that
    repeat both are taken together, but where the target falls among them: of
    those the first in file order are taken.  Null and empty texts have size 0; a
    source of size 0 has target 0; an empty table gives no rows.  Columns of
    ``docs`` keep their names; those that begin with ``mix_`` are refused.
    """
    if clash := [c for c in docs.columns if c.lower().startswith("mix_")]:
        raise ValueError(f"columns {clash} would be overwritten")
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 64 - STEP * LEVELS)
    sized = scratch.write(docs.select(F.col(source_col).cast("string").alias("source"), size.alias("size"), u.alias("u")),
                          "sized")
    takes, n, ties = plan(scratch, sized, weights, share, most)
    out = docs.withColumn("mix_size", size).withColumn("mix_u", u).withColumn("mix_key", F.col(source_col).cast("string"))
    out = out.join(_maybe_small(takes, n), F.col("mix_key").eqNullSafe(F.col("mix_source"))) \
        .withColumn("mix_takes", F.col("mix_passes") + (F.col("mix_u") < F.col("mix_below")).cast("long"))
    if ties:
        tied = F.col("mix_tied").isNotNull() & (F.col("mix_u") == F.col("mix_below"))
        some = _numbered(scratch, out.where(tied)) \
            .withColumn("mix_takes", F.col("mix_takes") + (F.col("mix_no") < F.col("mix_tied")).cast("long"))
        out = out.where(~tied).unionByName(some.drop("mix_no"))
    return out.drop("mix_u", "mix_key", "mix_tied")


def op7_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents, 150 % of all words, at most twice a source."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_takes")).alias("taken"))

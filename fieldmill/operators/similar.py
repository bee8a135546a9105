"""Payer names by two more similarities: a weighted one and matching blocks.

``weighted`` is the best of several views of two lower-cased names whose words
are separated by one space.  The basic ratio is 2 * LCS / (sum of lengths).

* names of similar length (the longer is under 1.5 times the shorter): the
  ratio, 0.95 times the ratio of the names with sorted words, and, where they
  share words, 0.95 times the best ratio among shared words, shared words plus
  the rest of one name, and shared words plus the rest of the other;
* other names: the ratio, and, weighted 0.9 (0.6 from 8 times the length on),
  the best ratio of the shorter with any stretch of the longer that is no
  longer than it, and 0.95 times the same for sorted words, which is 1 where
  a word is shared.

``blocks`` is the standard library's ratio of recursively matched longest
blocks, on the names as they are.

No pair is scored that cannot reach the cutoff.  Pairs meet by length (an
equi-join on the lengths that can reach it, or on a shared word); then the
characters that two names have in common, counted with repeats, bound LCS and
blocks alike.  They are counted on bits, a few instructions a pair.  What is
left is scored in Arrow batches.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions.text import WS, col_of, is_blank, qcol, utrim
from fieldmill.operators.joins import BROADCAST_MAX_ROWS, is_broadcastable, lookup_join
from fieldmill.operators.lookups import _exact_payer, payer_by_name, payer_names
from fieldmill.session import stable

# Weights of the views and the length ratios at which they change.
WORDS, PART, SMALL_PART, LONGER, FAR_LONGER = 0.95, 0.9, 0.6, 1.5, 8.0
_EPS = 1e-9
# Bits of a text's characters: 96 codes by 4 repeats, in words of 64.  Others share these bits.
CODES, REPEATS, BITS = 96, 4, 64
MASKS = CODES * REPEATS // BITS


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def _stretch(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter with a stretch of the longer (0 if that is
    not above ``least``)."""
    a, b = sorted((a, b), key=len)
    if a in b:
        return 1.0
    n, best = len(a), least
    for i in range(1 - n, len(b)):
        part = b[max(0, i):i + n]
        if 2 * min(n, len(part)) > best * (n + len(part)):
            best = max(best, _ratio(a, part))
    return best if best > least else 0.0


def _most(la: int, lb: int, common: int, shared: bool) -> float:
    """Bound of ``weighted`` from the lengths, the characters in common and
    whether a word is shared."""
    short, longer = sorted((la, lb))
    whole = 2 * common / (la + lb) if longer else 1.0
    if longer < LONGER * short:
        return max(whole, WORDS) if shared else whole
    scale = PART if longer < FAR_LONGER * short else SMALL_PART
    part = 1.0 if common >= short else 2 * common / (short + common)
    return max(whole, scale * part, WORDS * scale if shared else 0.0)


def weighted(a: str, b: str, least: float = 0.0) -> float:
    """The weighted similarity of two names (see module doc), exact where it
    is at least ``least``: views that cannot matter are not computed."""
    wa, wb = a.lower().split(), b.lower().split()
    a, b = " ".join(wa), " ".join(wb)
    if not a or not b:
        return float(a == b)
    shared = sorted(set(wa) & set(wb))
    short, longer = sorted((len(a), len(b)))
    if longer < LONGER * short:
        best = _ratio(a, b)
        if best < WORDS:
            best = max(best, WORDS * _ratio(" ".join(sorted(wa)), " ".join(sorted(wb))))
        if shared and best < WORDS:
            rest = [" ".join(sorted(set(w).difference(shared))) for w in (wa, wb)]
            n, (p, q) = len(" ".join(shared)), (len(r) + bool(r) for r in rest)
            both = (n + _common(*rest) + (p > 0 and q > 0)) / (2 * n + p + q) * 2  # all begin with the shared words
            best = max(best, WORDS * max(both, 2 * n / (2 * n + min(p, q))))
        return best
    scale = PART if longer < FAR_LONGER * short else SMALL_PART
    best = WORDS * scale if shared else 0.0
    if scale <= max(best, least - _EPS) >= 2 * short / (short + longer):
        return best
    common = _common(a, b)
    best = max(best, 2 * common / (short + longer))
    # a stretch has no more in common than the whole text
    if scale * 2 * common / (short + common) > (need := max(best, least - _EPS)) - _EPS:
        best = max(best, scale * _stretch(a, b, need / scale))
    if not shared and WORDS * scale > (need := max(best, least - _EPS)):
        x, y = " ".join(sorted(wa)), " ".join(sorted(wb))
        # of words sorted already it is the view above, weighted less
        if (x, y) != (a, b) and WORDS * scale * 2 * (common := _common(x, y)) / (short + common) > need - _EPS:
            best = max(best, WORDS * scale * _stretch(x, y, need / (WORDS * scale)))
    return best


def blocks(a: str, b: str, least: float = 0.0) -> float:
    """The standard library's ratio, with the dictionary's name first."""
    return difflib.SequenceMatcher(None, b, a).ratio()


SCORERS = {"weighted": weighted, "blocks": blocks}


def _characters(text: Column) -> Column:
    """Each character with its number among its like: sets that meet in as
    many elements as the texts have characters in common."""
    def numbered(i):
        upto = F.substring(text, F.lit(1), i)
        ch = F.substring(text, i, F.lit(1))
        return F.concat(ch, (F.length(upto) - F.length(F.replace(upto, ch, F.lit("")))).cast("string"))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), numbered)) \
        .otherwise(F.array().cast("array<string>"))


def _masked(df: DataFrame, p: str) -> DataFrame:
    """``_m<i><p>``: the numbered characters of ``_t<p>`` as bits; ``_x<p>``:
    how many of them found their bit taken."""
    def at(x):
        code, nth = F.ascii(F.substring(x, 1, 1)), F.substring(x, 2, 9).cast("int")
        return F.pmod(code - 32, F.lit(CODES)) + F.pmod(nth - 1, F.lit(REPEATS)) * CODES

    def word(i):
        here = F.filter("_at", lambda b: F.floor(b / BITS) == i)
        return F.aggregate(here, F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), b % BITS)))
    df = df.withColumn("_at", F.array_distinct(F.transform(_characters(F.col(f"_t{p}")), at)))
    return df.withColumns({f"_m{i}{p}": word(i) for i in range(MASKS)}
                          | {f"_x{p}": F.col(f"_l{p}") - F.size("_at")}).drop("_at")


def _most_common() -> Column:
    """Bound of the characters in common, from both texts' bits: the common
    ones among those that found their bit taken are no more than either has."""
    both = [F.bit_count(F.col(f"_m{i}q").bitwiseAND(F.col(f"_m{i}n"))) for i in range(MASKS)]
    return sum(both[1:], both[0]) + F.least("_xq", "_xn")


def _needs(cutoff: float, scorer: str, la: Column, lb: Column) -> Column:
    """Least common characters of two texts at or above ``cutoff``."""
    whole = (la + lb) * (cutoff / 2)
    if scorer == "blocks":
        return whole
    short, longer = F.least(la, lb), F.greatest(la, lb)

    def part(scale):  # 2 x / (short + stretch) with x <= stretch
        c = cutoff / scale
        return F.least(whole, short * (c / (2 - c))) if c <= 1 else whole
    return F.when(longer < short * LONGER, whole).when(longer < short * FAR_LONGER, part(PART)).otherwise(part(SMALL_PART))


def close_pairs(queries: DataFrame, names: DataFrame, cutoff: float, scorer: str = "weighted",
                max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """(query, line, name) rows that hold every pair at or above ``cutoff``,
    with both lengths and a bound of the characters in common.  ``queries`` has
    ``_q``, ``names`` has line and name (distinct)."""
    def form(c: Column) -> Column:
        words = F.filter(F.split(F.lower(c), WS + "+"), lambda w: w != "")
        return F.array_join(words, " ") if scorer == "weighted" else c

    def described(df: DataFrame, text: str, p: str) -> DataFrame:
        df = df.withColumn(f"_t{p}", form(qcol(text))).withColumn(f"_l{p}", F.length(f"_t{p}"))
        df = _masked(df, p)
        return df.withColumn(f"_w{p}", F.array_distinct(F.split(f"_t{p}", " "))) if scorer == "weighted" else df

    # both are read more than once, and no pushed-down filter shall describe them again
    q, n = stable(described(queries, "_q", "q")), stable(described(names, "name", "n"))
    held = F.broadcast if is_broadcastable(n, max_rows) else (lambda d: d)
    lengths = n.groupBy(F.lit(0).alias("_one")).agg(F.collect_set("_ln").alias("_ls"))  # one row

    def reach(x):  # a name of this length can have enough characters in common
        return F.least(F.col("_lq"), x) + _EPS >= _needs(cutoff, scorer, F.col("_lq"), x)
    keyed = q.withColumn("_one", F.lit(0)).join(F.broadcast(lengths), "_one") \
        .withColumn("_ln", F.explode(F.filter("_ls", reach))).drop("_ls", "_one") \
        .withColumn("_least", _needs(cutoff, scorer, F.col("_lq"), F.col("_ln")))
    columns = ["_q", F.col("line").cast("long").alias("line"), "name", "_lq", "_ln",
               F.least("_lq", "_ln", _most_common()).alias("_o")]
    pairs = keyed.join(held(n.drop("_wn") if scorer == "weighted" else n), "_ln") \
        .where(_most_common() + _EPS >= F.col("_least")).select(*columns)
    if scorer == "blocks":
        return pairs
    # a shared word may reach the cutoff at any length; a pair is taken at its first one
    met = _most_common() + _EPS >= _needs(cutoff, scorer, F.col("_lq"), F.col("_ln"))
    words = q.withColumn("_w", F.explode("_wq")).join(held(n.withColumn("_w", F.explode("_wn"))), "_w") \
        .where(~(reach(F.col("_ln")) & met) & (F.element_at(F.array_intersect("_wq", "_wn"), 1) == F.col("_w")))
    return pairs.union(words.select(*columns))


def best_pairs(pairs: DataFrame, cutoff: float, scorer: str) -> DataFrame:
    """``pairs`` with score ``_s``: of every query at least those of its best
    score, if that is at or above ``cutoff``.  A task scores its pairs in the
    order of their bounds and leaves out what cannot reach the best that it
    has found for the query."""
    score = SCORERS[scorer]

    def run(batches):
        best: dict[str, float] = {}
        for batch in batches:
            q, names, la, lb, common = (batch.column(c).to_pylist() for c in ("_q", "name", "_lq", "_ln", "_o"))
            if scorer == "weighted":
                words = {x: set(x.lower().split()) for x in {*q, *names}}
                most = [_most(a, b, c, not words[x].isdisjoint(words[y])) for x, y, a, b, c in zip(q, names, la, lb, common)]
            else:
                most = [2 * c / (a + b) if a + b else 1.0 for a, b, c in zip(la, lb, common)]
            kept, values = [], []
            for i in sorted(range(len(q)), key=most.__getitem__, reverse=True):
                least = max(cutoff, best.get(q[i], 0.0))
                if most[i] + _EPS >= least and (value := score(q[i], names[i], least)) >= least:
                    best[q[i]] = value
                    kept.append(i)
                    values.append(value)
            out = batch.select(["_q", "line", "name"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(values, pa.float64())], names=["_q", "line", "name", "_s"])

    return pairs.mapInArrow(run, "_q string, line long, name string, _s double")


def match_payer_similar(df: DataFrame, name, dim: DataFrame, cutoff: float = 0.6, scorer: str = "weighted",
                        prefix: str = "match", max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Exact case-insensitive hit (score 1.0), else the best payer name at or
    above ``cutoff`` by ``scorer``, else nulls and 0.0.

    ``weighted``: ties go to the earliest line.  ``blocks``: ties go to the
    greatest name, and the cutoff is reported as the score.  Only distinct
    unmatched names are scored; any cutoff gives what comparing all pairs
    would.  Null and blank names match nothing; an empty dictionary matches
    nothing.
    """
    dim = stable(dim.select("line", "ik", "name"))
    by_name = stable(payer_by_name(dim))
    exact = _exact_payer(df, name, by_name, prefix, max_rows)
    qkey = utrim(col_of(name))
    queries = stable(exact.where(F.col(f"{prefix}_ik").isNull() & ~is_blank(name)).select(qkey.alias("_q")).distinct())
    # few names, many pairs each: spread over all tasks, a query's pairs in one
    queries = queries.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_q")
    scored = best_pairs(close_pairs(queries, payer_names(dim).select("line", "name"), cutoff, scorer, max_rows), cutoff, scorer)
    order = F.struct("_s", (-F.col("line")).alias("o")) if scorer == "weighted" else F.struct("_s", F.col("name").alias("o"))
    best = scored.groupBy("_q").agg(F.max_by(F.struct("name", "_s"), order).alias("_b")).select(
        "_q", F.col("_b.name").alias("_fn"), (F.col("_b._s") if scorer == "weighted" else F.lit(float(cutoff))).alias("_fs"))
    by_name = by_name.select("name_key", F.col("ik").alias("_fik"))
    best = stable(lookup_join(best, by_name, F.lower(F.col("_fn")), "name_key", max_rows=max_rows))
    j = lookup_join(exact, best, qkey, "_q", max_rows=max_rows)
    out = {f"{prefix}_ik": F.coalesce(F.col(f"{prefix}_ik"), F.col("_fik")),
           f"{prefix}_name": F.coalesce(F.col(f"{prefix}_name"), F.col("_fn")),
           f"{prefix}_score": F.when(F.col("_fs").isNotNull() & (F.col(f"{prefix}_score") < 1.0), F.col("_fs"))
           .otherwise(F.col(f"{prefix}_score"))}
    return j.withColumns(out).drop("_fik", "_fn", "_fs")

"""Reference-dictionary lookups: postcode <-> city, payer id <-> payer name.

Dimensions are parsed from text lines ``(line, value)`` with native split and
higher-order functions, reduced to one row per key with ``min_by``/``max_by``
(never a collected group per key), then joined with a size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions.text import WS, col_of, is_blank, pad_postcode, qcol, utrim
from fieldmill.operators.joins import BROADCAST_MAX_ROWS, is_broadcastable, lookup_join
from fieldmill.session import stable

# ---------------------------------------------------------------- parsing


def _parts(value: Column) -> Column:
    """Split a trimmed line on tabs when it has any, otherwise on whitespace
    runs (a city with spaces survives in tab-separated files)."""
    v = utrim(value)
    return F.when(F.instr(v, "\t") > 0, F.split(v, "\t+")).otherwise(F.split(v, WS + "+"))


def postcode_dim_from_lines(lines: DataFrame, width: int = 5) -> DataFrame:
    """``(line, value)`` lines ``country postcode city ...`` -> (line, postcode, city)."""
    p = lines.select("line", _parts(F.col("value")).alias("p"))
    p = p.where((utrim(F.get("p", 0)) != "") & (F.size("p") >= 3))
    return p.select("line", pad_postcode(F.get("p", 1), width).alias("postcode"), F.get("p", 2).alias("city"))


def payer_dim_from_lines(lines: DataFrame) -> DataFrame:
    """``(line, value)`` lines ``id name... postcode city street`` -> (line, ik, name).

    The name runs from the second part up to the first 5-digit part, else it
    is parts two and three.  Lines with an empty name are skipped.
    """
    p = lines.select("line", _parts(F.col("value")).alias("p"))
    p = p.where((F.size("p") >= 4) & F.get("p", 0).rlike("^[0-9]{9}$"))
    zip_pos = F.array_min(F.filter(
        F.transform("p", lambda x, i: F.when((i >= 1) & x.rlike("^[0-9]{5}$"), i)),
        lambda i: i.isNotNull()))
    name = F.when(zip_pos.isNotNull(), F.array_join(F.slice("p", F.lit(2), zip_pos - 1), " ")) \
        .otherwise(F.array_join(F.slice("p", 2, 2), " "))
    out = p.select("line", F.get("p", 0).alias("ik"), utrim(name).alias("name"))
    return out.where(F.col("name") != "")


# ----------------------------------------------------------- reductions


def first_city_by_postcode(dim: DataFrame) -> DataFrame:
    return dim.groupBy("postcode").agg(F.min_by("city", "line").alias("city"))


def first_postcode_by_city(dim: DataFrame) -> DataFrame:
    return (dim.groupBy(F.lower("city").alias("city_key"))
            .agg(F.min_by("postcode", "line").alias("postcode")))


def _ordered_distinct_list(dim: DataFrame, key: Column, key_name: str, item: str, out: str) -> DataFrame:
    # distinct (key, item) first (partial aggregation), then the ordered list
    # per key: the list is the operator's output cell itself.
    firsts = dim.groupBy(key.alias(key_name), qcol(item).alias("_item")).agg(F.min("line").alias("_first"))
    return (firsts.groupBy(key_name)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_item"))),
                             lambda s: s["_item"]).alias(out)))


def cities_by_postcode(dim: DataFrame) -> DataFrame:
    return _ordered_distinct_list(dim, F.col("postcode"), "postcode", "city", "cities")


def postcodes_by_city(dim: DataFrame) -> DataFrame:
    return _ordered_distinct_list(dim, F.lower("city"), "city_key", "postcode", "postcodes")


def payer_by_id(dim: DataFrame) -> DataFrame:
    """Last line wins per id."""
    return dim.groupBy("ik").agg(F.max_by("name", "line").alias("payer_name"))


def payer_by_name(dim: DataFrame) -> DataFrame:
    """Last line wins per lower-cased name; the canonical name is the id's name."""
    ids = dim.groupBy(F.lower("name").alias("name_key")).agg(F.max_by("ik", "line").alias("ik"))
    return ids.join(payer_by_id(dim), "ik")


def payer_names(dim: DataFrame) -> DataFrame:
    """Distinct payer names with their first line (the fuzzy candidate list)."""
    return dim.groupBy("name").agg(F.min("line").alias("line"))


# --------------------------------------------------------------- lookups


def lookup_city_by_postcode(df: DataFrame, own, postcode, dim: DataFrame, out: str,
                            width: int = 5, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Own non-blank value (trimmed) wins; else first city of the zero-filled
    postcode; else null."""
    firsts = first_city_by_postcode(dim).withColumnRenamed("city", "_city")
    key = F.when(~is_blank(postcode), pad_postcode(utrim(col_of(postcode)), width))
    j = lookup_join(df, firsts, key, "postcode", max_rows=max_rows)
    own_v = utrim(col_of(own)) if own is not None else F.lit(None).cast("string")
    res = F.when(own_v.isNotNull() & (own_v != ""), own_v).otherwise(F.col("_city"))
    return j.withColumn(out, res).drop("_city")


def lookup_postcode_by_city(df: DataFrame, own, city, dim: DataFrame, out: str,
                            width: int = 5, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Own non-blank value (trimmed, zero-filled) wins; else the first
    postcode of the lower-cased city; else null."""
    firsts = first_postcode_by_city(dim).withColumnRenamed("postcode", "_plz")
    key = F.when(~is_blank(city), F.lower(utrim(col_of(city))))
    j = lookup_join(df, firsts, key, "city_key", max_rows=max_rows)
    own_v = utrim(col_of(own)) if own is not None else F.lit(None).cast("string")
    res = F.when(own_v.isNotNull() & (own_v != ""), pad_postcode(own_v, width)).otherwise(F.col("_plz"))
    return j.withColumn(out, res).drop("_plz")


def all_cities_by_postcode(df: DataFrame, postcode, dim: DataFrame, out: str = "cities",
                           width: int = 5, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    lists = cities_by_postcode(dim).withColumnRenamed("cities", "_l")
    key = pad_postcode(utrim(F.coalesce(col_of(postcode), F.lit(""))), width)
    j = lookup_join(df, lists, key, "postcode", max_rows=max_rows)
    return j.withColumn(out, F.coalesce("_l", F.array().cast("array<string>"))).drop("_l")


def all_postcodes_by_city(df: DataFrame, city, dim: DataFrame, out: str = "postcodes",
                          max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    lists = postcodes_by_city(dim).withColumnRenamed("postcodes", "_l")
    key = F.lower(utrim(F.coalesce(col_of(city), F.lit(""))))
    j = lookup_join(df, lists, key, "city_key", max_rows=max_rows)
    return j.withColumn(out, F.coalesce("_l", F.array().cast("array<string>"))).drop("_l")


def payer_key(c) -> Column:
    """Trimmed, cut at the first '.', no zero-fill."""
    return F.substring_index(utrim(col_of(c)), ".", 1)


def lookup_payer_by_id(df: DataFrame, ik, dim: DataFrame, out: str,
                       max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    names = payer_by_id(dim).withColumnRenamed("payer_name", "_pn")
    key = F.when(~is_blank(ik), payer_key(ik))
    return lookup_join(df, names, key, "ik", max_rows=max_rows).withColumnRenamed("_pn", out)


def lookup_id_by_payer(df: DataFrame, name, dim: DataFrame, prefix: str = "match",
                       max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Case-insensitive exact name -> (ik, canonical name, score 1.0)."""
    return _exact_payer(df, name, payer_by_name(dim), prefix, max_rows)


def _exact_payer(df: DataFrame, name, by_name: DataFrame, prefix: str, max_rows: int) -> DataFrame:
    by_name = by_name.select("name_key", F.col("ik").alias("_ik"), F.col("payer_name").alias("_pn"))
    key = F.when(~is_blank(name), F.lower(utrim(col_of(name))))
    j = lookup_join(df, by_name, key, "name_key", max_rows=max_rows)
    return (j.withColumn(f"{prefix}_ik", F.col("_ik"))
            .withColumn(f"{prefix}_name", F.col("_pn"))
            .withColumn(f"{prefix}_score", F.when(F.col("_ik").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
            .drop("_ik", "_pn"))


# ---------------------------------------------------------- fuzzy match


def token_sorted(c) -> Column:
    return F.array_join(F.array_sort(F.split(F.lower(utrim(col_of(c))), WS + "+")), " ")


def padded_bigrams(c) -> Column:
    """Distinct bigrams of ``\\x02 + s + \\x03``."""
    p = F.concat(F.lit("\u0002"), col_of(c), F.lit("\u0003"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, 2)))


TOKEN_WEIGHT = 0.95  # the token-sorted form counts this much
_EPS = 1e-6          # slack of the candidate bounds; the final test is exact


def _forms(frame: DataFrame, text_col: str, keys: list[str], cutoff: float, fuzzy: bool) -> DataFrame:
    """One row per string and form: ``_f`` (r raw, s token-sorted), ``_c`` (the
    similarity this form needs to reach the cutoff), ``_t`` text, ``_l`` length,
    ``_g`` bigrams.  A form that cannot reach the cutoff is left out."""
    forms = [("r", F.lower(qcol(text_col)), cutoff)]
    if fuzzy and cutoff <= TOKEN_WEIGHT:
        forms.append(("s", token_sorted(qcol(text_col)), cutoff / TOKEN_WEIGHT))
    one = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(float(max(c, 0.0))).alias("c"), t.alias("t")) for f, t, c in forms])
    return (frame.select(*keys, F.explode(one).alias("_x"))
            .select(*keys, F.col("_x.f").alias("_f"), F.col("_x.c").alias("_c"), F.col("_x.t").alias("_t"))
            .withColumn("_l", F.length("_t")).withColumn("_g", padded_bigrams(F.col("_t"))))


def _edits(longer: Column, need: Column) -> Column:
    """Most edits between strings of similarity ``need``."""
    return F.floor(longer * (1.0 - need) + _EPS).cast("int")


def fuzzy_candidates(queries: DataFrame, names: DataFrame, cutoff: float, fuzzy: bool = True,
                     max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """(query, line, form) rows that hold every pair at or above ``cutoff``,
    before any edit distance; at most one row per pair inside the length band
    and form on average.

    ``k`` edits destroy at most ``2k`` distinct bigrams of the query (one less
    for every character the name is longer), so one of its ``2k+1`` rarest is
    in the name.  Those are the query's keys when it has that many and the
    names behind them are fewer than the names of fitting length; otherwise
    its keys are the fitting lengths.  Either way one equi-join.
    """
    q = _forms(queries, "_q", ["_q"], cutoff, fuzzy)
    n = stable(_forms(names, "name", ["line", "name"], cutoff, fuzzy))
    n_keys = n.select("_f", "line", F.explode(F.concat("_g", F.array(F.concat(F.lit("#"), F.col("_l"))))).alias("_k"))
    freq = n_keys.groupBy("_f", "_k").agg(F.count(F.lit(1)).alias("_n"))
    # per form, how many names have which length: one entry per length
    lengths = n.groupBy("_f", F.col("_l").alias("l")).agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("_f").agg(F.collect_list(F.struct("l", "n")).alias("_ls"))
    small = is_broadcastable(n_keys, max_rows)
    held = F.broadcast if small else (lambda d: d)

    def in_band(x):
        longer, shorter = F.greatest(x["l"], F.col("_l")), F.least(x["l"], F.col("_l"))
        return longer - shorter <= _edits(longer, F.col("_c"))

    ranked = (q.select("_q", "_f", F.explode("_g").alias("_k")).join(held(freq), ["_f", "_k"], "left")
              .groupBy("_q", "_f").agg(F.array_sort(F.collect_list(F.struct(
                  F.coalesce("_n", F.lit(0)).alias("n"), F.col("_k").alias("k")))).alias("_r")))
    q = q.join(ranked, ["_q", "_f"]).join(F.broadcast(lengths), "_f") \
        .withColumn("_ls", F.filter("_ls", in_band)) \
        .withColumn("_p", (F.floor(F.col("_l") * 2.0 * (1.0 - F.col("_c")) + _EPS) + 1).cast("int"))
    prefix = F.slice("_r", F.lit(1), F.col("_p"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    by_gram = (F.col("_c") >= 0.5) & (F.size("_r") >= F.col("_p")) & (total(prefix) < total(F.col("_ls")))
    q = q.withColumn("_keys", F.when(by_gram, F.transform(F.filter(prefix, lambda x: x["n"] > 0), lambda x: x["k"]))
                     .otherwise(F.transform("_ls", lambda x: F.concat(F.lit("#"), x["l"].cast("string")))))
    cand = q.select("_q", "_f", "_c", "_t", "_l", "_g", "_keys", F.posexplode("_keys").alias("_i", "_k")) \
        .join(held(n_keys), ["_f", "_k"]) \
        .join(held(n.select("_f", "line", "name", F.col("_t").alias("_nt"), F.col("_l").alias("_nl"),
                            F.col("_g").alias("_ng"))), ["_f", "line"])
    # a pair is taken at the first of the query's keys that the name has
    first = (F.col("_i") == 0) | ~F.arrays_overlap(F.slice("_keys", F.lit(1), F.col("_i")), F.col("_ng"))
    longer, longer_by = F.greatest("_l", "_nl"), F.col("_nl") - F.col("_l")
    return (cand.withColumn("_e", _edits(longer, F.col("_c")))
            .where((F.abs(longer_by) <= F.col("_e")) & first)
            .where(F.size(F.array_intersect("_g", "_ng"))
                   >= F.size("_g") - 2 * F.col("_e") + F.greatest(longer_by, F.lit(0)))
            .select("_q", "_f", "line", "name", "_t", "_nt", "_e", longer.alias("_m")))


def match_payer_fuzzy(df: DataFrame, name, dim: DataFrame, cutoff: float = 0.6,
                      prefix: str = "match", max_rows: int = BROADCAST_MAX_ROWS, fuzzy: bool = True) -> DataFrame:
    """Exact case-insensitive hit (score 1.0), else the best-scoring payer
    name at or above ``cutoff`` (ties: earliest line), else nulls and 0.0.

    Score: 1 - edit distance / longer length of the lower-cased names, or 0.95
    times that of their token-sorted forms.  ``fuzzy=False`` compares the
    names as they are, without the token-sorted form, and reports the cutoff
    as the score.  Only distinct unmatched names are scored, against the pairs
    of ``fuzzy_candidates``; any cutoff gives what comparing all pairs would.
    """
    # the dictionary is read and reduced once, not in every step below
    dim = stable(dim.select("line", "ik", "name"))
    by_name = stable(payer_by_name(dim))
    exact = _exact_payer(df, name, by_name, prefix, max_rows)
    qkey = F.lower(utrim(col_of(name)))
    queries = stable(exact.where(F.col(f"{prefix}_ik").isNull() & ~is_blank(name)).select(qkey.alias("_q")).distinct())
    cand = fuzzy_candidates(queries, payer_names(dim), cutoff, fuzzy, max_rows)
    # the threshold form gives -1 beyond _e edits
    scored = cand.withColumn("_d", F.call_function("levenshtein", "_t", "_nt", "_e")).where(F.col("_d") >= 0)
    sim = F.when(F.col("_m") == 0, F.lit(1.0)).otherwise(1.0 - F.col("_d") / F.col("_m"))
    scored = scored.withColumn("_s", F.when(F.col("_f") == "s", F.lit(TOKEN_WEIGHT) * sim).otherwise(sim)) \
        .where(F.col("_s") >= cutoff)
    best = (scored.groupBy("_q")
            .agg(F.max_by(F.struct("name", "_s"), F.struct("_s", (-F.col("line")).alias("_neg"))).alias("_b"))
            .select("_q", F.col("_b.name").alias("_fn"), (F.col("_b._s") if fuzzy else F.lit(float(cutoff))).alias("_fs")))
    by_name = by_name.select("name_key", F.col("ik").alias("_fik"))
    # one row per distinct unmatched name: materialised once, so the size
    # check before the join does not run the scoring a second time
    best = stable(lookup_join(best, by_name, F.lower(F.col("_fn")), "name_key", max_rows=max_rows))
    j = lookup_join(exact, best, qkey, "_q", max_rows=max_rows)
    return (j.withColumn(f"{prefix}_ik", F.coalesce(F.col(f"{prefix}_ik"), F.col("_fik")))
            .withColumn(f"{prefix}_name", F.coalesce(F.col(f"{prefix}_name"), F.col("_fn")))
            .withColumn(f"{prefix}_score", F.when(F.col("_fs").isNotNull() & (F.col(f"{prefix}_score") < 1.0), F.col("_fs"))
                        .otherwise(F.col(f"{prefix}_score")))
            .drop("_fik", "_fn", "_fs"))

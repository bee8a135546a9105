"""Delimited text in: all-string columns, a header row per file, quotes.

Shape rules (as a lenient spreadsheet import does it): a row with too many
fields is dropped, a row with too few is padded with nulls, blank lines are
skipped, missing-value tokens become null.  Spark's PERMISSIVE reader marks
both too-long and too-short rows as malformed, so for malformed rows only the
separators outside quotes are counted and short rows are kept.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmill.functions.text import NA_TOKENS, qcol
from fieldmill.operators.prefix import FAN, MOST_HELD, held, with_start
from fieldmill.operators.rowid import with_row_index
from fieldmill.session import stable
from fieldmill.sources import records

CORRUPT = "_corrupt_record"
# Delimiter candidates; encodings a source may be read with.
DELIMITERS = [";", ",", "\t", "|"]
_SPARK_CHARSET = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "windows-1252", "latin1": "ISO-8859-1"}


def charset_of(encoding: str) -> str:
    return _SPARK_CHARSET.get(encoding.lower(), encoding)


MOST_LAYOUTS = 1000  # different header lines that one read may have


def _names(line: str, sep: str, quote: str) -> list[str]:
    """Column names of a header line: empty ones become ``_c0``..., repeated
    ones get their position appended."""
    names = next(csv.reader([line.lstrip("\ufeff")], delimiter=sep, quotechar=quote), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


# A doubled quote inside a quoted field is two quoted runs side by side, so
# this linear pattern removes every quoted part.
QUOTED = '"[^"]*"'
QUOTES = ['"', "'"]  # fixed values: quote candidates, most usual first


def n_fields(cols: list[str], sep: str, quote: str = '"') -> Column:
    """Fields of a row: as many as columns if it is well-formed, else counted
    by the separators outside quotes."""
    raw = qcol(CORRUPT)
    outside = F.regexp_replace(raw, QUOTED.replace('"', quote), "")
    counted = F.length(F.regexp_replace(outside, "[^" + re.escape(sep) + "]", "")) + 1
    # The test references every field: with CSV column pruning a scan of
    # fewer columns would not see a too-long row as malformed, and Spark
    # refuses plans that read only the corrupt-record column.
    all_fields = F.length(F.concat_ws("\u0001", *[qcol(c) for c in cols])) >= 0
    return F.when(all_fields & raw.isNull(), F.lit(len(cols))).otherwise(counted)


def has_shape(cols: list[str], sep: str) -> Column:
    """The rows a stream keeps: well-formed ones and short ones.  A stream
    cannot look for line breaks beforehand: a malformed line with a cell that
    opens a quote and does not close it ends the job."""
    outside = F.regexp_replace(qcol(CORRUPT), QUOTED, "")
    opened = F.coalesce(outside.rlike('(^|' + re.escape(sep) + ')"'), F.lit(False))
    return F.when(opened, F.raise_error(F.lit("a quoted cell holds a line break: not readable as a stream")).cast("boolean")) \
        .otherwise(n_fields(cols, sep) <= len(cols))


FILE_ORDER_COLS = ["_src_file", "_src_block", "_src_pos"]


def read_delimited(spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8",
                   columns: list[str] | None = None, header: bool = True,
                   na_tokens: list[str] | None = None, multiline: bool = False,
                   file_order: bool = False, headers: str = "by_name", unknown: str = "null",
                   line_breaks: bool | None = None, quote: str = '"') -> DataFrame:
    """Read delimited text as all-string columns (see module doc).

    ``headers``: with ``by_name`` each file's own header line says which field
    is which column.  The columns are ``columns``, else all names in order of
    first sight (files by path).  ``unknown``: a file without one of them
    gives nulls, or ends the job (``error``).  ``same`` trusts that all files
    have the header of the first.
    ``line_breaks``: whether quoted cells hold line breaks; ``None`` looks.
    Such a read stays splittable (``records``), a break comes out as ``\\n``.
    ``False`` trusts that there are none.  ``multiline`` reads a whole file in
    one task instead.  Looking (for headers or breaks) is one more pass over
    the lines; ``headers="same", line_breaks=False`` saves it.
    ``na_tokens`` is an argument because a surname such as ``Null`` is a
    real value in some files; pass ``[]`` to keep every token.
    ``file_order`` adds the file, split start and position inside the split
    (``_src_file``, ``_src_block``, ``_src_pos``) so rows can be numbered in
    file order (``with_file_row_index``): Spark packs splits by size, so the
    partition order of many files is not their file order.
    """
    charset = charset_of(encoding)
    look = header and (headers == "by_name" or line_breaks is None and not multiline)
    files = None
    if look:
        files = stable(records.survey(spark, path, sep, charset, quote))
        seen = files.groupBy("header").agg(F.min("_src_file").alias("first"), F.max("breaks").alias("breaks")) \
            .orderBy("first").limit(MOST_LAYOUTS + 1).collect()
        if len(seen) > MOST_LAYOUTS:
            raise ValueError(f"more than {MOST_LAYOUTS} different header lines")
        if line_breaks is None:
            line_breaks = any(r.breaks for r in seen)
        lines = [r.header for r in (seen if headers == "by_name" else seen[:1])]
    elif header:
        first = spark.read.option("encoding", charset).text(path).where(F.length(F.trim("value")) > 0).first()
        lines = [first.value] if first else []
    else:
        lines = []
    layouts = [_names(line, sep, quote) for line in lines] or [columns or []]
    cols = columns or list(dict.fromkeys(n for names in layouts for n in names))
    if not cols:
        return spark.createDataFrame([], T.StructType())
    if unknown == "error" and any(set(cols) - set(names) for names in layouts):
        raise ValueError("a file lacks a column: " + ", ".join(sorted(set(cols) - set.intersection(*map(set, layouts)))))
    by_position = not header or headers == "same" and columns is not None
    width = len(cols) if by_position else max(map(len, layouts))
    fields = [f"_f{i}" for i in range(width)]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in [*fields, CORRUPT]])
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    source = [F.col("_metadata.file_path").alias("_src_file"), F.col("_metadata.file_block_start").alias("_src_block")]
    many = not by_position and len(layouts) > 1
    if line_breaks and not multiline:
        whole = records.whole_records(spark, path, sep, charset, quote)
        if header:
            heads = stable(whole.groupBy("_src_file").agg(F.min(F.struct("_src_block", "_src_pos")).alias("h"))
                           .select("_src_file", "h._src_block", "h._src_pos"))
            whole = whole.join(held(heads, heads.count()), FILE_ORDER_COLS, "left_anti")
        raw = whole.select(*FILE_ORDER_COLS, F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), options)
                           .alias("_r")).select(*FILE_ORDER_COLS, "_r.*")
    else:
        raw = spark.read.schema(schema).options(**options).option("header", header).option("encoding", charset) \
            .option("multiLine", multiline).csv(path)
        if file_order or many:
            raw = raw.select("*", *source)
    size = F.lit(width if by_position else len(layouts[0]))
    if many:  # per file: which field is which column
        known = spark.createDataFrame([(line, i) for i, line in enumerate(lines)], "header string, _layout int")
        own = files.join(F.broadcast(known), "header").select("_src_file", "_layout")
        n_files = files.count()
        if n_files > MOST_HELD and "_src_pos" not in raw.columns:
            raw = raw.withColumn("_src_pos", F.monotonically_increasing_id())
        raw = raw.join(held(own, n_files), "_src_file")
        size = F.get(F.array(*[F.lit(len(names)) for names in layouts]), F.col("_layout"))
    kept = raw.where(n_fields(fields, sep, quote) <= size)
    if file_order and "_src_pos" not in kept.columns:
        # positions after the row filter: kept rows of one split are contiguous
        kept = kept.withColumn("_src_pos", F.monotonically_increasing_id())

    def cell(i: int, name: str) -> Column:
        if by_position:
            return F.col(fields[i])
        at = [names.index(name) if name in names else -1 for names in layouts]
        if not many:
            return F.col(fields[at[0]]) if at[0] >= 0 else F.lit(None).cast("string")
        return F.get(F.array(*map(F.col, fields)), F.get(F.array(*map(F.lit, at)), F.col("_layout")))

    tokens = NA_TOKENS if na_tokens is None else na_tokens
    extra = [F.col(c) for c in FILE_ORDER_COLS] if file_order else []
    cells = [(c, cell(i, c)) for i, c in enumerate(cols)]
    return kept.select(*[(F.when(~v.isin(tokens), v) if tokens else v).alias(c) for c, v in cells], *extra)


def with_file_row_index(df: DataFrame, name: str = "_row", fan: int = FAN) -> DataFrame:
    """Contiguous row numbers in file order for a ``file_order=True`` read,
    without a shuffle of the rows.

    The read is first materialised in the shared checkpoint folder: how files
    are cut into splits depends on the cluster's size at that moment, so
    offsets and rows must come from one pass.  Rows of one file split are
    contiguous there; one aggregate (first position and count per split) and a
    distributed running sum in (file, split) order give every split its start.
    Where positions have gaps (records put together over splits), the rows are
    sorted instead.  A row without an offset ends the job.
    """
    df = stable(df)
    splits = stable(df.groupBy("_src_file", "_src_block").agg(
        F.min("_src_pos").alias("_first"), F.max("_src_pos").alias("_last"), F.count(F.lit(1)).alias("_n")))
    if not splits.where("_last - _first + 1 <> _n").isEmpty():
        return with_row_index(df, FILE_ORDER_COLS, name, fan).drop(*FILE_ORDER_COLS)
    off = stable(with_start(splits.drop("_last"), ["_src_file", "_src_block"], "_n", "_off", fan).drop("_n"))
    out = df.join(held(off, off.count()), ["_src_file", "_src_block"], "left")
    start = F.coalesce("_off", F.raise_error(F.lit("a file split has no row offset")).cast("long"))
    out = out.withColumn(name, (start + F.col("_src_pos") - F.col("_first")).cast("long"))
    return out.drop(*FILE_ORDER_COLS, "_first", "_off")


ALIKE = 0.9  # share of a file's lines that must have the same number of fields


def detect_dialect(spark: SparkSession, path: str) -> DataFrame:
    """Per file: the delimiter, the encoding and the quote to read it with,
    its lines, and the share of them that have the usual number of fields.

    Whole files are read, so the answer does not depend on how they are
    split: one late cp1252 byte decides the encoding.

    For each delimiter and quote a histogram of delimiters outside quotes per
    non-blank line is counted (map-side combined); its mode is the usual
    number.  Of the candidates whose mode is above 0 and holds for at least
    ``ALIKE`` of the lines the highest mode wins, so a title line or a few
    broken lines change nothing; if there is none, the highest share, and
    ``;`` with ``"`` if no candidate occurs.  Equal ones go by the order of
    ``DELIMITERS`` and ``QUOTES``.  Encoding: a BOM -> utf-8-sig; any line
    that is not valid UTF-8 -> cp1252, or latin1 if it holds a byte cp1252
    leaves undefined; else utf-8.
    """
    text = spark.read.option("encoding", "UTF-8").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file_path"), F.col("value")).where(F.length(F.trim("value")) > 0)
    undefined = F.when(~F.is_valid_utf8("value"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")
                       .rlike("[\u0081\u008d\u008f\u0090\u009d]")).otherwise(False)
    counts = []
    for q, quote in enumerate(QUOTES):
        outside = F.when(F.instr("value", quote) > 0, F.regexp_replace("value", QUOTED.replace('"', quote), "")) \
            .otherwise(F.col("value"))
        counts += [F.struct(F.lit(d).alias("d"), F.lit(q).alias("q"),
                            (F.length(outside) - F.length(F.replace(outside, F.lit(delimiter), F.lit("")))).alias("n"))
                   for d, delimiter in enumerate(DELIMITERS)]
    told = lines.select("file_path", F.array(*counts).alias("c"), F.col("value").startswith("\ufeff").alias("bom"),
                        (~F.is_valid_utf8("value")).alias("bad"), undefined.alias("latin"))
    seen = told.select("file_path", F.explode("c").alias("c"), "bom", "bad", "latin").groupBy("file_path", "c.d", "c.q", "c.n") \
        .agg(F.count(F.lit(1)).alias("lines"), *[F.max(c).alias(c) for c in ("bom", "bad", "latin")])
    rated = seen.groupBy("file_path", "d", "q").agg(
        F.sum("lines").alias("n_lines"), F.max_by(F.struct("n", "lines"), F.struct("lines", "n")).alias("mode"),
        *[F.max(c).alias(c) for c in ("bom", "bad", "latin")])
    share = F.when(F.col("mode.n") > 0, F.col("mode.lines") / F.col("n_lines")).otherwise(0.0)
    score = F.struct((share >= ALIKE).alias("alike"), F.when(share >= ALIKE, F.col("mode.n")).otherwise(0).alias("n"),
                     share.alias("share"), F.col("mode.n").alias("mode"), (-F.col("d")).alias("d"), (-F.col("q")).alias("q"))
    best = rated.groupBy("file_path").agg(F.max(score).alias("s"), F.first("n_lines").alias("n_lines"),
                                          *[F.max(c).alias(c) for c in ("bom", "bad", "latin")])
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), F.when(F.col("s.share") > 0, -at).otherwise(0))
    enc = (F.when(F.col("bom"), F.lit("utf-8-sig")).when(F.col("latin"), F.lit("latin1"))
           .when(F.col("bad"), F.lit("cp1252")).otherwise(F.lit("utf-8")))
    return best.select("file_path", pick(DELIMITERS, F.col("s.d")).alias("delimiter"), enc.alias("encoding"), "n_lines",
                       pick(QUOTES, F.col("s.q")).alias("quote"), F.col("s.share").alias("share"))


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Text lines with a file-order line number (for dimension files),
    numbered like ``with_file_row_index``: no sort, no shuffle."""
    df = spark.read.option("encoding", encoding).text(path).select(
        F.col("_metadata.file_path").alias("_src_file"), F.col("_metadata.file_block_start").alias("_src_block"),
        F.monotonically_increasing_id().alias("_src_pos"), "value")
    return with_file_row_index(df, name="line").select("line", "value")

"""Update or insert mapped rows into an existing table, field by field.

``upsert`` is the join: changes are reduced to one row per key, the chosen
fields of the rows that hold a key are overwritten, changes of new keys are
added.  ``create_table``, ``read_table`` and ``upsert_table`` keep such a table
in a folder of Parquet parts by key hash: only the parts that changes fall in
are written anew, into a folder of their own, and one log file, which appears
whole or not at all, switches readers over.  A job that is lost before leaves
files that nobody reads.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldmill.functions.text import qcol
from fieldmill.operators.joins import is_broadcastable, lookup_join
from fieldmill.session import stable

PARTS = 64


def _key(df: DataFrame, keys: list[str], like: StructType) -> Column:
    """The key columns as one struct in the table's types; null if one is null."""
    whole = F.struct(*[qcol(k).cast(like[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)])
    known = F.lit(True)
    for k in keys:
        known = known & qcol(k).isNotNull()
    return F.when(known, whole)


def _check(target: StructType, changes: DataFrame, keys: list[str], fields: list[str] | None) -> list[str]:
    """The fields to update; unknown names are errors."""
    if not keys:
        raise ValueError("an upsert needs at least one key column")
    given = [c for c in target.names if c in changes.columns and c not in keys]
    fields = given if fields is None else list(fields)
    for names, where in ((keys, target.names), (keys, changes.columns), (fields, given)):
        if missing := [c for c in names if c not in where]:
            raise ValueError(f"columns {missing} are not in both tables, or are keys")
    return fields


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], fields: list[str] | None = None,
           order_by: tuple[str, ...] = (), keep_if_null: bool = False, insert: bool = True) -> DataFrame:
    """``target`` with ``changes`` applied; columns and types of ``target``.

    Rows whose key is among the changes take ``fields`` (default: all columns
    that both tables have, but keys) from there; the others keep what they
    hold.  ``keep_if_null``: a null in a change leaves the old value.  Of several
    changes for one key the greatest by ``order_by`` (columns of ``changes``,
    nulls first), then by its whole row, counts.  Every row of ``target`` that
    repeats a key is updated.  Changes of other keys are added (``insert``)
    with all the columns they have, null elsewhere.  A key with a null equals
    no key: such rows of ``target`` stay, such changes are all added.
    """
    fields = _check(target.schema, changes, keys, fields)
    key = _key(changes, keys, target.schema)
    whole = F.struct(*[qcol(c) for c in changes.columns])
    rank = F.struct(*[qcol(c).alias(f"o{i}") for i, c in enumerate(order_by)], whole.alias("row"))
    last = stable(changes.withColumn("_uk", key).where("_uk is not null").groupBy("_uk")
                  .agg(F.max(rank).alias("_r")).select("_uk", F.col("_r.row").alias("_new")))
    joined = lookup_join(target, last, _key(target, keys, target.schema), "_uk")

    def new(c: str) -> Column:
        return F.col("_new").getField(c).cast(target.schema[c].dataType)

    def updated(c: str) -> Column:
        if c not in fields:
            return qcol(c)
        given = F.coalesce(new(c), qcol(c)) if keep_if_null else new(c)
        return F.when(F.col("_new").isNotNull(), given).otherwise(qcol(c)).alias(c)

    out = joined.select(*[updated(c) for c in target.columns])
    if not insert:
        return out
    # keys of the table among the changes: few changes keep the table from being shuffled
    held = target.select(_key(target, keys, target.schema).alias("_uk")).where("_uk is not null")
    if is_broadcastable(last.select("_uk")):
        held = held.join(F.broadcast(last.select("_uk")), "_uk", "left_semi")
    fresh = last.join(held.distinct(), "_uk", "left_anti").select("_new") \
        .unionAll(changes.where(key.isNull()).select(whole.alias("_new")))
    return out.unionAll(fresh.select(*[
        (new(c) if c in changes.columns else F.lit(None).cast(target.schema[c].dataType)).alias(c)
        for c in target.columns]))


# ------------------------------------------------------------ tables in folders

def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _publish(spark: SparkSession, folder: str, name: str, content: str) -> bool:
    """A file with its whole content, or False if there is one of that name."""
    fs, path = _fs(spark, folder)
    fs.mkdirs(path)
    draft = f".{name}-{uuid.uuid4().hex}"
    if fs.getScheme() == "file":  # a link is exclusive, a local rename is not
        local = path.toUri().getPath()
        with open(os.path.join(local, draft), "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(os.path.join(local, draft), os.path.join(local, name))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(os.path.join(local, draft))
    new = spark._jvm.org.apache.hadoop.fs.Path
    stream = fs.create(new(path, draft), False)
    stream.write(bytearray(content, "utf-8"))
    stream.close()
    return fs.rename(new(path, draft), new(path, name))


def _state(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """The newest version (or the one asked for) and what it holds: keys,
    parts, schema and the folders of every part that has rows."""
    known = [int(n) for n in _names(spark, f"{path}/log") if n.isdigit()]
    at = max(known, default=-1) if version is None else version
    if at not in known:
        raise FileNotFoundError(f"no version of a table in {path}")
    return at, json.loads(spark.read.text(f"{path}/log/{at}", wholetext=True).first()[0])


def _read(spark: SparkSession, path: str, state: dict, parts=None) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    folders = [f"{path}/{run}/part={p}" for p, runs in state["folders"].items() if parts is None or int(p) in parts
               for run in runs]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _part(df: DataFrame, keys: list[str], parts: int, like: StructType) -> Column:
    """By key; rows without a whole key are spread by all their columns."""
    key = _key(df, keys, like)
    rest = F.xxhash64(*[qcol(c).cast("string") for c in df.columns])
    return F.pmod(F.when(key.isNull(), rest).otherwise(F.xxhash64(key)), F.lit(parts)).cast("int")


def _write(df: DataFrame, path: str, keys: list[str], parts: int) -> tuple[str, list[int]]:
    """Write the parts of ``df`` to a new folder; its name and the parts with rows."""
    if "part" in df.columns:
        raise ValueError("a column of a kept table cannot be called part")
    spark, run = df.sparkSession, f"run-{uuid.uuid4().hex}"
    # rebalance: one file or a few for a part, also where one key holds most rows
    df.withColumn("part", _part(df, keys, parts, df.schema)).hint("rebalance", F.col("part")) \
        .write.partitionBy("part").parquet(f"{path}/{run}")
    return run, [int(n.removeprefix("part=")) for n in _names(spark, f"{path}/{run}") if n.startswith("part=")]


def _commit(spark: SparkSession, path: str, version: int, state: dict) -> int:
    if not _publish(spark, f"{path}/log", str(version), json.dumps(state)):
        raise RuntimeError(f"another job wrote version {version} of {path}; this one's rows are not in it")
    return version


def create_table(df: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> int:
    """Write ``df`` as version 0 of a new table; an existing one is an error."""
    _check(df.schema, df, keys, None)
    run, filled = _write(df, path, keys, parts)
    return _commit(df.sparkSession, path, 0, {"keys": keys, "parts": parts, "schema": df.schema.jsonValue(),
                                              "folders": {str(p): [run] for p in filled}})


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its newest version, or of an earlier one."""
    return _read(spark, path, _state(spark, path, version)[1])


def upsert_table(changes: DataFrame, path: str, **options) -> int:
    """Apply ``upsert`` to the table in ``path`` and return the new version.

    Parts without changes are not read or written.  If another job commits
    first this one fails and changes nothing.  Old parts stay for the readers
    of earlier versions.  No changes make no version.
    """
    spark = changes.sparkSession
    at, state = _state(spark, path)
    keys, parts, like = state["keys"], state["parts"], StructType.fromJson(state["schema"])
    changes = stable(changes)
    placed = _part(changes, keys, parts, like)
    touched = {r.part for r in changes.where(_key(changes, keys, like).isNotNull()).select(placed.alias("part"))
               .distinct().collect()}  # at most ``parts`` rows
    run, filled = _write(upsert(_read(spark, path, state, touched), changes, keys, **options), path, keys, parts)
    if not filled:
        return at
    # the parts read are replaced; rows without key are added to the parts they fall in
    folders = dict(state["folders"])
    for p in filled:
        folders[str(p)] = [run] if p in touched else folders.get(str(p), []) + [run]
    return _commit(spark, path, at + 1, {**state, "folders": folders})

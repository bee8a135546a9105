"""Claimed uid blocks, and the row sequence on a stream that is started again."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fieldmill.functions import keys
from fieldmill.operators import claims
from fieldmill.operators.rowid import with_row_index
from fieldmill.streaming import sequence_stream as seq

NOW = 1_700_000_000_000


def test_jobs_of_one_clock_reading_get_other_blocks(spark, tmpdir_new):
    with ThreadPoolExecutor(8) as pool:
        bases = list(pool.map(lambda _: claims.claim_base(spark, 10, folder=tmpdir_new, now_ms=NOW), range(16)))
    assert len(set(bases)) == 16 and min(bases) == NOW


def test_blocks_of_many_rows_are_disjoint(spark, tmpdir_new):
    space = keys.SUFFIX_SPACE
    jobs = [(1, 0), (2 * space + 1, 0), (1, 1), (space, 3 * space), (0, 0), (space + 1, space + 1)]
    rows = []
    for i, (n, below) in enumerate(jobs):
        base = claims.claim_base(spark, n, below, folder=tmpdir_new, now_ms=NOW)
        ends = {r for r in (0, n - 1, min(n - 1, space)) if 0 <= r < n} | ({-1, -below} if below else set())
        rows += [(i, base, r) for r in ends]
        owned = range(base - -(-below // space), base + max(1, -(-n // space)))
        assert all(os.path.exists(os.path.join(tmpdir_new, f"ms-{ms}")) for ms in owned)
    uids = [keys_of for base, group in _grouped(rows).items()
            for keys_of in [r.u for r in spark.createDataFrame([(r,) for r in group], "r long")
                            .select(keys.generate_uid("r", base).alias("u")).collect()]]
    assert len(set(uids)) == len(uids) == len(rows)


def _grouped(rows):
    out = {}
    for _, base, r in rows:
        out.setdefault(base, []).append(r)
    return out


def _files(folder, n):
    for i in range(n):
        path = os.path.join(folder, f"f{i}.json")
        with open(path, "w") as f:
            for j in range(5 + i):
                f.write('{"k": %d, "e": %s}\n' % (100 * i + 7 * j % 11, '"X%d"' % j if j == 2 else "null"))
        os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))


def _stream(spark, folder):
    return spark.readStream.schema("k long, e string").option("maxFilesPerTrigger", 1).json(folder)


@pytest.mark.parametrize("when", ["before the mark", "after the mark", "while numbering"])
def test_stream_started_again_equals_the_batch_run(spark, tmpdir_new, monkeypatch, when):
    src, out = os.path.join(tmpdir_new, "in"), os.path.join(tmpdir_new, "out")
    os.makedirs(src)
    _files(src, 4)
    commit, number = seq._commit, seq.with_row_index

    def failing_commit(s, marks, batch_id, end):
        if when == "after the mark":
            commit(s, marks, batch_id, end)
        if batch_id == 1:
            raise RuntimeError("lost")
        commit(s, marks, batch_id, end)

    def failing_index(df, **kw):
        if seq._start(spark, marks, 1):
            raise RuntimeError("lost")
        return number(df, **kw)

    name = os.path.basename(tmpdir_new)
    marks = os.path.join(spark.sparkContext.getCheckpointDir(), "fieldmill-streams", name, "marks")
    if when == "while numbering":
        monkeypatch.setattr(seq, "with_row_index", failing_index)
    else:
        monkeypatch.setattr(seq, "_commit", failing_commit)
    with pytest.raises(StreamingQueryException):
        seq.run_sequence(_stream(spark, src), out, name, ["k"], "e")
    monkeypatch.undo()
    seq.run_sequence(_stream(spark, src), out, name, ["k"], "e")
    seq.run_sequence(_stream(spark, src), out, name, ["k"], "e")  # nothing new: no row twice
    want = with_row_index(spark.read.schema("k long, e string").json(src), order_by=["k"]) \
        .select("k", "e", "_row", keys.auto_sequence_6("e", "_row").alias("id")).collect()
    got = spark.read.parquet(out).select("k", "e", "_row", "id").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 26
    _files(src, 5)  # a later file goes on behind them
    seq.run_sequence(_stream(spark, src), out, name, ["k"], "e")
    assert spark.read.parquet(out).agg(F.max("_row"), F.countDistinct("_row")).first()[:] == (34, 35)


def test_empty_stream_writes_nothing(spark, tmpdir_new):
    src, out = os.path.join(tmpdir_new, "in"), os.path.join(tmpdir_new, "out")
    os.makedirs(src)
    seq.run_sequence(_stream(spark, src), out, os.path.basename(tmpdir_new) + "e", ["k"], "e")
    assert not os.path.exists(out)


def test_claimed_jobs_share_no_id(spark, tmpdir_new):
    from fieldmill.operators.extras import ExtraField
    from fieldmill.plans import twophase
    from fieldmill.plans.spec import MappingSpec, Rule
    src = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "_row long, x string")
    ids = []
    for _ in range(2):
        spec = MappingSpec({"id": "VARCHAR(40)"}, {}, {"id": Rule("generate_uid")})
        job = twophase.claimed(twophase.Job(src, spec, clean_strings=False, extra_fields=[ExtraField("x")], base_ms=NOW),
                               tmpdir_new)
        tables = twophase.phase_b(job)
        ids += [r.id for r in tables["mapped"].collect()] + [r.id for r in tables["property_values"].collect()]
    assert len(ids) == len(set(ids)) == 10

"""Upsert against a plain Python merge, and tables in folders with interrupted and rival jobs."""

import random

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import joins, upsert

TABLE = "k long, `s.n` string, a string, b string, c int"
CHANGES = "k string, `s.n` string, a string, b string, seq int"


def _rows(seed, n, changes):
    rnd = random.Random(seed)

    def text():
        return rnd.choice([None, "", "x", "y", "long " * 50, str(rnd.random())])
    out = []
    for i in range(n):
        k = rnd.choice([None, 0, 0, 0, rnd.randrange(60)])  # 0 is hot
        s = rnd.choice([None, "p", "q"])
        out.append((None if k is None else str(k), s, text(), text(), rnd.choice([None, i % 7])) if changes
                   else (k, s, text(), text(), i))
    return out


def _merged(table, changes, fields, keep, insert):
    """One row at a time."""
    at = {"a": 2, "b": 3}
    last = {}
    for r in changes:
        if r[0] is None or r[1] is None:
            continue
        rank = [(v is not None, v) if v is not None else (False,) for v in (r[4], *r)]
        key = (int(r[0]), r[1])
        if key not in last or rank > last[key][0]:
            last[key] = (rank, r)
    out = []
    for r in table:
        r = list(r)
        if (r[0], r[1]) in last:
            new = last[(r[0], r[1])][1]
            for f in fields:
                if not (keep and new[at[f]] is None):
                    r[at[f]] = new[at[f]]
        out.append(tuple(r))
    if insert:
        held = {(r[0], r[1]) for r in table}
        rows = [r for k, (_, r) in last.items() if k not in held]
        rows += [r for r in changes if r[0] is None or r[1] is None]
        out += [(None if r[0] is None else int(r[0]), r[1], r[2], r[3], None) for r in rows]
    return sorted(out, key=repr)


def _got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("fields, keep, insert, shuffled", [
    (["a"], False, True, False), (["a", "b"], True, True, True), (["b"], True, False, False)])
def test_upsert_equals_plain_merge(spark, monkeypatch, fields, keep, insert, shuffled):
    if shuffled:  # no broadcast, every key with over 10 rows is hot
        monkeypatch.setattr(upsert, "is_broadcastable", lambda *_: False)
        monkeypatch.setattr(joins, "is_broadcastable", lambda *_: False)
        monkeypatch.setattr(joins.hot_keys, "__defaults__", (10,))
    table, changes = _rows(1, 300, False), _rows(2, 200, True)
    t, c = spark.createDataFrame(table, TABLE), spark.createDataFrame(changes, CHANGES)
    out = upsert.upsert(t, c, ["k", "s.n"], fields, ("seq",), keep, insert)
    assert out.schema.simpleString() == t.schema.simpleString()
    assert _got(out) == _merged(table, changes, fields, keep, insert)


def test_upsert_of_nothing(spark):
    t, c = spark.createDataFrame(_rows(1, 9, False), TABLE), spark.createDataFrame([], CHANGES)
    assert _got(upsert.upsert(t, c, ["k"])) == _got(t)
    some = spark.createDataFrame([("1", "p", "x", None, 1), ("1", "p", "x", None, 1)], CHANGES)
    assert _got(upsert.upsert(t.limit(0), some, ["k"])) == [(1, "p", "x", None, None)]
    for bad in ({"keys": []}, {"keys": ["seq"]}, {"keys": ["k"], "fields": ["c"]}, {"keys": ["k"], "fields": ["k"]}):
        with pytest.raises(ValueError):
            upsert.upsert(t, c, **bad)


def test_tables_in_folders(spark, tmp_path, monkeypatch):
    path, keys = str(tmp_path / "table"), ["k", "s.n"]
    table, first, second = _rows(1, 200, False), _rows(2, 15, True), _rows(3, 15, True)
    frames = [spark.createDataFrame(r, CHANGES) for r in (first, second)]
    with pytest.raises(FileNotFoundError):
        upsert.read_table(spark, path)
    assert upsert.create_table(spark.createDataFrame(table, TABLE), path, keys, parts=16) == 0
    with pytest.raises(RuntimeError):
        upsert.create_table(spark.createDataFrame(table, TABLE), path, keys, parts=16)
    assert _got(upsert.read_table(spark, path)) == sorted(table, key=repr)
    want = _merged(table, first, ["a", "b"], False, True)

    def lost(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):  # all rows written, not committed
        m.setattr(upsert, "_publish", lost)
        upsert.upsert_table(frames[0], path, order_by=("seq",))
    assert _got(upsert.read_table(spark, path)) == sorted(table, key=repr)
    assert upsert.upsert_table(frames[0], path, order_by=("seq",)) == 1
    assert _got(upsert.read_table(spark, path)) == want

    before = upsert._state(spark, path)
    assert upsert.upsert_table(frames[1], path, order_by=("seq",), fields=["b"]) == 2
    done = _merged(want, second, ["b"], False, True)
    assert _got(upsert.read_table(spark, path)) == done
    with monkeypatch.context() as m, pytest.raises(RuntimeError):  # a rival that began at version 1
        m.setattr(upsert, "_state", lambda *_: before)
        upsert.upsert_table(frames[0], path)
    assert _got(upsert.read_table(spark, path)) == done and _got(upsert.read_table(spark, path, 1)) == want
    assert upsert.upsert_table(frames[0].limit(0), path) == 2  # no changes, no version

    one = spark.createDataFrame([("5", "p", "new", "new", 1)], CHANGES)  # one key: one part is written anew
    old = upsert._state(spark, path)[1]["folders"]
    assert upsert.upsert_table(one, path) == 3
    new = upsert._state(spark, path)[1]["folders"]
    assert len([p for p in new if new[p] != old.get(p)]) == 1

"""Repeated passages across documents by difference-cover anchors.

A difference cover modulo ``PERIOD`` holds, for every shift of two matching
texts, a residue at which both are sampled together.  So hashing only the
short windows that start at cover positions (6 of every 31 words), any two
equal windows of ``length`` words share an aligned anchor inside them.
Anchors found in two documents are then extended: around them, and only
there, the full windows are hashed (128 bits) and the smallest document that
holds each one is found.

Both steps ask one question, "which of my keys do other documents hold?",
through a shuffle of packed key arrays: every work part sends each distinct
key once per key range, with the smallest document that has it, and gets back
those which are shared.  A passage in a third of all documents therefore
costs one entry per part, not one per occurrence.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, mix, ragged, slices, windows
from .shared import n_parts, ship, table

PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])  # every difference modulo 31 occurs
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
ENTRY = np.dtype([("key", "<u8"), ("check", "<u8"), ("doc", "<i8")])
_FEED = "part long, bucket long, key binary, check binary, doc binary"
_REPLY = "part long, key binary, check binary, doc binary"


def _valid(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of every ``n``-word window inside one document, and its document."""
    count = np.maximum(np.diff(words.doc) - n + 1, 0)
    which = np.repeat(np.arange(len(count)), count)
    return words.doc[which] + ragged(count), which


def _anchors(words: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, word positions and documents of the windows of ``n`` words that
    start at cover positions of their document."""
    at, which = _valid(words, n)
    take = _IN_COVER[(at - words.doc[which]) % PERIOD]
    at, which = at[take], which[take]
    return windows(h, n)[at], at, which


def _least_per_key(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, check) with their smallest document, and whether more
    than one entry had them."""
    e = e[np.lexsort((e["doc"], e["check"], e["key"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["check"][1:] != e["check"][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(e)) - 1 if len(e) else first
    return e[first], e["doc"][first] != e["doc"][last]


def _columns(e: np.ndarray, cuts: list[int]) -> list[pa.Array]:
    """Runs of entries as one byte string per field; zeros are left out."""
    return [pa.array([e[f][a:b].tobytes() if e[f][a:b].any() else b"" for a, b in zip(cuts, cuts[1:])], pa.binary())
            for f in ENTRY.names]


def _entries(block: pa.Table) -> list[np.ndarray]:
    """The inverse of ``_columns``: one array of entries per row."""
    out = []
    for row in zip(*(block.column(f).combine_chunks() for f in ENTRY.names)):
        raw = [np.frombuffer(v.as_buffer(), ENTRY[f]) for f, v in zip(ENTRY.names, row)]
        e = np.zeros(max(map(len, raw)), ENTRY)
        for f, v in zip(ENTRY.names, raw):
            if len(v):
                e[f] = v
        out.append(e)
    return out


def _packed(part: int, entries: np.ndarray, n_buckets: int):
    """Rows of one part's entries by key range; in a row the entries of a
    document are neighbours."""
    bucket = (entries["key"] >> np.uint64(32)) % np.uint64(n_buckets)
    order = np.lexsort((entries["doc"], bucket))
    entries, bucket = entries[order], bucket[order]
    names, first = np.unique(bucket, return_index=True)
    return pa.Table.from_arrays(
        [pa.array(np.full(len(names), part), pa.int64()), pa.array(names.astype(np.int64)),
         *_columns(entries, [*first.tolist(), len(bucket)])], names=["part", "bucket", *ENTRY.names])


def _local(entries: np.ndarray) -> np.ndarray:
    """What one part sends: each key once; one that several of its own
    documents hold is sent twice (smallest and another document)."""
    least, many = _least_per_key(entries)
    again = least[many].copy()
    again["doc"] += 1  # any larger number: only the smallest document counts
    return np.concatenate([least, again])


def _shared(keys_only: bool):
    """Of one key range: tell every part which of its keys more than one
    document holds, and the smallest of those documents.  With ``keys_only``
    the answer is the keys; without, a part whose one document is the
    smallest itself needs no answer."""
    def run(block: pa.Table) -> pa.Table:
        raw = _entries(block)
        owner = np.repeat(block.column("part").to_numpy(), [len(x) for x in raw])
        e = np.concatenate(raw)
        order = np.lexsort((e["doc"], e["check"], e["key"]))
        e, owner = e[order], owner[order]
        new = np.ones(len(e), bool)
        new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["check"][1:] != e["check"][:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(e)))
        answer = np.zeros(len(e), ENTRY)
        answer["key"] = e["key"]
        keep = np.repeat(size > 1, size)
        if not keys_only:
            answer["check"], answer["doc"] = e["check"], np.repeat(e["doc"][first], size)
            keep &= e["doc"] > answer["doc"]
        answer, owner = answer[keep], owner[keep]
        order = np.argsort(owner, kind="stable")
        answer, owner = answer[order], owner[order]
        names, at = np.unique(owner, return_index=True)
        return pa.Table.from_arrays([pa.array(names, pa.int64()), *_columns(answer, [*at.tolist(), len(owner)])],
                                    names=["part", *ENTRY.names])
    return run


def _answers(replies: pa.Table) -> np.ndarray:
    """A part's shared keys, sorted and distinct."""
    raw = _entries(replies) if replies.num_rows else []
    e = np.concatenate(raw) if raw else np.zeros(0, ENTRY)
    return _least_per_key(e)[0]


def _pieces(docs: pa.Table, nulls: bool = False):
    """(ids, words, their hashes) of runs of a part's documents; those with a
    null id only if asked for, with None for the ids."""
    docs = docs.combine_chunks()
    if docs.num_rows and not nulls:
        docs = docs.filter(docs.column("id").is_valid())
    if docs.num_rows:
        ids = None if nulls else docs.column("id").to_numpy()
        for i, j, words in slices(docs.column("text")):
            yield None if nulls else ids[i:j], words, words.hashes()


def _ask_anchors(length: int, n_buckets: int):
    short = length - PERIOD + 1

    def run(docs: pa.Table) -> pa.Table:
        part, found = docs.column("part")[0].as_py(), []
        for ids, words, h in _pieces(docs):
            key, _, which = _anchors(words, h, short)
            e = np.zeros(len(key), ENTRY)
            e["key"], e["doc"] = key, ids[which]
            found.append(_local(e))
        return _packed(part, _local(np.concatenate(found) if found else np.zeros(0, ENTRY)), n_buckets)
    return run


def _full_windows(words: Words, h: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return windows(h, length)[at], windows(mix(h ^ np.uint64(0x5851F42D4C957F2D)), length, 0xA0761D6478BD642F)[at]


def _ask_windows(length: int, n_buckets: int):
    short = length - PERIOD + 1

    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        shared, found = np.unique(_answers(replies)["key"]), []
        if docs.num_rows and len(shared):
            for ids, words, h in _pieces(docs):
                anchor, at, _ = _anchors(words, h, short)
                hit = np.searchsorted(shared, anchor)
                hit[hit == len(shared)] = 0
                at = at[shared[hit] == anchor]
                near = np.zeros(len(h) + 1, np.int64)  # windows that hold a shared anchor
                np.add.at(near, np.maximum(at - (length - short), 0), 1)
                np.add.at(near, at + 1, -1)
                start, which = _valid(words, length)
                take = np.cumsum(near)[start] > 0
                start, which = start[take], which[take]
                e = np.zeros(len(start), ENTRY)
                e["key"], e["check"] = _full_windows(words, h, length, start)
                e["doc"] = ids[which]
                found.append(_local(e))
        return _packed(key[0].as_py(), _local(np.concatenate(found) if found else np.zeros(0, ENTRY)), n_buckets)
    return run


def _covered(ids: np.ndarray, words: Words, h: np.ndarray, length: int, known: np.ndarray) -> np.ndarray:
    """For each word, whether a window over it also starts in a smaller document."""
    gone = np.zeros(len(h) + 1, np.int64)
    start, which = _valid(words, length)
    if len(start) and len(known):
        key, check = _full_windows(words, h, length, start)
        hit = np.searchsorted(known["key"], key)
        hit[hit == len(known)] = 0
        same = known["key"][hit] == key
        start, which, key, check, hit = (x[same] for x in (start, which, key, check, hit))
        # keys that collide are neighbours in ``known``: step on until the check agrees
        while len(off := np.flatnonzero(known["check"][hit] != check)):
            nxt = np.minimum(hit[off] + 1, len(known) - 1)
            ok = (nxt > hit[off]) & (known["key"][nxt] == key[off])
            hit[off] = nxt
            if not ok.all():
                drop = np.ones(len(hit), bool)
                drop[off[~ok]] = False
                start, which, key, check, hit = (x[drop] for x in (start, which, key, check, hit))
        start = start[known["doc"][hit] < ids[which]]
        np.add.at(gone, start, 1)
        np.add.at(gone, start + length, -1)
    return np.cumsum(gone)[:len(h)] > 0


def _finish(length: int, with_text: bool):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        known, docs = _answers(replies), docs.combine_chunks()
        valid = np.asarray(docs.column("id").is_valid()) if docs.num_rows else np.zeros(0, bool)
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        lone = docs.filter(pa.array(~valid))
        for ids, words, h in itertools.chain(_pieces(docs), _pieces(lone, nulls=True)):
            gone = np.zeros(len(h), bool) if ids is None else _covered(ids, words, h, length, known)
            data = words.data.tobytes()
            for d in range(len(words.bounds) - 1):
                a, b = words.doc[d], words.doc[d + 1]
                text = data[words.bounds[d]:words.bounds[d + 1]]
                kept, n_gone = text.split(), int(gone[a:b].sum())
                if n_gone:
                    kept = [w for w, g in zip(kept, gone[a:b]) if not g]
                left = (_cut_out(data, words, gone, d) if n_gone else text).decode() if with_text else ""
                sha = hashlib.sha256(b" ".join(kept)).hexdigest()
                for column, v in zip(out.values(), (int(b - a), n_gone, sha, left)):
                    column.append(v)
        carried = docs.take(pa.array(np.concatenate([np.flatnonzero(valid), np.flatnonzero(~valid)]))) \
            .drop_columns(["part", "text"])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.Table.from_arrays([*carried.columns, *(pa.array(c, k) for c, k in zip(out.values(), kinds))],
                                    names=[*carried.column_names, *out])
    return run


def _cut_out(data: bytes, words: Words, gone: np.ndarray, d: int) -> bytes:
    """The document's text without its covered words; white space between
    kept words stays, a removed run leaves the white space before it."""
    a, b = words.doc[d], words.doc[d + 1]
    out, at = [], int(words.bounds[d])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
    for first, end in zip(edge[::2], edge[1::2]):
        out.append(data[at:words.start[a + first]])
        at = int(words.start[a + end]) if a + end < b else int(words.bounds[d + 1])
    return b"".join([*out, data[at:words.bounds[d + 1]]])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                      with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: id, the columns ``carry``, n_words, n_removed,
    kept_sha256 (kept words joined by one space) and kept_text (empty unless
    ``with_text``).

    A word goes if a window of ``length`` words over it also starts in a
    document with a smaller id; windows are judged on the input.  Null and
    empty texts have no words; texts shorter than ``length`` keep all; a
    repeated id is one document, its rows do not remove each other's words; a
    null id neither removes nor loses words; an empty table gives no rows.
    ``length`` must be above 31.  Columns of ``docs``
    besides are not read; carried columns may have any name.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be over {PERIOD}")
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0]
    parts = n_parts(size, each=4 << 20)
    names = [f"carried_{i}" for i in range(len(carry))]
    docs = docs.select(
        # rows without id concern nobody else: spread by their text
        F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(F.col(id_col).cast("long"))),
               F.lit(parts)).alias("part"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
        *[docs[c].alias(n) for c, n in zip(carry, names)])
    plain = docs.select("part", "id", "text").groupBy("part")
    by_part = docs.groupBy("part")
    asked = plain.applyInArrow(_ask_anchors(length, parts), _FEED)
    shared = asked.groupBy("bucket").applyInArrow(_shared(True), _REPLY)
    asked = plain.cogroup(shared.groupBy("part")).applyInArrow(_ask_windows(length, parts), _FEED)
    shared = asked.groupBy("bucket").applyInArrow(_shared(False), _REPLY)
    fields = docs.drop("part", "text").schema
    for c, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("kept_text", "string")):
        fields = fields.add(c, kind)
    out = by_part.cogroup(shared.groupBy("part")).applyInArrow(_finish(length, with_text), fields)
    return out.toDF(id_col, *carry, "n_words", "n_removed", "kept_sha256", "kept_text")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: windows of 50 words over all documents."""
    return repeated_passages(table(spark, sf_dir, "documents"), with_text=False) \
        .select("doc_id", "n_words", "n_removed", "kept_sha256")

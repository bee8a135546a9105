"""Repeated byte strings by distributed prefix doubling.

Prefix doubling gives every position the rank of the string of h symbols that
starts there, and gets the rank for 2h by sorting the pairs (rank here, rank h
further on).  Positions whose rank is unique drop out: no longer string from
there repeats.  Here the symbols are the phrases between content-defined
positions (anchors: where the hash of ``GRAM`` bytes is the least of ``w``
neighbours), so one position in about ``w / 2`` takes part.  ``w`` is chosen so
that every string of ``length`` bytes holds five equal phrases wherever it
occurs: doubling past four would pass the threshold.

Sorting is Spark's: every work part sends its distinct keys (one entry for a
key it holds once, two for more) to key ranges, each range sorts them, numbers
those with two entries or more and answers the parts that hold them.  A string
in a third of all documents costs two entries a part.

Ranks only choose candidates; bytes are judged by 96 bits and more of hash
over whole strings.  Candidate strings that share their first anchor are one
block, judged as one string (block and ``length`` bytes); where a block is
found nowhere else, its strings are judged one by one, against those of one
block for every repeated key.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, ragged, text_bytes
from .shared import Scratch, n_parts, ship, table

GRAM = 12
ROUNDS = (1, 2)  # offsets in phrases: ranks of 1, 2, then 4 phrases
RUN_BYTES = 1 << 20
PART_BYTES = 8 << 20
SALTS = 32
RANGE_KEYS = 1 << 19  # keys that one range sorts, about
_U = np.uint64
_ASK = "part long, range long, a binary, b binary"
_KNOWN = "part long, kind string, range long, d1 long, d2 long, a binary, b binary"


def _slide(op, a: np.ndarray, w: int) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``w`` neighbours."""
    size = 1
    while 2 * size <= w:
        a, size = op(a[:-size], a[size:]), 2 * size
    return op(a[:len(a) - (w - size)], a[w - size:]) if size < w else a


def _fingerprints(grams: np.ndarray, start: np.ndarray, size: np.ndarray, *bases: int) -> list[np.ndarray]:
    """Hashes of the ``size`` bytes from ``start``, from every ``GRAM``-th gram
    and the last; one per base."""
    out = [size.astype(_U) for _ in bases]
    last = size - GRAM
    least = int(last.min()) if len(last) else 0
    for step in range(0, int(last.max(initial=0)) + GRAM, GRAM):
        gram = grams[start + (step if step <= least else np.minimum(step, last))]
        for i, base in enumerate(bases):
            longer = out[i] * _U(base)
            longer += gram
            out[i] = longer if step < least + GRAM else np.where(step < last + GRAM, longer, out[i])
    return [mix(x) for x in out]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at every place (8 bytes and the next 4)."""
    n = max(0, len(data) - GRAM + 1)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((n,), "<u8", data, 0, (1,)) * _U(0x9FB21C651E98DF25)
    eight += np.ndarray((n,), "<u4", data, 8, (1,)) * _U(0xC2B2AE3D27D4EB4F) if n else eight
    return mix(eight)


def _distinct(key: np.ndarray, check: np.ndarray):
    """First places, inverse and counts of the distinct (key, check), in order."""
    order = np.lexsort((check, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at, np.diff(np.append(np.flatnonzero(new), len(order)))


class _Run:
    """Anchors of consecutive texts: ``at`` (byte), ``doc``, ``nth`` in the text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, w: int):
        self.data, self.bounds, self.w = data, bounds, w
        self.grams = _grams(data)
        self.weight = (self.grams >> _U(32)).astype(np.uint32)
        self.least = _slide(np.minimum, self.weight, w)
        for k in range(1, GRAM + w - 1):  # neighbours across texts choose nothing: a text's anchors are its own
            self.least[bounds[1:-1] - k] = 0
        edge = np.zeros(w - 1, np.uint32)
        chosen = _slide(np.maximum, np.concatenate([edge, self.least, edge]), w) == self.weight
        self.before = np.concatenate([[0], np.cumsum(chosen)])
        self.at = np.flatnonzero(chosen)
        self.doc = np.searchsorted(bounds, self.at, "right") - 1
        self.nth = np.arange(len(self.at)) - self.before[bounds[self.doc]]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors that begin a phrase, and its hash."""
        i = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        return i, _fingerprints(self.grams, self.at[i], self.at[i + 1] - self.at[i] + GRAM, 0x9E3779B97F4A7C15)[0]

    def blocks(self, live: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the runs of strings of ``length`` bytes whose
        phrases are all live (``live``: by anchor, its rank of four phrases is
        shared) and which have the same first anchor."""
        near = np.zeros(len(self.data) + 1, np.int32)  # strings whose first anchor may be live
        at = self.at[live]
        np.add.at(near, np.maximum(at - self.w + 1, self.bounds[self.doc[live]]), 1)
        np.add.at(near, at + 1, -1)
        p = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        p = p[p + length <= self.bounds[np.searchsorted(self.bounds, p, "right")]]
        if not len(p):
            return p, p
        first = self._to(self.before[p], self.least[p], 1)
        q = p + length - GRAM
        last = self._to(self.before[q + 1] - 1, self.least[q - self.w + 1], -1)
        dead = np.concatenate([[0], np.cumsum(~live)])
        ok = dead[last - 3] == dead[first]
        p, first = p[ok], first[ok]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(first) != 0)])) if len(p) else p
        return p[new], p[np.append(new[1:], len(p)) - 1] if len(p) else p

    def _to(self, j: np.ndarray, least: np.ndarray, step: int) -> np.ndarray:
        """From anchor ``j`` on, the first that has the weight ``least``."""
        weight = self.weight[self.at]
        off = np.flatnonzero(weight[j] != least)
        while len(off):
            j[off] += step
            off = off[weight[j[off]] != least[off]]
        return j


def _texts(block: pa.Table, width: int, wanted: set | None = None):
    """(digests, run) of a part's distinct texts in digest order."""
    block = block.combine_chunks()
    d1, d2 = (block.column(c).to_numpy() for c in ("d1", "d2"))
    order = np.lexsort((d2, d1))
    order = order[np.concatenate([[True], (np.diff(d1[order]) != 0) | (np.diff(d2[order]) != 0)])] if len(order) else order
    body, inflate = block.column("body"), zstandard.ZstdDecompressor().decompress
    digests, raw, size = [], [], 0

    def run():
        bounds = np.cumsum([0, *map(len, raw)])
        return digests, _Run(np.frombuffer(b"".join(raw), np.uint8), bounds, width)

    for i in order:
        if wanted is not None and (d1[i], d2[i]) not in wanted:
            continue
        digests.append((int(d1[i]), int(d2[i])))
        raw.append(inflate(body[int(i)].as_py()))
        size += len(raw[-1])
        if size >= RUN_BYTES:
            yield run()
            digests, raw, size = [], [], 0
    if raw:
        yield run()


def _in_ranges(high: np.ndarray, n: int) -> np.ndarray:
    """Range of each 64-bit key, by its upper half."""
    return ((high >> _U(32)) * _U(n)) >> _U(32)


def _rows(part: int, ranges: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row per range, of entries that are ordered by range."""
    names, first = np.unique(ranges, return_index=True)
    cuts = [*first.tolist(), len(ranges)]
    packed = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in columns]
    packed += [pa.array([b""] * len(names), pa.binary())] * (2 - len(packed))
    return pa.Table.from_arrays([pa.array(np.full(len(names), part, np.int64)), pa.array(names.astype(np.int64)), *packed],
                                names=["part", "range", "a", "b"])


def _place(keys: np.ndarray, n: int) -> np.ndarray:
    """Range and the key's lower half as one number.  Within a range half a
    key is enough: a chance match costs a candidate, no result."""
    return (_in_ranges(keys, n) << _U(32)) | (keys & _U(0xFFFFFFFF))


def _ask_ranks(part: int, keys: np.ndarray, n: int) -> pa.Table:
    found, count = np.unique(_place(keys, n), return_counts=True)
    found = np.sort(np.concatenate([found, found[count > 1]]))
    return _rows(part, found >> _U(32), found.astype(np.uint32))


def _known(part, kind: str, **columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    kinds = {"range": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "a": pa.binary(), "b": pa.binary()}
    rest = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()]
    part = pa.array(part if isinstance(part, list) else [part] * n, pa.int64())
    return pa.Table.from_arrays([part, pa.array([kind] * n, pa.string()), *rest], names=["part", "kind", *kinds])


def _rank(block: pa.Table) -> pa.Table:
    """Of one range: number the keys with two entries or more, in key order,
    and tell every part the numbers of its keys."""
    raw = [np.frombuffer(v.as_py(), np.uint32) for v in block.column("a")]
    owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    keys = np.concatenate(raw)
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1).astype(np.uint32)
    keep = count[at] > 1
    keep[1:] &= (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner, number = keys[keep], owner[keep], number[at[keep]]
    cuts = np.searchsorted(owner, np.arange(len(raw) + 1))
    some = [(p, a, b) for p, a, b in zip(block.column("part").to_pylist(), cuts, cuts[1:]) if b > a]
    return _known([p for p, _, _ in some], "rank", range=[block.column("range")[0].as_py()] * len(some),
                  a=[keys[a:b].tobytes() for _, a, b in some], b=[number[a:b].tobytes() for _, a, b in some])


class _Ranks:
    """The answers of ``_rank`` to one part."""

    def __init__(self, replies: pa.Table):
        rows = list(zip(*(replies.column(c).to_pylist() for c in ("range", "a", "b"))))
        self.keys, self.ranks = (
            np.concatenate([np.zeros(0, _U), *(_U(row[0] << 32) | np.frombuffer(row[c], np.uint32) for row in rows)])
            for c in (1, 2))
        order = np.argsort(self.keys)
        self.keys, self.ranks = self.keys[order], self.ranks[order]

    def of(self, places: np.ndarray) -> np.ndarray:
        """Rank of each place; 0 if its key is unique."""
        if not len(self.keys):
            return np.zeros(len(places), _U)
        at = np.minimum(np.searchsorted(self.keys, places), len(self.keys) - 1)
        return np.where(self.keys[at] == places, self.ranks[at], _U(0))


def _state(part: int, digests: list, doc: np.ndarray, nth: np.ndarray, rank: np.ndarray) -> pa.Table:
    """Live positions, one row a text."""
    cuts = np.searchsorted(doc, np.arange(len(digests) + 1))
    some = [(d, a, b) for d, a, b in zip(digests, cuts, cuts[1:]) if b > a]
    nth, rank = nth.astype(np.int32), rank.astype(_U)
    return _known(part, "state", d1=[d[0] for d, _, _ in some], d2=[d[1] for d, _, _ in some],
                  a=[nth[a:b].tobytes() for _, a, b in some], b=[rank[a:b].tobytes() for _, a, b in some])


def _ask_phrases(width: int, n: int):
    def run(docs: pa.Table) -> pa.Table:
        keys = [r.phrases()[1] for _, r in _texts(docs, width)]
        return _ask_ranks(docs.column("part")[0].as_py(), np.concatenate(keys) if keys else np.zeros(0, _U), n)
    return run


def _rank_phrases(width: int, n: int):
    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        ranks, out = _Ranks(replies), [_known(0, "state", a=[])]
        for digests, r in _texts(docs, width):
            i, h = r.phrases()
            rank = ranks.of(_place(h, n))
            i, rank = i[rank > 0], rank[rank > 0]
            out.append(_state(key[0].as_py(), digests, r.doc[i], r.nth[i], rank))
        return pa.concat_tables(out)
    return run


def _pairs(state: pa.Table, offset: int):
    """(digests, doc, nth, key of (rank here, rank ``offset`` further on)) of
    the positions where both are live; texts in digest order."""
    digests, rows = _by_text(state)
    doc = np.repeat(np.arange(len(rows)), [len(n) for n, _ in rows])
    nth = np.concatenate([n for n, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    rank = np.concatenate([r for _, r in rows]) if rows else np.zeros(0, _U)
    where = (doc << 40) | nth
    at = np.minimum(np.searchsorted(where, where + offset), max(0, len(where) - 1))
    ok = where[at] == where + offset
    key = mix(mix(rank[ok] + _U(offset)) * _U(0x9E3779B97F4A7C15) + rank[at[ok]])
    return digests, doc[ok], nth[ok], key


def _by_text(state: pa.Table):
    rows = sorted(zip(*(state.column(c).to_pylist() for c in ("d1", "d2", "a", "b"))), key=lambda r: r[:2])
    return [r[:2] for r in rows], [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], _U)) for r in rows]


def _ask_pairs(offset: int, n: int):
    def run(state: pa.Table) -> pa.Table:
        return _ask_ranks(state.column("part")[0].as_py(), _pairs(state, offset)[3], n)
    return run


def _rank_pairs(offset: int, n: int):
    def run(key, state: pa.Table, replies: pa.Table) -> pa.Table:
        digests, doc, nth, pair = _pairs(state, offset)
        rank = _Ranks(replies).of(_place(pair, n))
        live = rank > 0
        return _state(key[0].as_py(), digests, doc[live], nth[live], rank[live])
    return run


class _Blocks:
    """Candidate strings of a part, from its texts and what is known of it."""

    def __init__(self, docs: pa.Table, known: pa.Table, length: int, width: int, n: int):
        self.length, self.n = length, n
        kinds = {k: known.filter(pc.equal(known.column("kind"), k)) for k in ("state", "block", "string")}
        digests, rows = _by_text(kinds["state"])
        live = dict(zip(digests, rows))
        self.runs, self.grams, keys = [], [], []
        for digests, r in _texts(docs, width, set(live)):
            on = np.zeros(len(r.at), bool)
            for d, digest in enumerate(digests):
                on[r.before[r.bounds[d]] + live[digest][0]] = True
            lo, hi = r.blocks(on, length)
            self.runs.append((digests, r.data, r.bounds, lo, hi))
            keys.append(self._keys(r.grams, lo, hi - lo + length))
            self.grams.append(r.grams)
        first, self.at, self.count, self.found = self._found(keys)
        self.speaks = np.zeros(len(self.at), bool)
        self.speaks[first] = True
        self.verdict = self._answer(kinds["block"])
        self.replies = kinds["string"]

    @staticmethod
    def _keys(grams, start, size) -> list[np.ndarray]:
        return _fingerprints(grams, start, size, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

    @staticmethod
    def _found(keys: list, bits: int = 64):
        """First places, inverse, counts and columns of the distinct keys."""
        key, check = (np.concatenate([np.zeros(0, _U), *(k[c] for k in keys)]) for c in (0, 1))
        check >>= _U(64 - bits)
        first, at, count = _distinct(key, check)
        return first, at, count, (key[first], check[first])

    @staticmethod
    def _answer(replies: pa.Table) -> np.ndarray:
        """One byte per distinct key, in the order of the question."""
        rows = sorted(zip(replies.column("range").to_pylist(), replies.column("a").to_pylist()))
        return np.frombuffer(b"".join(a for _, a in rows), np.uint8)

    def ask(self, part: int) -> pa.Table:
        return _ask_keys(part, self.found, self.count, self.n)

    def strings(self):
        """Per run the strings to judge one by one (start, and whether they
        only answer for their like), and the distinct keys of all."""
        out, keys, at = [], [], 0
        for (_, _, _, lo, hi), grams in zip(self.runs, self.grams):
            v = self.verdict[self.at[at:at + len(lo)]] if len(lo) else np.zeros(0, np.uint8)
            take = (v == 0) | ((v == 2) & self.speaks[at:at + len(lo)])
            size = (hi - lo + 1)[take]
            p = np.repeat(lo[take], size) + ragged(size)
            out.append((p, np.repeat(v[take] == 0, size), v))
            keys.append(self._keys(grams, p, np.full(len(p), self.length)))
            at += len(lo)
        return out, self._found(keys, 32)


def _ask_keys(part: int, found: tuple, count: np.ndarray, n: int, check=np.uint64) -> pa.Table:
    """Distinct keys in order; the last byte string tells by one bit a key
    whether the part holds it more than once."""
    ranges = _in_ranges(found[0], n)
    names, first = np.unique(ranges, return_index=True)
    cuts = [*first.tolist(), len(ranges)]
    many = count > 1
    a = [found[0][i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
    b = [found[1][i:j].astype(check).tobytes() + np.packbits(many[i:j]).tobytes() for i, j in zip(cuts, cuts[1:])]
    return pa.Table.from_arrays([pa.array(np.full(len(names), part, np.int64)), pa.array(names.astype(np.int64)),
                                 pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["part", "range", "a", "b"])


def _judge(kind: str, check):
    """Of one range: per part and key 0 (found once in all), 1 (found again) or
    2 (found again, and this part speaks for all)."""
    wide = np.dtype(check).itemsize

    def run(block: pa.Table) -> pa.Table:
        parts = block.column("part").to_pylist()
        key, test, many = [], [], []
        for a, b in zip(block.column("a").to_pylist(), block.column("b").to_pylist()):
            k = np.frombuffer(a, "<u8")
            key.append(k)
            test.append(np.frombuffer(b, check, len(k)).astype(_U))
            many.append(np.unpackbits(np.frombuffer(b, np.uint8, offset=wide * len(k)), count=len(k)).astype(np.int64))
        size = [len(k) for k in key]
        key, test, many = np.concatenate(key), np.concatenate(test), np.concatenate(many)
        owner = np.repeat(np.array(parts), size)
        order = np.lexsort((owner, test, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (test[order][1:] != test[order][:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        again = np.add.reduceat(many[order] + 1, first)[group] > 1
        verdict = np.empty(len(order), np.uint8)
        verdict[order] = again.astype(np.uint8) + (again & new)
        cuts = np.concatenate([[0], np.cumsum(size)])
        return _known(parts, kind, range=[block.column("range")[0].as_py()] * len(parts),
                      a=[verdict[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])
    return run


def _ask_blocks(length: int, width: int, n: int):
    def run(key, docs: pa.Table, known: pa.Table) -> pa.Table:
        return _Blocks(docs, known, length, width, n).ask(key[0].as_py())
    return run


def _ask_strings(length: int, width: int, n: int):
    def run(key, docs: pa.Table, known: pa.Table) -> pa.Table:
        _, (_, _, count, found) = _Blocks(docs, known, length, width, n).strings()
        return _ask_keys(key[0].as_py(), found, count, n, np.uint32)
    return run


def _cut(length: int, width: int, n: int, with_text: bool):
    def run(key, docs: pa.Table, known: pa.Table) -> pa.Table:
        blocks = _Blocks(docs, known, length, width, n)
        strings, (_, at, _, _) = blocks.strings()
        again = blocks._answer(blocks.replies)
        out, done = {c: [] for c in ("d1", "d2", "n_removed", "kept_sha256", "spans", "kept")}, 0
        for (digests, data, bounds, lo, hi), (p, alone, v) in zip(blocks.runs, strings):
            gone = np.zeros(len(data) + 1, np.int32)
            sure = v > 0
            np.add.at(gone, lo[sure], 1)
            np.add.at(gone, hi[sure] + length, -1)
            if len(p):
                hit = p[alone & (again[at[done:done + len(p)]] > 0)]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + length, -1)
            done += len(p)
            gone = np.cumsum(gone[:-1]) > 0
            for d, digest in enumerate(digests):
                mask = gone[bounds[d]:bounds[d + 1]]
                if mask.any():
                    kept = data[bounds[d]:bounds[d + 1]][~mask].tobytes()
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    spans = [{"begin": b, "end": e} for b, e in edge.reshape(-1, 2).tolist()]
                    for c, x in zip(out, (*digest, int(mask.sum()), hashlib.sha256(kept).hexdigest(), spans,
                                          kept if with_text else None)):
                        out[c].append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds)], names=list(out))
    return run


def _digest(raw: bytes) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(raw), "<i8")
    return int(a), int(b)


def _raw(column: pa.Array):
    data, bounds = text_bytes(column)
    return (data[a:b].tobytes() for a, b in zip(bounds, bounds[1:]))


def _describe(batches):
    """Replaces the text by its digest, length and SHA-256."""
    for batch in batches:
        found = [(*_digest(raw), len(raw), hashlib.sha256(raw).hexdigest()) for raw in _raw(batch.column("text"))]
        columns = list(zip(*found)) if found else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
            names=[*batch.schema.names[:-1], "d1", "d2", "n_bytes", "sha"])


def _first_copies(parts: int, length: int):
    """Compressed texts of at least ``length`` bytes, copies in one task once."""
    def run(batches):
        seen, press = set(), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = []
            for raw in _raw(batch.column(0)):
                if len(raw) >= length and (digest := _digest(raw)) not in seen:
                    seen.add(digest)
                    rows.append((digest[0] % parts, *digest, press(raw)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)],
                                             names=["part", "d1", "d2", "body"])
    return run


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                        with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans
    (begin and end of every removed run) and kept (binary: the bytes left,
    which need not be UTF-8; null unless ``with_text``).

    A byte goes if a string of ``length`` bytes over it (of the text in UTF-8)
    also starts anywhere else, in the same row or another, repeated rows and
    rows without id included; strings do not cross rows and are judged on the
    input.  Null and empty texts have no bytes; shorter ones stay whole; an
    empty table gives no rows; other columns are not read.  ``length`` must be
    64 or more.
    """
    if length < 64:
        raise ValueError("length must be 64 or more")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffixes")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    width = (length - GRAM) // 6
    carried = [F.col("text").cast("binary").alias("whole")] if with_text else []
    rows = scratch.write(docs.select("id", *carried, "text").mapInArrow(
        _describe, "id long, " + ("whole binary, " if with_text else "") + "d1 long, d2 long, n_bytes long, sha string"), "rows")
    copied = rows.where(F.col("n_bytes") >= length).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"),
                                                                            F.max("n_bytes").alias("size"))
    size = copied.agg(F.sum("size")).first()[0] or 0
    parts = n_parts(size, PART_BYTES)
    n = max(16, math.ceil(2 * size / width / RANGE_KEYS))
    texts = docs.select("text").mapInArrow(_first_copies(parts, length), "part long, d1 long, d2 long, body binary")

    # ranks of one phrase, then doubling
    by_part = texts.groupBy("part")
    ranked = by_part.applyInArrow(_ask_phrases(width, n), _ASK).groupBy("range").applyInArrow(_rank, _KNOWN)
    state = scratch.write(by_part.cogroup(ranked.groupBy("part")).applyInArrow(_rank_phrases(width, n), _KNOWN), "ranks-1")
    for offset in ROUNDS:
        by_part = state.groupBy("part")
        ranked = by_part.applyInArrow(_ask_pairs(offset, n), _ASK).groupBy("range").applyInArrow(_rank, _KNOWN)
        longer = scratch.write(by_part.cogroup(ranked.groupBy("part")).applyInArrow(_rank_pairs(offset, n), _KNOWN),
                               f"ranks-{2 * offset}")
        scratch.drop(state)
        state = longer

    # texts with candidates: blocks, then single strings
    by_part = texts.join(state.select("d1", "d2"), ["d1", "d2"], "left_semi").select("part", "d1", "d2", "body").groupBy("part")
    judged = by_part.cogroup(state.groupBy("part")).applyInArrow(_ask_blocks(length, width, n), _ASK) \
        .groupBy("range").applyInArrow(_judge("block", np.uint64), _KNOWN)
    known = state.union(judged)
    judged = by_part.cogroup(known.groupBy("part")).applyInArrow(_ask_strings(length, width, n), _ASK) \
        .groupBy("range").applyInArrow(_judge("string", np.uint32), _KNOWN)
    cut = by_part.cogroup(known.union(judged).groupBy("part")).applyInArrow(
        _cut(length, width, n, with_text), "d1 long, d2 long, n_removed long, kept_sha256 string, "
                                           "spans array<struct<begin:long,end:long>>, kept binary")
    cut = scratch.write(cut, "cut")
    # rows whose text occurs again go whole; a text in many rows is split by the task that reads them
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    twice = copied.where("copies > 1").select("d1", "d2", F.lit(True).alias("twice"), salt)
    rows = rows.withColumn("salt", F.spark_partition_id() % SALTS).join(twice, ["d1", "d2", "salt"], "left")
    end = F.col("n_bytes").alias("end")
    whole = rows.where("twice").select(
        "id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"),
        F.array(F.struct(F.lit(0).cast("long").alias("begin"), end)).alias("spans"),
        (F.lit(b"") if with_text else F.lit(None).cast("binary")).alias("kept"))
    nothing = F.expr("cast(array() as array<struct<begin:long,end:long>>)")
    rest = rows.where("twice is null").join(cut, ["d1", "d2"], "left").select(
        "id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", nothing).alias("spans"),
        (F.coalesce("kept", "whole", F.lit(b"")) if with_text else F.col("kept")).alias("kept"))
    return whole.unionByName(rest).select(F.col("id").alias(id_col), "n_bytes", "n_removed",
                                          F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans", "kept")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: strings of 200 bytes over all documents."""
    return repeated_substrings(table(spark, sf_dir, "documents"), with_text=False) \
        .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

"""URL rules and block lists in a sorted digest array.

A list of strings becomes one file: the sorted 64-bit xxhash keys, the place
and length of each stored string, a value, and the strings themselves.  Tasks
memory-map the file (Spark hands it to every executor), probe a whole batch of
candidate strings with one vectorised binary search, and compare the stored
string before a hit counts, so a hash collision never decides.

A rule string is a host and a path prefix (``example.org/es/``); a block-list
entry may be a bare host.  Candidates of a url are its host's label suffixes
times its path prefixes of the lengths that occur in the list.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
BLOCKED_SITES = tuple(f"{name}.example.{zone}" for name in (
    "ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org"))


def digest_file(path: str, entries: dict[str, int]) -> None:
    """Write the sorted digest array of ``entries`` (string -> small value)."""
    raw = [(xxhash.xxh64_intdigest(b), b, v) for s, v in entries.items() for b in (s.encode(),)]
    raw.sort()
    size = np.array([len(b) for _, b, _ in raw], "<u8")
    place = np.cumsum(size, dtype="<u8") - size
    with open(path, "wb") as f:
        f.write(np.array([len(raw)], "<u8").tobytes())
        f.write(np.array([k for k, _, _ in raw], "<u8").tobytes() + place.tobytes() + size.tobytes())
        f.write(np.array([v for _, _, v in raw], "<u8").tobytes() + b"".join(b for _, b, _ in raw))


class DigestArray:
    """The memory-mapped file of ``digest_file``."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, "<u8", 1)[0])
        table_ = np.memmap(path, "<u8", "r", 8, (4, n)) if n else np.zeros((4, 0), np.uint64)
        self.keys, self.place, self.size, self.value = table_
        self.blob = np.memmap(path, np.uint8, "r", 8 + 32 * n) if n else np.zeros(0, np.uint8)

    def _holds(self, i: int, s: bytes) -> bool:
        a = int(self.place[i])
        return int(self.size[i]) == len(s) and self.blob[a:a + len(s)].tobytes() == s

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Index of each string in the array, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not strings or not len(self.keys):
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, keys)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == keys[k]:  # equal keys are neighbours
                if self._holds(i, strings[k]):
                    out[k] = i
                    break
                i += 1
        return out

    def string(self, i: int) -> str:
        a = int(self.place[i])
        return self.blob[a:a + int(self.size[i])].tobytes().decode()


class RuleSet:
    """A digest array with the shapes of its entries, to bound the candidates."""

    def __init__(self, path: str, shape: tuple[int, tuple[int, ...]]):
        self.array, (self.labels, self.lengths) = DigestArray(path), shape

    def match(self, hosts: list[str], paths: list[str]) -> list[int]:
        """Index of the longest fitting entry of each url (longer host part on
        equal length), or -1."""
        flat, owner = [], []
        for r, (host, path) in enumerate(zip(hosts, paths)):
            heads = [path[:n] for n in self.lengths if n <= len(path)]
            at, parts = len(host), []
            for _ in range(self.labels):
                at = host.rfind(".", 0, at) if at > 0 else -1
                parts.append(host[at + 1:])
                if at < 0:
                    break
            found = sorted(((len(p) + len(h), len(p), p + h) for p in parts for h in heads), reverse=True)
            flat += [c[2].encode() for c in found]
            owner += [r] * len(found)
        best = [-1] * len(hosts)
        hit = self.array.find(flat)
        for k in np.flatnonzero(hit >= 0)[::-1]:  # the first, longest candidate is set last
            best[owner[k]] = int(hit[k])
        return best


def _shape(entries) -> tuple[int, tuple[int, ...]]:
    hosts = [e.split("/", 1)[0] for e in entries]
    return (max((h.count(".") + 1 for h in hosts), default=0),
            tuple(sorted({len(e) - len(h) for e, h in zip(entries, hosts)})))


_OPEN: dict[str, RuleSet] = {}


def _rule_set(name: str, shape) -> RuleSet:
    if name not in _OPEN:
        _OPEN[name] = RuleSet(SparkFiles.get(name), shape)
    return _OPEN[name]


def _distributed(spark: SparkSession, entries: dict[str, int]):
    """Hand the digest array of ``entries`` to all executors."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="fieldmill-"), name)
    digest_file(path, entries)
    spark.sparkContext.addFile(path)
    return name, _shape(entries)


def url_parts(url) -> tuple:
    """Host and path columns of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               blocked=BLOCKED_SITES) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, verdict.

    ``rules`` are (host and path prefix, verdict): a rule fits its host and all
    subdomains where the path starts with its own; the longest wins, on equal
    length the one with the longer host.  Without a rule, a url whose host
    (or a parent of it) and path prefix are on the ``blocked`` list is blocked,
    any other allowed.  A null url, or one without ``://``, has an empty host
    and path, fits nothing and is allowed.  Repeated rows and null ids are
    judged like any other; an empty table gives no rows; other columns are not
    read.  The lists are arguments, held by the driver; the table is not.
    """
    spark = pages.sparkSession
    ship(spark)
    verdicts = ("allow", "block")
    rule_file = _distributed(spark, {r: verdicts.index(v) for r, v in rules})
    block_file = _distributed(spark, dict.fromkeys(blocked, 1))
    host, path = url_parts(F.col(url_col))

    def probe(batches):
        ruled, listed = _rule_set(*rule_file), _rule_set(*block_file)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            best, bad = ruled.match(hosts, paths), listed.match(hosts, paths)
            names = [ruled.array.string(i) if i >= 0 else None for i in best]
            verdict = [verdicts[int(ruled.array.value[i])] if i >= 0 else verdicts[b >= 0]
                       for i, b in zip(best, bad)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(names, pa.string()),
                 pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path")).mapInArrow(
        probe, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def op1_url_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every url of pages against the contract's rules and the block list."""
    return judge_urls(table(spark, sf_dir, "pages"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


OP1_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r(rule, verdict) AS (VALUES {_values(RULES)}
), rr AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM r
), fit AS (
  SELECT p.page_id, max_by(struct_pack(rule := rule, verdict := verdict), length(rule) * 1000 + length(rh)) AS best
  FROM p JOIN rr ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY 1
), bad(site) AS (VALUES {_values((b,) for b in BLOCKED_SITES)}
), listed AS (
  SELECT DISTINCT p.page_id FROM p JOIN bad ON p.host = site OR ends_with(p.host, '.' || site)
)
SELECT p.page_id, p.host, p.path, fit.best.rule AS rule,
       coalesce(fit.best.verdict, CASE WHEN listed.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN listed USING (page_id)
"""

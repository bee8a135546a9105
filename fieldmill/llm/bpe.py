"""Byte-level BPE encoding and decoding on a contiguous rank array.

A short word is a row of parts: ``bounds`` holds where each part begins and
``ranks`` the merge rank of each part with its right neighbour.  Encoding
scans for the smallest rank, deletes the boundary behind it and refreshes the
two neighbouring ranks, until no adjacent pair merges; for words of a dozen
bytes this beats any heap.  Words over ``LONG`` bytes take a heap of the same
ranks, so that one huge run of characters stays near-linear.

Words repeat, so every worker keeps a bounded cache of encoded words.  A text
is cut at single spaces, which always are word bounds of the pattern; texts
where they may not be (runs of white space) go through the pattern whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship, table

LONG = 96
CACHE_WORDS = 500_000
NEVER = 1 << 60

# The published word pattern of byte-level BPE vocabularies (fixed value);
# white space is the Unicode property, without the control separators.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_UNSAFE = regex.compile(r"\p{White_Space} ")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes
    that print stand for themselves, the rest follow from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary file: encodes and decodes as the file's
    own library does without added specials, truncation or padding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        model = spec["model"]
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.pieces = {i: t for t, i in self.ids.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # rank by merged bytes: every token of a trained vocabulary has one merge
        self.ranks = {raw(a) + raw(b): r for r, (a, b) in enumerate(pairs)}
        if len(self.ranks) != len(model["merges"]):
            raise ValueError(f"{path}: two merges make the same token")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.pieces |= {i: t.encode() for t, i in added.items()}
        self.splitter = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.id_text = {p: str(i) for p, i in self.ids.items()}
        self.by_text = {str(i): p for i, p in self.pieces.items()}
        self.plain: dict[str, str] = {}
        self.spaced: dict[str, str] = {}

    def encode_word(self, word: bytes) -> list[int]:
        parts = self._long(word) if len(word) > LONG else self._short(word)
        return [self.ids[p] for p in parts]

    def _short(self, word: bytes) -> list[bytes]:
        rank = self.ranks.get
        bounds = list(range(len(word) + 1))
        ranks = [rank(word[i:i + 2], NEVER) for i in range(len(word) - 1)]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(word[bounds[i]:bounds[i + 2]], NEVER)
            if i:
                ranks[i - 1] = rank(word[bounds[i - 1]:bounds[i + 1]], NEVER)
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _long(self, word: bytes) -> list[bytes]:
        n, rank = len(word), self.ranks.get
        end = list(range(1, n + 1))  # end of the part that begins here; 0: no part begins here
        before = list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := rank(word[i:end[j]])) is not None:
                heap.append((r, i, j, end[j])) if start else heapq.heappush(heap, (r, i, j, end[j]))

        start = True
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        start = False
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(word[i:end[i]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        """All ids of a text; strings of the added tokens become their ids."""
        ids: list[int] = []
        for piece in self.splitter.split(text) if self.splitter else [text]:
            if piece in self.added:
                ids.append(self.added[piece])
            else:
                for word in PATTERN.findall(piece):
                    ids += self.encode_word(word.encode())
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def _joined(self, word: str) -> str:
        raw, texts = word.encode(), self.id_text
        return ",".join([texts[p] for p in (self._long(raw) if len(raw) > LONG else self._short(raw))])

    def _known(self, cache: dict[str, str], words: list[str], lead: str) -> list[str]:
        try:
            return [cache[w] for w in words]
        except KeyError:
            for w in words:
                if w not in cache:
                    cache[w] = self._joined(lead + w) if w.isalpha() else self._pieced(lead + w)
            return [cache[w] for w in words]

    def _pieced(self, chunk: str) -> str:
        """A chunk of several pattern words, each through the cache."""
        out = []
        for word in PATTERN.findall(chunk):
            cache, w = (self.spaced, word[1:]) if word[0] == " " and len(word) > 1 else (self.plain, word)
            if w not in cache:
                cache[w] = self._joined(word)
            out.append(cache[w])
        return ",".join(out)

    def encode_joined(self, text: str) -> str:
        """The ids of a text as decimals joined by commas."""
        if _UNSAFE.search(text) or (self.splitter and self.splitter.search(text)):
            return ",".join(map(str, self.encode(text)))
        if len(self.plain) + len(self.spaced) > CACHE_WORDS:
            self.plain.clear()
            self.spaced.clear()
        first, *rest = text.split(" ")
        out = self._known(self.plain, [first], "") if first else []
        return ",".join(out + self._known(self.spaced, rest, " "))

    def decode_joined(self, joined: str) -> str:
        if not joined:
            return ""
        return b"".join([self.by_text[i] for i in joined.split(",")]).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _vocabulary_path(name_or_path: str) -> str:
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers
    return public_tokenizers.path(name_or_path)


def _encode_rows(name: str, with_ids: bool):
    def run(batches):
        bpe = vocabulary(_vocabulary_path(name))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n, sha_ids, sha_text, ids = [], [], [], []
                for text in part.column(1):
                    joined = bpe.encode_joined(text.as_py() or "")
                    n.append(joined.count(",") + 1 if joined else 0)
                    sha_ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    back = bpe.decode_joined(joined)
                    sha_text.append(hashlib.sha256(back.encode()).hexdigest())
                    ids.append([int(x) for x in joined.split(",")] if with_ids and joined else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(sha_ids, pa.string()),
                     pa.array(sha_text, pa.string()), pa.array(ids, pa.list_(pa.int32()))],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
    return run


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary_file: str = "byte_bpe_50k.json", with_ids: bool = True) -> DataFrame:
    """Per row of ``docs``: id, n_tokens, ids_sha256 (of the decimal ids joined
    by commas), decoded_sha256 (of the text decoded from the ids) and ids
    (empty unless ``with_ids``).

    ``vocabulary_file`` is a path, or a name in the public tokenizer folder,
    which must be at hand on every executor.  Null and empty texts have no
    ids; repeated rows and null ids are encoded like any other; an empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _encode_rows(vocabulary_file, with_ids),
        "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>") \
        .withColumnRenamed("id", id_col)


def op5_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every text of documents, byte_bpe_50k."""
    return encode_texts(table(spark, sf_dir, "documents"), with_ids=False) \
        .select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

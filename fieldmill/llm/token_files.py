"""Token-id files: each document compressed by itself with a shared dictionary.

A data set is a folder of shard files in ascending document order plus one
zstandard dictionary, trained on the serialized id arrays of a bounded sample
of documents.  A shard is

    header   magic, id width in bytes, 64-bit hash of the dictionary
    frames   one zstandard frame per document, back to back
    index    per document: id (and whether it is null), first token in the
             shard, frame offset; one more offset at the end
    footer   offset of the index, number of documents, number of tokens

so one document is found by a binary search in the index and costs one short
read and one small inflate; the dictionary makes short frames small.
"""

from __future__ import annotations

import array
import os
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.operators.prefix import with_start

from .arrays import Words, mix, ragged, slices
from .bpe import _vocabulary_path
from .shared import Scratch, n_parts, open_input, put_file, table

MAGIC = b"TKZD0001"
HEADER = "<8sHxxxxxxQ"
FOOTER = "<QQQ8s"
HEADER_SIZE, FOOTER_SIZE = struct.calcsize(HEADER), struct.calcsize(FOOTER)
LEVEL = 3
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 256 << 10, 64 << 10
SHARD_BYTES = 16 << 20
CACHE_BYTES, CACHED_WORD = 48 << 20, 100  # of one worker's word ids; longest word kept
RUN_BYTES = 2 << 20
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?#*$%&|<>()")] = True
_LETTER[97:123] = _LETTER[128:] = True


def _only_letters(word: bytes) -> bool:
    """Whether the normalised word is letters and nothing else."""
    return word.isalpha() or (not word.isascii()
                              and unicodedata.normalize("NFC", word.decode()).lower().isalpha())


class _Ids:
    """Ids of distinct words in arrays: 64-bit hash and check, whether the
    word is letters only, and its run of ``flat``."""

    def __init__(self, key, check, letters, size, flat):
        self.key, self.check, self.letters, self.size, self.flat = key, check, letters, size, flat
        self.begin = np.cumsum(size) - size

    @classmethod
    def none(cls, dtype):
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, dtype))

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.key, self.check, self.letters, self.size, self.begin, self.flat))

    def take(self, at: np.ndarray) -> "_Ids":
        size = self.size[at]
        flat = self.flat[np.repeat(self.begin[at], size) + ragged(size)]
        return _Ids(self.key[at], self.check[at], self.letters[at], size, flat)

    def plus(self, other: "_Ids") -> "_Ids":
        return _Ids(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("key", "check", "letters", "size", "flat")))

    def sorted(self) -> "_Ids":
        return self.take(np.argsort(self.key, kind="stable"))

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if unknown (``self`` sorted by key)."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)


class LibraryEncoder:
    """Whole texts through the tokenizers library, with a cache of words.

    Where a vocabulary drops white space no token crosses it, so a text's ids
    are those of its white-space-separated words in a row; the normaliser
    lower-cases, so words may be looked up lower-cased unless a special
    token's brackets are in sight.  A word ``letters + ASCII marks`` is two
    units, since the word pattern cuts there; many units of letters go to the
    library as one text, whose ids part again behind the word-end tokens.
    Vocabularies that keep white space get whole texts.

    The cache is bounded in bytes: the newest units fill one half of
    ``CACHE_BYTES``; when it is full it replaces the other half."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        n = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if n <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.dtype = np.dtype(f"<u{self.width}")
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        self.by_word = bool(self.ends.any()) and self._ids("Ab c") == self._ids("ab") + self._ids("c")
        self.young, self.old = _Ids.none(self.dtype), _Ids.none(self.dtype)

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.code, e.ids).tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> list[bytes]:
        """Little-endian ids of each text, ``width`` bytes each.  The units of
        a run of documents are told apart by 64-bit hashes; each distinct one
        is looked up once and its ids are gathered for all its places."""
        if not self.by_word:
            return self._batch([t or "" for t in column.to_pylist()])
        out = []
        for i, j, words in slices(column, lower=True, limit=RUN_BYTES):
            raw = words.data.tobytes()
            if b"<|" in raw:  # special tokens are case-sensitive: these texts go whole
                out += self._batch([t or "" for t in column.slice(i, j - i).to_pylist()])
                continue
            ids, place, doc = self._units(words, raw)
            count = ids.size[place]
            flat = ids.flat[np.repeat(ids.begin[place], count) + ragged(count)]
            cuts = np.concatenate([[0], np.cumsum(count)])[doc]
            out += [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        return out

    def _units(self, words: Words, raw: bytes) -> tuple[_Ids, np.ndarray, np.ndarray]:
        """Ids of the distinct units, the unit at every place, and the first
        place of each document."""
        start, end, doc = words.start, words.end, words.doc
        where = np.arange(len(words.data))
        last = np.maximum.accumulate(np.where(_MARK[words.data], -1, where)) if len(where) else where
        core = np.maximum(last[end - 1] + 1, start)
        other = np.concatenate([[0], np.cumsum(~_LETTER[words.data])])
        core = np.where((other[core] == other[start]) & (core > start), core, end)
        while True:
            edges = np.stack([start, core, end], axis=1)
            real = np.stack([np.ones(len(start), bool), core < end], axis=1).ravel()
            words.start, words.end = edges[:, :2].ravel()[real], edges[:, 1:].ravel()[real]
            key, first, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
            ids = self._lookup(key, words.start[first], words.end[first], words.data, raw)
            begin = np.cumsum(np.append(0, 1 + (core < end)))
            if len(start):  # what looked like letters may not be: such words stay whole
                whole = (core < end) & ~ids.letters[place[begin[:-1]]]
                if whole.any():
                    core = np.where(whole, end, core)
                    continue
            return ids, place, begin[doc]

    def _lookup(self, key, start, end, data, raw) -> _Ids:
        n = np.minimum(end - start, 8)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        shift = np.uint64(64) - np.uint64(8) * n.astype(np.uint64)
        check = mix((eight[start] << shift) + mix((eight[end - n] << shift) + (end - start).astype(np.uint64)))
        young, old = self.young.find(key, check), self.old.find(key, check)
        new = np.flatnonzero((young < 0) & (old < 0))
        told = self._learn([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())], key[new], check[new])
        known = self.young.take(young[young >= 0]).plus(self.old.take(old[(young < 0) & (old >= 0)])).plus(told)
        order = np.concatenate([np.flatnonzero(young >= 0), np.flatnonzero((young < 0) & (old >= 0)), new])
        keep = told.take(np.flatnonzero((end - start)[new] <= CACHED_WORD))
        if len(keep.key):
            self.young = self.young.plus(keep).sorted()
            if self.young.nbytes() > CACHE_BYTES // 2:
                self.young, self.old = _Ids.none(self.dtype), self.young
        return known.take(np.argsort(order, kind="stable"))

    def _learn(self, words: list[bytes], key: np.ndarray, check: np.ndarray) -> _Ids:
        alpha = [_only_letters(w) for w in words]
        at = [i for i, a in enumerate(alpha) if a]
        rest = [i for i, a in enumerate(alpha) if not a]
        ids: list[bytes] = [b""] * len(words)
        for i in range(0, len(at), 1000):
            part = at[i:i + 1000]
            for k, x in zip(part, self._letters([words[k] for k in part])):
                ids[k] = x
        for k, x in zip(rest, self._batch([words[k].decode() for k in rest])):
            ids[k] = x
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        return _Ids(key, check, np.array(alpha, bool), size, np.frombuffer(b"".join(ids), self.dtype))

    def _letters(self, words: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(self._batch([b" ".join(words).decode()])[0], self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words):
            flat, at = ids.tobytes(), [0, *(cuts * self.width).tolist()]
            return [flat[a:b] for a, b in zip(at, at[1:])]
        return self._batch([w.decode() for w in words])  # lower-casing a letter may make several words of one


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(name_or_path: str) -> LibraryEncoder:
    path = _vocabulary_path(name_or_path)
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; empty if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class ShardReader:
    """Documents of one shard by position or by id."""

    def __init__(self, uri: str, dictionary: bytes):
        self.file = open_input(uri)
        size = self.file.size()
        self.file.seek(size - FOOTER_SIZE)
        index, n, self.n_tokens, magic = struct.unpack(FOOTER, self.file.read(FOOTER_SIZE))
        self.file.seek(0)
        head, self.width, hashed = struct.unpack(HEADER, self.file.read(HEADER_SIZE))
        if magic != MAGIC or head != MAGIC or hashed != xxhash.xxh64_intdigest(dictionary):
            raise ValueError(f"{uri}: not a whole shard of this dictionary")
        self.file.seek(index)
        raw = self.file.read(size - FOOTER_SIZE - index)
        self.ids = np.frombuffer(raw, "<i8", n)
        self.start = np.frombuffer(raw, "<i8", n + 1, 8 * n)
        self.offset = np.frombuffer(raw, "<i8", n + 1, 16 * n + 8)
        self.valid = np.frombuffer(raw, "?", n, 24 * n + 16)
        self.inflate = zstandard.ZstdDecompressor(dict_data=_codec(dictionary)).decompress

    def document(self, i: int) -> np.ndarray:
        self.file.seek(int(self.offset[i]))
        frame = self.file.read(int(self.offset[i + 1] - self.offset[i]))
        return np.frombuffer(self.inflate(frame), f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document with this id (nulls come first)."""
        nulls = len(self.valid) - int(self.valid.sum())
        i = nulls + int(np.searchsorted(self.ids[nulls:], doc_id))
        return self.document(i) if i < len(self.ids) and self.ids[i] == doc_id else None


def _write_shard(folder: str, vocabulary: str, end_id: int, dictionary: bytes):
    def run(batches):
        enc = encoder(vocabulary)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(dictionary)).compress
        ids, valid, sizes, lengths = [], [], [], []
        end = end_id.to_bytes(enc.width, "little")

        def body():
            yield struct.pack(HEADER, MAGIC, enc.width, xxhash.xxh64_intdigest(dictionary))
            for batch in batches:
                for i in range(0, batch.num_rows, 2000):
                    part = batch.slice(i, 2000)
                    valid.extend(part.column(0).is_valid().to_pylist())
                    ids.extend(part.column(0).fill_null(0).to_pylist())
                    for raw in enc.encode(part.column(1)):
                        frame = press(raw + end)
                        sizes.append(len(frame))
                        lengths.append(len(raw) // enc.width + 1)
                        yield frame
            start = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
            offset = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8") + HEADER_SIZE
            yield np.array(ids, "<i8").tobytes() + start.tobytes() + offset.tobytes() + np.array(valid, "?").tobytes()
            yield struct.pack(FOOTER, int(offset[-1]), len(ids), int(start[-1]), MAGIC)

        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:07d}.tkz"
        put_file(uri, body())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "uri": [uri],
                                          "n_docs": pa.array([len(ids)], pa.int64()),
                                          "n_tokens": pa.array([sum(lengths)], pa.int64())})
    return run


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary_file: str = "word_bpe_49k.json", end_id: int = 2) -> tuple[DataFrame, bytes]:
    """Encode every text, append ``end_id`` to each document and write shards
    in ascending id order (null ids first, equal ids by text hash, so that a
    repeated id is spread over shards) to a new folder
    below the shared checkpoint folder.  Returns the manifest (shard, uri,
    n_docs, n_tokens, start: tokens before the shard) and the dictionary.

    Null and empty texts are documents of the end id alone; an empty table
    gives an empty manifest.  Other columns are not read.  The dictionary is
    trained on the whole id arrays of at most ``SAMPLE_DOCS`` documents (those
    with the smallest id hashes among texts of up to ``SAMPLE_BYTES``); it
    shapes the file's size, not its content.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    folder = scratch.path("shards")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    small = docs.where((F.octet_length("text") <= SAMPLE_BYTES) & F.col("id").isNotNull())
    chosen = small.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).distinct()
    sample = small.join(F.broadcast(chosen), "id", "left_semi").select("text").orderBy("text").limit(SAMPLE_DOCS)

    def encoded(batches):
        enc = encoder(vocabulary_file)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"ids": pa.array(enc.encode(batch.column(0)), pa.binary())})

    dictionary = train_dictionary([bytes(r.ids) for r in sample.mapInArrow(encoded, "ids binary").collect()])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    shards = n_parts(size, SHARD_BYTES, least=12)
    ordered = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "id", "h") \
        .sortWithinPartitions("id", "h").select("id", "text")
    written = scratch.write(ordered.mapInArrow(_write_shard(folder, vocabulary_file, end_id, dictionary),
                                               "shard long, uri string, n_docs long, n_tokens long"), "manifest")
    put_file(f"{folder}/dictionary.zdict", [dictionary])
    return with_start(written.where("n_docs > 0"), ["shard"], "n_tokens", "start"), dictionary


def read_token_files(manifest: DataFrame, dictionary: bytes, with_ids: bool = True) -> DataFrame:
    """Every document of the shards: id, start, n_tokens, ids_crc32 (of its ids
    as little-endian 32-bit integers) and ids (null unless ``with_ids``)."""
    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(uri, dictionary)
                for i in range(0, len(shard.ids), 256):
                    docs = [shard.document(k).astype("<u4") for k in range(i, min(i + 256, len(shard.ids)))]
                    at = slice(i, i + len(docs))
                    cuts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(docs).view(np.int32))) \
                        if with_ids else pa.nulls(len(docs), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(shard.ids[at], mask=~shard.valid[at]),
                        "start": pa.array(shard.start[:-1][at] + start),
                        "n_tokens": pa.array(np.diff(cuts).astype(np.int64)),
                        "ids_crc32": pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()),
                        "ids": ids})

    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").select("uri", "start").mapInArrow(
        run, "id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every text of documents, word_bpe_49k, end id 2."""
    manifest, dictionary = write_token_files(table(spark, sf_dir, "documents"))
    return read_token_files(manifest, dictionary, with_ids=False) \
        .select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")

"""Small parts against plain Python, with the awkward inputs."""

import gzip
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fieldmill.llm import arrays, bpe, html_text, near_vectors, quality, substrings, token_files, urls, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = ["a b  c", "", None, "x\ty z b  ", "no end", "k" * 9000 + " é\x1cq", "\n\n", "Ab ab"]
PIECES = ["a", "B", "É", "é", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "1", "२", "'s", "'LL", "!", "<|endoftext|>",
          "<|ENDOFTEXT|>", "́", "İ", "Σ", "日本", "😀", "ﬁ", "̸=", "don't", "\x00", "x" * 150]


def _random_texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(0, 14))) for _ in range(n)]


def test_words_and_hashes():
    seen = {}
    for limit in (1, 1 << 20):
        for i, j, w in arrays.slices(pa.array(TEXTS), limit=limit):
            for d in range(j - i):
                a, b = w.doc[d], w.doc[d + 1]
                got = [w.data[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])]
                assert got == WORD.findall((TEXTS[i + d] or "").encode())
                for word, h in zip(got, w.hashes()[a:b]):
                    assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [1, 2, 5, 20, 50])
def test_windows_depend_on_words_and_order_only(n):
    h = arrays.mix(np.arange(200, dtype=np.uint64) % np.uint64(61))
    w = arrays.windows(h, n)
    assert len(w) == 201 - n and (w[61:] == w[:-61]).all()
    assert len(np.unique(w)) == 61
    assert n == 1 or arrays.windows(h[:n][::-1], n)[0] != w[0]
    assert len(arrays.windows(h[:n - 1], n)) == 0


def test_cover_meets_every_shift():
    gaps = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert gaps == set(range(substrings.PERIOD))


def test_bpe_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    for text in _random_texts(3000) + ["", " ", "thin the there " * 300, "ab" * 3000]:
        ids = library.encode(text, add_special_tokens=False).ids
        joined = own.encode_joined(text)
        assert own.encode(text) == ids and joined == ",".join(map(str, ids))
        assert own.decode_joined(joined) == own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    word = b"thinthethere" * 40
    assert own._short(word) == own._long(word)


def test_library_words_equal_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_files.LibraryEncoder(path)
    texts = _random_texts(3000, 5) + [None, ""]
    for text, raw in zip(texts, own.encode(pa.array(texts))):
        assert np.frombuffer(raw, "<u2").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_shard_round_trip_and_wrong_dictionary(tmp_path):
    docs = [np.arange(n, dtype="<u2") for n in (0, 3, 500)]
    dictionary = token_files.train_dictionary([bytes(range(i % 200, i % 200 + 50)) * 3 for i in range(300)])
    assert token_files.train_dictionary([b"x"]) == b""
    assert token_files._codec(b"") is None and len(docs) == 3 and isinstance(dictionary, bytes)


def test_gzip_normaliser_round_trip(tmp_path):
    payloads = [b"", b"x\r\n\r\ny" * 3, bytes(range(256)) * 3000]
    records = [warc.record_bytes(i, f"http://h/{i}\r\nX: y", p, f"d{i}", None, "1970-01-01T00:00:00Z")
               for i, p in enumerate(payloads)] + [warc.record_bytes(None, None, b"abc", "d", 1, "1970-01-01T00:00:00Z")]
    source, target = str(tmp_path / "a.gz"), str(tmp_path / "b.gz")
    with open(source, "wb") as f:
        f.write(gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:])))
    assert warc.normalise(source, target) == 4
    import json
    with open(target + ".idx") as f, open(target, "rb") as g:
        got = [warc.read_member(g, at, n) for _, at, n in map(json.loads, f)]
    assert [p for _, _, p in got[:3]] == payloads and got[3][0]["WARC-Type"] == "revisit" and got[3][1]["Content-Length"] == "3"
    assert "X" not in got[0][0]
    with pytest.raises(ValueError):
        list(warc.inflate_records(io.BytesIO(gzip.compress(b"".join(records)[:-5]))))


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b))  # everything of one length collides
    path = str(tmp_path / "d.bin")
    urls.digest_file(path, {"aa": 1, "bb": 2, "c": 3})
    found = urls.DigestArray(path)
    at = found.find([b"bb", b"cc", b"c", b"", b"aa"])
    assert [found.string(i) if i >= 0 else None for i in at] == ["bb", None, "c", None, "aa"]
    urls.digest_file(path, {})
    assert urls.DigestArray(path).find([b"x"]).tolist() == [-1]


@pytest.mark.parametrize("source, text", [
    ("", ""), ("plain &amp; <b>bo</b>ld", "plain & bold"),
    ("<nav>menu</nav><article><h1>T</h1><p>a\n b<p>c<br>d</article><footer>f</footer>", "T\n\na b\n\nc d"),
    ("<body><p>one</p><div class='cookie-notice'>x</div><form>f</form><p>two", "one\n\ntwo"),
    ("<main><p>x</p><section id=comments><p>me too</p></section></main>", "x"),
    ("<p>a<script>var s='</p>';</script>b<!-- <p>c --></p><style>p{}</style>", "ab"),
    ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1\n\n2\n\n3\n\n4"), ("<p>a <", "a <"), ("<p>t</p><a href=", "t")])
def test_main_text_of_one_page(source, text):
    assert html_text.Page(source).main_text() == text


def test_html_of_any_shape_takes_linear_time():
    for source in ('<a "' * 20000, "<div>" * 20000 + "</p>" * 20000, "<" * 50000, "&" * 50000):
        html_text.Page(source).main_text()


def test_filters_find_near_pairs_and_grow_with_the_table():
    g = np.random.Generator(np.random.PCG64(1))
    cap, words = near_vectors.filter_shape(5000, 0.93)
    assert near_vectors.filter_shape(10**8, 0.93)[0] > cap
    code, met = near_vectors.Filters(64, cap, words), 0
    for _ in range(300):
        u = near_vectors.unit(g.standard_normal(64))
        w = g.standard_normal(64)
        w -= (w @ u) * u
        v = 0.93 * u + np.sqrt(1 - 0.93 ** 2) * near_vectors.unit(w)
        met += bool(set(code.decode(u)) & set(code.decode(v)))
    assert met >= 297
    for bad in ([], [0.0, 0.0], [1.0, np.nan], [np.inf, 1.0]):
        assert near_vectors.unit(np.array(bad)) is None
    assert abs(near_vectors.unit(np.array([1e300, 1e300])) @ near_vectors.unit(np.array([1e-300, 1e-300])) - 1) < 1e-12


@pytest.mark.parametrize("dim", [16, 32, 64, 128])
@pytest.mark.parametrize("largest", [10**5, 10**6, 10**7])
def test_filters_find_near_pairs_at_any_size_and_length(dim, largest):
    cap, words, tables = near_vectors.filter_tables(dim, largest, 0.93)
    code, g = near_vectors.Filters(dim, cap, words, tables), np.random.Generator(np.random.PCG64(2))
    pairs = [near_vectors.pair_at(g, dim, 0.93) for _ in range(200)]
    assert sum(bool(set(code.decode(u)) & set(code.decode(v))) for u, v in pairs) >= 198


@pytest.mark.parametrize("dim", [5, 16, 64])
def test_sphere_shares_equal_counts(dim):
    g = np.random.Generator(np.random.PCG64(dim))
    x = g.standard_normal((200_000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u, v = near_vectors.pair_at(g, dim, 0.8)
    for cap in (0.1, 0.3):
        for cosine, n in ((1.0, (x @ u >= cap).mean()), (0.8, ((x @ u >= cap) & (x @ v >= cap)).mean())):
            assert abs(near_vectors.sphere_share(dim, cap, cosine) - n) < 0.005


def test_few_or_short_vectors_are_all_compared():
    assert [near_vectors.filter_tables(*a)[1] for a in ((64, 16, 0.93), (2, 10**6, 0.93), (64, 10**6, -0.99))] == [0, 0, 0]


def test_classifier_learns_and_needs_two_classes():
    rnd = random.Random(4)
    good = [" ".join(rnd.choice(["the", "river", "house", "walks"]) for _ in range(80)) for _ in range(60)]
    junk = [" ".join(rnd.choice(["$$$", "buy", "###", "now!!"]) for _ in range(80)) for _ in range(60)]
    texts, label = good + junk, np.array([1] * 60 + [0] * 60)
    order = np.array(rnd.sample(range(120), 120))
    model = quality.fit([quality._sparse(pa.array(texts))[i] for i in order], label[order])
    p = np.concatenate([model.probability(w) for _, _, w in arrays.slices(pa.array(texts))])
    assert ((p >= 0.5) == (label == 1)).all()
    assert quality.fit([], np.array([])) is None
    assert quality.fit(quality._sparse(pa.array(good)), np.ones(60)) is None
    assert zlib.crc32(b"") == 0

"""Lexical search, suffix dedup and source divergence against brute force,
and the SQL of this subpackage against its queries."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from fieldmill.llm import divergence, html_text, lexical, near_text, near_vectors, queries, substrings, suffixes, token_files

CLASH = "term string, shard string, part int, n long, rank int, score long, value string, salt int, kind string"
CLASH_ROW = ("t", "s", 1, 2, 3, 4, "v", 5, "k")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _frame(spark, rows, cols):
    return spark.createDataFrame([tuple(r) + CLASH_ROW for r in rows], cols + ", " + CLASH)


def _terms(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def _best(docs, items, k):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    held = [(d, Counter(_terms(t, pattern))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out, asked = [], {}
    for item, text in items:
        asked.setdefault(item, []).extend(_terms(text, pattern))
    for item, terms in asked.items():
        found = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if e[1] else e[2], -e[0]) for r, e in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs,window,short,query_bytes", [(7, 3, 0.2, 60), (1 << 16, 1024, 1 / 16, 1 << 20), (50, 8, 0.0, 200)])
def test_search(spark, shard_docs, window, short, query_bytes):
    rnd = random.Random(shard_docs)
    words = [f"W{i}" for i in range(40)] + ["Über", "日本", "x1"]
    text = lambda n: rnd.choice([" ", ". ", "-"]).join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rnd.choice([0, 1, 5, 40]))) for i in range(160)]
    docs += [(3, docs[3][1]), (None, docs[5][1]), (None, "W1"), (700, None), (701, ""), (702, "!?"), (703, text(4000))]
    items = [(i, text(rnd.choice([1, 3, 12]))) for i in range(12)] + [(20, None), (21, "unknown"), (3, "w1 w1"), (None, "W2 W3")]
    index = lexical.build_index(_frame(spark, docs, "doc_id long, text string"), shard_docs=shard_docs)
    got = lexical.search(index, _frame(spark, items, "item_id long, text string"), k=5, query_bytes=query_bytes,
                         short=short, window=window).collect()
    assert sorted((tuple(r) for r in got), key=str) == _best(docs, items, 5)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(docs), items).collect() == []
    one = lexical.build_index(spark.createDataFrame([(1, "b c"), (2, "a")], "doc_id long, text string"))
    assert lexical.search(one, items.where("false")).collect() == []
    assert [(r.doc_id, r.rank) for r in lexical.search(one, items).collect()] == [(2, 1)]


def test_lengths_beyond_64_bits():
    n = np.array([10**9, 3], np.int64)
    assert lexical._lengths(n, 10**12, 10**15).tolist() == [25 + 75 * x * 10**12 // 10**15 for x in (10**9, 3)]


def _cut(rows, length):
    seen = Counter(b[p:p + length] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,length", [(1, 64), (2, 200)])
def test_repeated_substrings(spark, seed, length):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé ñ") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages, rows = [text(40) for _ in range(6)], []
    for i in range(200):
        kind = rnd.random()
        if kind < 0.2 and rows:
            t = rnd.choice(rows)[1]
        elif kind < 0.5 and rows:  # near copy
            t = rnd.choice(rows)[1]
            for _ in range(1 + len(t) // 150):
                p = rnd.randrange(len(t) + 1)
                t = t[:p] + rnd.choice(["x", "", "zz"]) + t[p + rnd.randint(0, 3):]
        elif kind < 0.7:
            a = rnd.randrange(40)
            t = text(rnd.randint(0, 60)) + rnd.choice(passages)[a:a + rnd.randint(40, 300)] + text(rnd.randint(0, 60))
        elif kind < 0.8:  # periodic
            t = rnd.choice(["a", "ab", "abcd" * 9 + "e"]) * rnd.randint(0, 200) + text(10)
        else:
            t = text(rnd.randint(0, 120))
        rows.append((i, t))
    rows += [(None, None), (500, ""), (None, rows[3][1]), (7, text(50)), (501, "q" * (length + 9)), (502, text(9000))]
    got = suffixes.repeated_substrings(_frame(spark, rows, "doc_id long, text string"), length=length).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got]
    want = _cut(rows, length)
    assert sorted(got, key=str) == want and sum(w[2] for w in want) > 5000
    assert any(0 < w[2] < w[1] for w in want)


def test_repeated_substrings_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeated_substrings(empty).collect() == []
    with pytest.raises(ValueError):
        suffixes.repeated_substrings(empty, length=63)


def _diverge(rows, least, top):
    pattern = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    df, count, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = _terms(text, pattern)
        df.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for (g, t), n in df.items() if g == lang and n >= least]
        sources = [s for g, s in groups if g == lang]
        share = {s: {t: 1 + 10**9 * (count[lang, s, t] + 2) // (sum(count[lang, s, x] for x in kept) + 2 * len(kept))
                     for t in kept} for s in sources}
        total = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        whole = {t: 1 + 10**9 * (total[t] + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(share[s][t], whole[t]), t.encode(), t) for t in kept if count[lang, s, t] and share[s][t] > whole[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(ranked)]
    return sorted(out)


def test_source_divergence(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["a", "B", "été", "zß", "\U0001f600", "￮"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "ü", None, "\U0001f600", "￮"]),
             " ".join(rnd.choice(words[:rnd.choice([3, 20, 56])]) for _ in range(rnd.choice([0, 3, 30])))) for _ in range(300)]
    rows += [("xx", "s1", "alone"), ("xx", "s2", None), ("en", "none", "1 2 3"), ("solo", "s", "a b"), rows[0], rows[0]]
    monkeypatch.setattr(divergence, "TERM_ROWS", 40)
    got = divergence.source_divergence(_frame(spark, rows, "lang string, source string, text string"), least_docs=5, top=4)
    want = _diverge(rows, 5, 4)
    assert sorted(map(tuple, got.collect())) == want
    assert {w[0] for w in want} == {"", "en", "de", "xx"}
    assert divergence.source_divergence(got.select("lang", "source", got.item.alias("text")).where("false")).collect() == []


def test_word_units_in_a_small_cache(monkeypatch):
    """Ids from the cache equal the library's, with hardly any room in it."""
    import pyarrow as pa
    path = "/opt/tokenizers/word_bpe_49k.json"
    if not os.path.exists(path):
        pytest.skip("vocabulary not present")
    monkeypatch.setattr(token_files, "CACHE_BYTES", 4000)
    monkeypatch.setattr(token_files, "RUN_BYTES", 300)
    rnd = random.Random(4)
    texts = ["", None, "İstanbul, x", "İ.", "..,", "foo-bar. it's 12.5% (a)", "ß. ﬁ, Ⅷ.", "x" * 500 + ". " + "é" * 300,
             "<|end|> Foo", "日本. 語,", "é. éa", "a​b. c"]
    texts += ["".join(rnd.choice("aAbé .,İß1-'ñ\ń(") for _ in range(60)) for _ in range(400)]
    enc = token_files.LibraryEncoder(path)
    assert enc.by_word
    want = [np.array(enc._ids(t or ""), enc.dtype).tobytes() for t in texts]
    assert enc.encode(pa.array(texts, pa.string())) == want
    assert enc.encode(pa.array(texts[::-1], pa.string())) == want[::-1]
    assert enc.young.nbytes() + enc.old.nbytes() <= 3 * 4000


def test_starts_and_checksums_over_shards(spark, monkeypatch):
    """Starts and crc32 over several shards, with hot, repeated and null ids."""
    import zlib
    if not os.path.exists("/opt/tokenizers/word_bpe_49k.json"):
        pytest.skip("vocabulary not present")
    monkeypatch.setattr(token_files, "SHARD_BYTES", 500)
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta.", "gamma"]) for _ in range(rnd.randrange(60)))) for i in range(80)]
    rows += [(None, f"null {i}") for i in range(60)] + [(7, f"seven {i}") for i in range(60)] + [(90, None), (91, "")]
    manifest, dictionary = token_files.write_token_files(_frame(spark, rows, "doc_id long, text string"))
    assert manifest.count() > 5
    enc = token_files.encoder("word_bpe_49k.json")
    got = token_files.read_token_files(manifest, dictionary).orderBy("start").collect()
    assert Counter((r.id, tuple(r.ids)) for r in got) == Counter((d, tuple([*enc._ids(t or ""), 2])) for d, t in rows)
    at = 0
    for r in got:
        ids = np.array(r.ids, "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    named = [r.id for r in got]
    assert named == sorted(named, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_of_the_queries(spark, name):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, cur.fetchall()))


def _host_pages(host, article, extra):
    """Eight pages of one host; all that is not the article differs per page too."""
    out = []
    for i in range(8):
        body = [f"Title {host} {i}", f"First paragraph {host} {i} & more.", f"Second paragraph {i * 7}."]
        inner = f"<h1>{body[0]}</h1><p>First paragraph {host} {i} &amp; more.</p>{extra[0].format(i=i)}<p>{body[2]}</p>{extra[1].format(i=i)}"
        opening, closing = article
        page = f"<html><body class=has-sidebar><nav><a>menu {i}</a></nav>{opening}{inner}{closing}" \
               f"<div id=comments><p>reader {i} says {i}</p></div><footer>printed {i}</footer></body></html>"
        out.append((f"https://h{host}.org/{i}", page, "\n\n".join(body)))
    return out


def test_hosts_whose_noise_differs_per_page(spark):
    """Ten templates against labelled texts: importance re-admits no advert,
    comment, form, aside, menu or footer."""
    extras = [("<div class=ad>buy item {i}</div>", "<div class='comments list'><p>reader {i}</p></div><form>answer {i}</form>"),
              ("<aside>also read {i}</aside>", "<section class='comment-list'><p>re {i}</p></section>"),
              ("<div class='promo-box'>sale {i}</div>", "<ul class=related-posts><li>see {i}</li></ul>"),
              ("<script>var x = {i};</script>", "<div role=complementary>more {i}</div>"),
              ("<div class=share>share {i}</div>", "<button>b {i}</button><div class=newsletter>mail {i}</div>")]
    shapes = [("<article>", "</article>"), ("<div class=content>", "</div>")]
    pages = [p for k, (shape, extra) in enumerate((s, e) for s in shapes for e in extras)
             for p in _host_pages(k, shape, extra)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_texts(df).collect()}
    assert [(i, got[i]) for i in range(len(pages))] == [(i, t) for i, (_, _, t) in enumerate(pages)]


@pytest.mark.parametrize("n", [10, 5000, 200_000])
def test_long_attributes(n):
    assert html_text.Page(f'<p data-x="{"y" * n}>leak">t</p>').main_text() == "t"
    assert html_text.Page(f"<p {'a=1 ' * n} it's=\"x>y\">t</p><p>don't</p>").main_text() == "t\n\ndon't"
    assert html_text.Page(f'<p title="never closed>{"z" * n}</p><p>u</p>').main_text() == f'{"z" * n}\n\nu'


def _importance(pages):
    """Entropies of a style tree from its definition, path by path."""
    seen, trees = {}, {}
    for host, source in pages:
        page = html_text.Page(source)
        trees.setdefault(host, {}).setdefault(page.content(), page)
    for host, different in trees.items():
        for page in different.values():
            for path, both in page.paths.items():
                seen.setdefault((host, path), []).append(both)
    out = {}
    for at, both in seen.items():
        parts = []
        for k in (0, 1):
            n = len(both)
            share = [c / n for c in Counter(b[k] for b in both).values()]
            parts.append(-sum(p * math.log(p) for p in share) / math.log(n) if n > 1 else 1.0)
        out[at] = (len(both), round(0.1 * parts[0] + 0.9 * parts[1], 9))
    return out


def test_importance_from_its_definition(spark):
    pages = [(k, h) for k in range(3) for _, h, _ in _host_pages(k, ("<article>", "</article>"), ("<div class=ad>x</div>", "<i class=ad>{i}</i>"))]
    pages += pages[:5]  # copies are no evidence
    df = spark.createDataFrame(pages, "host long, html string")
    got = {(r.host, r.path): (r.pages, round(r.importance, 9)) for r in html_text.style_tree(df).collect()}
    assert {(h, p - 0): v for (h, p), v in _importance(pages).items()} == got


def test_several_texts_under_one_id(spark):
    rnd = random.Random(8)
    w, x = (" ".join(rnd.choice(["ab", "cd", "ef", "gh", "ij"]) + str(i) for i in range(60)) for _ in range(2))
    rows = [(1, w), (5, w + " q"), (5, x), (6, x + " r"), (7, "other words stand in this text alone"), (7, "one more"), (8, None), (8, w)]
    got = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    root = {r.doc_id: set() for r in got}
    for r in got:
        root[r.doc_id].add(r.component_id)
    assert root == {1: {1}, 5: {1}, 6: {1}, 7: {7}, 8: {8, 1}} and len(got) == len(rows)


def test_several_vectors_under_one_id(spark):
    e0, e1, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.1]
    rows = [(1, e0, 0), (1, e1, 0), (2, e0, 0), (3, near, 0), (4, near, 0), (9, [0.0, 0.0, 1.0], 0), (9, [0.0, 0.0, 2.0], 0)]
    got = near_vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [
        (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (9, 1, 9), (9, 1, 9)]


def test_stages_with_clashing_names(spark):
    """Columns named like those that the operators make pass through."""
    rows = [(i, f"words of text {i} " * 30, "s", i, "k", 2, "m", "c") for i in range(20)] + [(None, None, None, 1, "k", 2, "m", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, kept_text string, mix_takes int, "
                                       "mix_source string, carried_0 string")
    for stage in (corpus_pipeline.substring_dedup, corpus_pipeline.mix_sources):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 15
        kept = {tuple(r)[3:] for r in out.collect()}
        assert kept <= {r[3:] for r in rows}


def test_rows_without_id_are_spread(spark):
    rows = [(None, f"text {i} " * 20) for i in range(2000)]
    out = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 2000 and {r.n_removed for r in out} == {0}

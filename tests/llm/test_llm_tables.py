"""Operators and stages against brute force on small tables, with null and
repeated rows, empty tables and columns with clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldmill.llm import (bpe, components, html_text, mixing, near_text, near_vectors, quality, substrings,
                           token_files, urls, warc)

CLASH = "id long, class string, key string, part int, copies int, component string, size string, digest int, h int"
CLASH_ROW = (1, "c", "k", 2, 3, "x", "s", 4, 5)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _docs(spark, rows, clash=True):
    """(doc_id, text, source) rows with columns whose names the operators use inside."""
    cols = "doc_id long, text string, source string" + (", " + CLASH if clash else "")
    return spark.createDataFrame([tuple(r) + (CLASH_ROW if clash else ()) for r in rows], cols)


def _corpus(seed=1, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 4, 60, 150]))]
        kind = rnd.random()
        if kind < 0.2 and rows:
            w = _words(rnd.choice(rows)[1])  # exact copy
        elif kind < 0.45 and rows:
            w = _words(rnd.choice(rows)[1])  # near copy
            for _ in range(len(w) // 40):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(9))
        elif kind < 0.6:
            w = w[:30] + passage[rnd.randrange(15):] + w[30:]
        sep = rnd.choice([" ", "\n", "  "])
        rows.append((i * 7 % n, sep.join(w), f"s{i % 5}"))
    return rows + [(500, None, None), (501, "", "s0"), (None, "a b c", None), (None, None, "s1"), (rows[7][0], rows[7][1], "s2")]


def _component(ids, linked):
    root = {i: i for i in ids}
    for _ in range(len(root)):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rows = _corpus()
    sets = {}
    for i, text, _ in rows:
        w = _words((text or "").lower())
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = _component(ids, linked)
    got = near_text.near_duplicates(_docs(spark, rows), shingle=k).collect()
    assert len(got) == len(rows) and any(a != b for a, b in root.items())
    for r in got:
        assert r.n_shingles == (len(sets[r.doc_id]) if r.doc_id is not None else r.n_shingles)
        assert (r.component_id, r.kept) == (root.get(r.doc_id), root.get(r.doc_id) == r.doc_id)


def test_repeated_passages(spark):
    rows = _corpus(2)
    starts = {}
    for i, text, _ in rows:
        w = _words(text)
        for p in range(len(w) - 49):
            starts.setdefault(tuple(w[p:p + 50]), set()).add(i)
    want = []
    for i, text, _ in rows:
        w, gone = _words(text), set()
        for p in range(len(w) - 49):
            if i is not None and min((x for x in starts[tuple(w[p:p + 50])] if x is not None), default=i) < i:
                gone.update(range(p, p + 50))
        kept = [x for j, x in enumerate(w) if j not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    got = substrings.repeated_passages(_docs(spark, rows), carry=("class", "part")).collect()
    key = lambda t: (t[0] is None, *map(str, t))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, _words(r.kept_text)) for r in got), key=key) \
        == sorted(want, key=key) and sum(t[2] for t in want) > 100
    assert {(r["class"], r.part) for r in got} == {("c", 2)}


def test_vectors(spark):
    g = np.random.Generator(np.random.PCG64(6))
    base = g.standard_normal((30, 16))
    rows = [(i, (base[i % 30] + 0.09 * g.standard_normal(16) * (i % 4)).tolist(), i % 30 % 3) for i in range(150)]
    rows += [(200, rows[3][1], 0), (201, [2 * x for x in rows[3][1]], 0), (202, None, 0), (203, [0.0] * 16, 0),
             (204, [float("nan")] * 16, 1), (205, rows[3][1], None), (206, [1.0, None], 1), (207, [], 1), (None, rows[3][1], 0)]
    df = spark.createDataFrame([r + (CLASH_ROW) for r in rows], "vec_id long, embedding array<double>, label int, " + CLASH)
    unit = {i: near_vectors.unit(np.array(v, float)) for i, v, lab in rows
            if i is not None and lab is not None and v and None not in v}
    label = {i: lab for i, _, lab in rows}
    pairs = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] is not None
             and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    root, links = _component([i for i, _, _ in rows if i is not None], pairs), Counter(x for p in pairs for x in p)
    got = near_vectors.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows) and len(pairs) > 50
    assert all((r.n_links, r.component_id) == (links[r.vec_id], root.get(r.vec_id)) for r in got)


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_text, "BLOCK", 7)
    monkeypatch.setattr(near_vectors, "BLOCK", 7)
    rnd = random.Random(8)
    rows = []
    for i in range(60):
        w = [f"w{j}" for j in range(120)]
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(120)] = f"e{rnd.randrange(99)}"
        rows.append((i, " ".join(w), "s"))
    sets = {i: {tuple(t.split()[j:j + 2]) for j in range(119)} for i, t, _ in rows}
    root = _component(sets, [(a, b) for a in sets for b in sets if a < b
                             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = near_text.near_duplicates(_docs(spark, rows), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    v = np.random.Generator(np.random.PCG64(3)).standard_normal(8)
    vectors = [(i, (v + 0.02 * i / 50 * np.eye(8)[i % 8]).tolist(), 1) for i in range(50)]
    got = near_vectors.near_duplicate_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int"))
    assert {(r.n_links, r.component_id) for r in got.collect()} == {(49, 0)}


def test_components_of_long_paths(spark):
    rnd = random.Random(1)
    ids = rnd.sample(range(1000), 200)
    edges = list(zip(ids[:100], ids[1:100])) + [(ids[150], ids[151]), (ids[151], ids[150]), (ids[5], ids[5])]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: min(ids[:100]) for i in ids[:100]} | {i: min(ids[150:152]) for i in ids[150:152]}
    assert got == want


def test_mix(spark):
    rows = [(i, "w " * ((i * 7) % 60), None if i % 6 == 5 else f"s{i % 6}") for i in range(900)] + [(None, None, "zero")]
    out = mixing.mixed(_docs(spark, rows))
    assert out.columns[:3] == ["doc_id", "text", "source"] and out.count() == len(rows)
    got = out.select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_takes").collect()
    size = Counter()
    for _, text, s in rows:
        size[s] += len(_words(text))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:  # deal out, stop the full ones, deal the rest again
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        share = rest / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and share * weight[s] > 2 * size[s]}
        if not over:
            target = {s: 2.0 * size[s] if s in full else share * weight[s] for s in order}
            break
        full |= over
    taken = Counter()
    for r in got:
        assert r.mix_source_size == size[r.source] and r.mix_target == pytest.approx(target[r.source])
        assert 0 <= r.mix_takes <= 2
        taken[r.source] += r.mix_size * r.mix_takes
    assert all(abs(taken[s] - target[s]) <= 30 for s in order)
    again = {(r.doc_id, r.mix_takes) for r in mixing.mixed(_docs(spark, rows[::-1])).collect()}
    assert again == {(r.doc_id, r.mix_takes) for r in got}
    with pytest.raises(ValueError):
        mixing.mixed(_docs(spark, rows).withColumn("mix_size", F.lit(1)))


@pytest.mark.parametrize("ident", [None, 7])
def test_mix_takes_some_of_equal_rows(spark, ident):
    """Rows of one id and text: a source of them alone, one beside other rows, a null source."""
    rows = [(ident, "ten words " * 5, "a")] * 400 + [(i, "w " * (i % 9), "b") for i in range(300)] + \
        [(ident, "of null " * 3, None)] * 250 + [(1000 + i, "x y", None) for i in range(20)] + [(ident, None, "a")] * 3
    got = mixing.mixed(_docs(spark, rows).repartition(7)).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    taken, target = Counter(), {r.source: r.mix_target for r in got}
    for r in got:
        assert 0 <= r.mix_takes <= 2
        taken[r.source] += r.mix_size * r.mix_takes
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)


def test_url_rules(spark):
    cases = [("http://example.org/es/1", "example.org/es/", "block"), ("http://A.Example.ORG/es", "org/", "allow"),
             ("http://example.org/en/12?x", "example.org/en/1", "block"), ("http://x.com/fr/", "com/fr/", "allow"),
             ("http://com/de/#x", "com/de/", "block"), ("http://notorg/", None, "allow"), ("http://example.org", None, "allow"),
             ("ftp://m.free-bets.example.net/en", None, "block"), ("http://free-bets.example.net.evil.net/", None, "allow"),
             ("no scheme", None, "allow"), (None, None, "allow"), ("://", None, "allow"), ("http://../es/", None, "allow")]
    df = spark.createDataFrame([(i, u, "x", "y") for i, (u, _, _) in enumerate(cases)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_archives(spark):
    big = "é" * 600
    rows = [(1, "u", big), (2, "u\n", big), (9, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big)]
    df = spark.createDataFrame([r + ("x",) for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.read_archives(warc.archive(df)).collect()}
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert len(got) == 7 and {r.payload_digest for r in got.values() if r.payload_bytes == 1200} == {sha}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("revisit", 9), 2: ("revisit", 9), None: ("revisit", 9), 9: ("response", None), 4: ("response", None),
        5: ("response", None), 6: ("response", None)}
    assert bytes(got[9].payload).decode() == big and got[6].payload_bytes == 0


def test_token_files(spark):
    rows = [(7, "b a", "s"), (3, None, "s"), (None, "hello there", "s"), (7, "a", "s"), (5, "x " * 3000, "s")]
    manifest, dictionary = token_files.write_token_files(_docs(spark, rows))
    got = sorted(token_files.read_token_files(manifest, dictionary).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None, 3, 5, 7, 7]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    assert got[1].ids == [2] and got[3].n_tokens < got[4].n_tokens and got[2].n_tokens == 3001
    shard = [token_files.ShardReader(r.uri, dictionary) for r in manifest.collect()]
    assert max(len(s.find(5)) for s in shard if s.find(5) is not None) == 3001 and all(s.find(99) is None for s in shard)
    with pytest.raises(ValueError):
        token_files.ShardReader(manifest.first().uri, dictionary + b"x")


def test_site_style_tree_cuts_what_repeats(spark):
    pages = [(i, f"http://h/{i}", f"<div class=q{i}><p>same words</p></div><div class=body><p>text {i * i}</p></div>"
                                  "<div class=strip><span>same strip</span></div>") for i in range(12)]
    pages += [(50, None, None), (51, "x", ""), (None, "http://h/9", "<article>a</article>")]
    df = spark.createDataFrame([p + (1,) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in html_text.main_texts(df).collect()}
    assert got[3] == "text 9" and got[50] == got[51] == "" and got[None] == "a" and len(got) == 15


def test_copies_of_a_page_do_not_empty_it(spark):
    page = "<html><body><div class=wrap><article><div class=entry><p>{}</p></div></article></div></body></html>"
    pages = [(i, f"http://copies/{i}", page.format("same") + f"<!-- {i} -->") for i in range(12)]
    pages += [(12, "http://copies/u", page.format("unique")), (13, "http://plain/u", "<body><p>one</p></body>")]
    pages += [(20 + i, "http://plain/c", "<body><p>copy</p></body>") for i in range(12)]
    # equal articles of unequal pages are cut, but not to nothing
    pages += [(40 + i, f"http://near/{i}", page.format("near") .replace("<p>", f"<p>v{i // 12}</p><p>")) for i in range(15)]
    df = spark.createDataFrame([p + (1,) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in html_text.main_texts(df).collect()}
    assert {got[i] for i in range(12)} == {"same"} and got[12] == "unique" and got[13] == "one" and got[20] == "copy"
    assert got[40] == "v0\n\nnear" and got[54] == "v1\n\nnear"
    whole = html_text.Page(page.format("x"), frozenset(html_text.Page(page.format("y")).paths))
    assert whole.main_text() == "x"


def test_importance_decides_over_names_of_what_is_around(spark):
    page = ("<div class='has-nav box'><p>page {} on rivers</p></div><div class=plain><p>same strip</p></div>"
            "<div class='related posts'><p>same list</p></div><aside>same aside</aside>")
    pages = [(i, f"http://many/{i}", page.format(i * i)) for i in range(12)] + [(20, "http://few/1", page.format("x"))]
    df = spark.createDataFrame([p + (1,) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in html_text.main_texts(df).collect()}
    assert all(got[i] == f"page {i * i} on rivers" for i in range(12)) and got[20] == "same strip"
    for source in ("<article class='post has-sidebar'><p>x</p></article>", "<main id=no-sidebar><p>x</p></main>",
                   "<div id=content-sidebar><p>beside</p><div><article><p>x</p></article></div></div>"):
        assert html_text.Page(source).main_text() == "x"
    assert html_text.Page("<aside><article><p>teaser</p></article></aside><p>x</p>").main_text() == "x"


def test_quality_rows(spark):
    rows = _corpus(4, 60)
    got = quality.score_documents(_docs(spark, rows), None).collect()
    key = lambda t: tuple(map(str, t))
    want = []
    for i, text, _ in rows:
        w, x = _words(text), text or ""
        count, mark = Counter(zip(w, w[1:], w[2:])), set()
        for p in range(len(w) - 2):
            if count[tuple(w[p:p + 3])] > 1:
                mark.update(range(p, p + 3))
        lines = [line for line in x.split("\n") if _words(line)]
        bad = len(w) < 50 or 100 * len(mark) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(mark), bad, not bad))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                   for r in got), key=key) == sorted(want, key=key)


def test_training_takes_one_row_per_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, label: seen.append((len(rows), sorted(label))))
    docs = _docs(spark, [(1, f"hot text {i}", "s") for i in range(50)] + [(2, "b", "s"), (2, None, "s"), (3, None, "s")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    quality.train(docs, labels)
    assert seen == [(3, [0, 1, 1])]


def test_encode_rows(spark):
    rows = [(1, "Hello  world <|endoftext|>", "s"), (2, None, "s"), (1, "", "s"), (None, "x", "s")]
    got = bpe.encode_texts(_docs(spark, rows)).collect()
    assert [r.n_tokens for r in got if r.ids] == [len(r.ids) for r in got if r.ids] and 50256 in got[0].ids
    assert got[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t, _) in zip(got, rows))


def test_empty_tables(spark):
    docs, none = _docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_text.near_duplicates(docs).count() == substrings.repeated_passages(docs).count() == 0
    assert mixing.mixed(docs).count() == bpe.encode_texts(docs).count() == 0
    assert quality.train(docs, none) is None and quality.score_documents(docs, None).count() == 0
    manifest, dictionary = token_files.write_token_files(docs)
    assert token_files.read_token_files(manifest, dictionary).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge_urls(pages).count() == html_text.main_texts(pages).count() == 0
    assert warc.read_archives(warc.archive(pages)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors.near_duplicate_vectors(vectors).count() == 0


def test_stages_keep_columns_and_take_effect(spark, tmpdir_new):
    rows = _corpus(9, 80)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "extra") for i, t, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, part string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(tmpdir_new + "/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, tmpdir_new)
    assert good.columns == docs.columns and 0 < good.count() < len(rows)
    single = stages["near_dedup"](spark, docs, tmpdir_new)
    kept = {r.component_id for r in near_text.near_duplicates(docs).where("doc_id is not null").collect()}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == kept | {None}
    cut = stages["substring_dedup"](spark, docs, tmpdir_new)
    want = {(r.doc_id, r.n_words - r.n_removed) for r in substrings.repeated_passages(docs).collect()}
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert {(r.doc_id, len(_words(r.text))) for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    mix = stages["mix_sources"](spark, docs, tmpdir_new)
    takes = Counter()
    for r in mixing.mixed(docs).where("mix_takes > 0").collect():
        takes[r.doc_id, r.text, r.source] += r.mix_takes
    assert mix.columns == docs.columns and Counter((r.doc_id, r.text, r.source) for r in mix.collect()) == takes
    assert stages["bpe_encode"](spark, mix, tmpdir_new).count() == mix.count()

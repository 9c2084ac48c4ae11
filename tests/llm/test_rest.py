"""Ops 5, 6, 8, 10 and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from modelgauge.llm import bounded_ring, hamming_minhash, mtree_topk, queries, subword_quality, suffix_radix, wrapper_html

DATA = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_quality_learns_junk(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        junk = i % 4 == 0
        text = words(rng, 60)
        if junk:
            text = [" ".join(w + "$$$" for w in text.split()), text.split()[0] + (" " + text.split()[0]) * 60, text.upper()][i % 3]
        docs.append((i, text, 1.5))
        labels.append((i, int(not junk), 0))
    docs += [(1000, None, 0.0), (1001, "", 0.0), (1002, "x", 0.0), (None, "no id", 0.0), (5, docs[5][1], 1.5)]
    labels += [(3, None, 1), (None, 1, 1), (5, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = subword_quality.score(d, subword_quality.learn(d, lab)).withColumn("held", subword_quality.held_out()).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) >= 0.95 * len(held)
    empty = {r["score"] for r in out if r["doc_id"] in (1000, 1001)}
    assert len(empty) == 1
    none = subword_quality.learn(d, lab.where("false"))
    assert {r["score"] for r in subword_quality.score(d, none).collect()} == {0.5}
    assert subword_quality.score(d.where("false"), none).count() == 0


def test_quality_held_out_accuracy(spark):
    out = queries.op5_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = out.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.97


def brute_top(rows, asks, k=5):
    table = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for q, v in table:
        if q in asks:
            best = sorted((-int(x @ v), i) for i, x in table if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(set(out))


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(4, 8))
    rows = [(i, [float(x) for x in centers[i % 4] + 0.2 * rng.normal(size=8)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # many equal vectors: ties go to smaller ids
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [9.0] * 8), (2004, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, part int, score int")
    kept = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_top(kept, {i for i, _ in rows if i is not None and i % 50 == 0})
    monkeypatch.setattr(mtree_topk, "PART_ROWS", 120)
    monkeypatch.setattr(mtree_topk, "LEAF", 8)
    monkeypatch.setattr(mtree_topk, "ROUTES", 5)
    monkeypatch.setattr(mtree_topk, "QUERY_BLOCK", 7)
    found = mtree_topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, found.collect())) == want
    assert mtree_topk.top_k(frame.where("false"), frame.where("false")).count() == 0
    few = frame.where("vec_id < 3")
    assert sorted(map(tuple, mtree_topk.top_k(few, few.where("vec_id = 0"), 5).collect())) == brute_top(kept[:3], {0})


def test_tree_skips_distances():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * (rng.normal(size=(20, 6))[rng.integers(0, 20, 3000)] * 3 + 0.05 * rng.normal(size=(3000, 6))))
    top = float((rows * rows).sum(axis=1).max())
    pages = mtree_topk.build("p", np.arange(3000), mtree_topk.lifted(rows, top))
    tree = mtree_topk.Tree(__import__("pandas").DataFrame(pages, columns=[c.split()[0] for c in mtree_topk.PAGE.split(", ")]), 7, top)
    seen = []

    class Counted(dict):
        def __getitem__(self, key):
            seen.append(key)
            return super().__getitem__(key)

    tree.pages = Counted(tree.pages)
    tree.search(rows[0], 0, 5, -np.inf)
    assert len(set(seen)) < len(pages) / 2


def test_sharding(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 30)), 7) for i in range(1001)] + [(5000, None, 1), (5001, "", 1), (None, "x", 1), (4, words(rng, 3), 1), (4, "same", 1), (4, "same", 1)]
    out = bounded_ring.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard int")).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    assert bounded_ring.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ring_moves_little():
    rng = random.Random(7)
    counts = {}
    for _ in range(20000):
        s = rng.randrange(bounded_ring.SLICES)
        counts[s] = counts.get(s, 0) + 1

    def of(shards):
        return {(at, r): s for at, a, b, s, _ in bounded_ring.plan(counts, shards) for r in range(a, b)}

    before, after = of(16), of(17)
    assert set(before) == set(after)
    assert sum(before[k] != after[k] for k in before) < 0.5 * len(before)


ARTICLE = "<h1>Head &amp; line</h1><p><b>First\n part<br><p>Second&nbsp;one &#233;</p>"
PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>"</script></head><body><nav><ul><li><a href="/x">Menu {n}</a></li></ul></nav><!-- ad --><div class="ad">Buy {n}</div><article>{a}</article><footer>&copy; foot</footer></body></html>'
PLAIN = '<html><body><div>Site name</div><div id="c"><p>Story {n}</p><p>More {n}</p></div><div>All rights reserved</div></body></html>'
TEXT = "Head & line First part Second one é"


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.replace("{n}", str(i)).replace("{a}", ARTICLE)) for i in range(5)]
    rows += [(10 + i, f"https://b.example:80/{i}?x", PLAIN.replace("{n}", str(i))) for i in range(5)]
    rows += [(20, "http://c.example/", None), (21, None, ""), (22, "odd", "<article>cut <b>off</arti"), (23, "http://d.example/", "plain words &lt;"), (24, "http://d.example/", rows[0][2][: rows[0][2].index("Second") + 9])]
    rows += [(25, "http://e.example/", "<main><header>Own head</header><p>In<b>line</b></p><form>f</form><aside>s</aside><div class='comments'>c</div><p hidden>h</p></main>"), (0, "http://a.example/0", rows[0][2])]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, host string, seed string")
    out = {}
    for r in wrapper_html.extract(frame).collect():
        out.setdefault(r["page_id"], []).append(r["text"])
    assert len(out[0]) == 2 and {t for i in range(5) for t in out[i]} == {TEXT}
    assert [out[10 + i] for i in range(5)] == [[f"Story {i} More {i}"] for i in range(5)]
    assert (out[20], out[21], out[22], out[23]) == ([""], [""], ["cut off"], ["plain words <"])
    assert out[24] == ["Head & line First part Second"] or out[24][0].startswith("Head & line First part Second")
    assert out[25] == ["Own head Inline"]
    assert wrapper_html.extract(frame.where("false")).count() == 0


def test_template_decides_inside_articles(spark):
    """Constant notices inside an article go, and text outside of a teaser's article stays, on hosts with enough different pages."""
    page = "<html><body><div>Site name</div><article><p>Share this page</p><p>Story {n}</p><p>Terms apply</p></article></body></html>"
    teaser = "<body><div>Site</div><div><p>Long story {n}</p></div><article><h3>Read also</h3></article></body>"
    rows = [(i, "http://a.example/", page.replace("{n}", str(i))) for i in range(5)] + [(10 + i, "http://b.example/", teaser.replace("{n}", str(i))) for i in range(5)]
    rows += [(20 + i, "http://c.example/", page.replace("{n}", "9")) for i in range(5)]  # copies do not make a template
    out = {r["page_id"]: r["text"] for r in wrapper_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(5)] == [f"Story {i}" for i in range(5)]
    assert [out[10 + i] for i in range(5)] == [f"Long story {i}" for i in range(5)]
    assert {out[20 + i] for i in range(5)} == {"Share this page Story 9 Terms apply"}


def test_tree_matching():
    a = wrapper_html.parse("<div><p>x</p><ul><li>1</li></ul><p>y</p></div>")
    b = wrapper_html.parse("<div><p>x</p><p>y</p><span>z</span></div>")
    size, pairs = wrapper_html.match(a, b)
    assert size == 4 and len(pairs) == 4


def test_tree_matching_of_wide_nodes():
    """A menu whose only like-named partner stands behind the footer must not consume the footer, however many children there are."""

    def largest(a, b):
        x, y = a.nodes(), b.nodes()
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (largest(p, q) if p.name == q.name else 0))
        return 1 + best[-1][-1]

    a = wrapper_html.parse("<body><ul>menu</ul>" + "<p>x</p><div><i>d</i></div>" * 40 + "<footer>foot</footer></body>")
    b = wrapper_html.parse("<body>" + "<div><b>e</b></div><p>y</p>" * 40 + "<footer>foot</footer><ul>more</ul></body>")
    size, pairs = wrapper_html.match(a, b)
    assert size == len(pairs) == largest(a, b)
    assert [p.own_text() for s, p in pairs if s.name == "footer"] == ["foot"]
    rng = random.Random(8)
    for n in (1, 3, 20, 61, 150):
        x, y = (wrapper_html.parse("".join(rng.choice(["<p>t</p>", "<div><p>t</p></div>", "<ul><li>a<li>b</ul>", "<div><i>c</i></div>"]) for _ in range(n))) for _ in range(2))
        size, pairs = wrapper_html.match(x, y)
        assert size == len(pairs) == largest(x, y)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"others": F.lit(1), "score": F.lit("s"), "node": F.lit(2.5)})
    found = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, found = found, stage(spark, found, DATA)
        assert found.columns == docs.columns, name
        kept = found.select("doc_id").join(before.select("doc_id"), "doc_id", "left_anti").count()
        assert kept == 0
    near = hamming_minhash.near_components(corpus_pipeline.quality(spark, docs, DATA).select("doc_id", "text")).where("kept").select("doc_id")
    assert sorted(r[0] for r in near.collect()) == sorted(r[0] for r in found.select("doc_id").collect())
    texts = [r["text"] for r in found.collect()]
    seen = set()
    for text in texts:  # no run of 50 words stands twice any more, but where a cut has joined what was apart
        w = text.split()
        runs = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        assert not seen & set(runs)
        seen |= set(runs)
    assert found.where("n_chars <> length(text)").count() == 0
    placed = corpus_pipeline.STAGES[-1][1](spark, found, DATA)
    assert placed.select("doc_id").distinct().count() == found.count()
    assert placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_cuts_planted_passages(spark):
    """Passages of exactly 50 and of 51 short words (under 400 bytes) that stand in several documents go, those of 49 stay, clean documents too."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 5)))
    plant = {n: " ".join(word() for _ in range(n)) for n in (49, 50, 51)}
    assert max(map(len, plant.values())) < 400
    own = {i: (" ".join(word() for _ in range(60)), " ".join(word() for _ in range(30))) for i in range(12)}
    rows = [(i, f"{a} {plant[(49, 50, 51)[i % 3]]}\n{b}" if i < 9 else f"{a} {b}", "en", "s", 0) for i, (a, b) in own.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, DATA).collect()}
    assert {i: t.split() for i, t in out.items()} == {i: (rows[i][1] if i % 3 == 0 or i > 8 else f"{a} {b}").split() for i, (a, b) in own.items()}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_pipeline_stage_on_odd_rows(spark, stage):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (3, "a b c d e f", None, "s", 11), (3, "a b c d e f", "en", "s", 11)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, frame, DATA).count() >= 3
    assert stage(spark, frame.where("false"), DATA).count() == 0


def test_run_matches_its_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_class_words_are_weak_evidence(spark):
    """Whole words of a class only, and never against the article or most of the page's text; a page nested 100,000 deep returns."""
    body = {
        1: '<div class="no-sidebar content"><p>A story of some length</p></div><div>x</div>',
        2: '<div class="post side-by-side"><p>B story</p></div>', 3: '<div id="related-work"><p>C story</p></div>', 4: '<p class="social-history">D story</p>',
        5: '<div class="related"><article><p>E story</p></article></div>', 6: '<div class="notice"><p>F is nearly the whole page</p></div><p>G</p>', 7: '<p>H is nearly the whole page</p><div class="big sidebar">I</div>',
        8: '<div>J<div class="share"><b>K</b></div>L</div><div class="x y">M M M M</div>', 9: "<div>" * 100_000 + "N" + "</div>" * 100_000, 10: "<b><p>" * 50_000 + "O", 11: "<ul>" + "<li><b>" * 50_000 + "P</i></u>" * 3,
    }
    want = {1: "A story of some length x", 2: "B story", 3: "C story", 4: "D story", 5: "E story", 6: "F is nearly the whole page G", 7: "H is nearly the whole page", 8: "J L M M M M", 9: "N", 10: "O", 11: "PPP"}
    rows = [(i, f"http://h{i}.example/", f"<html><body>{t}</body></html>") for i, t in body.items()]
    rows += [(100 + i, "http://deep.example/", "<html><body>" + "<div>" * (30_000 + i) + f"text {i}" + "<i>" * 20_000) for i in range(3)]
    out = {r["page_id"]: r["text"] for r in wrapper_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == want | {100 + i: f"text {i}" for i in range(3)}


def plain_blocks(page):
    """(path, text) of the blocks of a page, by a parser of another make."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.out, self.kept = [], [], {}

        def handle_starttag(self, tag, attrs):
            if tag not in wrapper_html.INLINE and tag not in wrapper_html.VOID:
                self.path.append(tag)
                self.out.append([tuple(self.path), []])
                self.kept[len(self.path)] = len(self.out) - 1

        def handle_endtag(self, tag):
            if tag not in wrapper_html.INLINE and tag in self.path:
                del self.path[len(self.path) - 1 - self.path[::-1].index(tag) :]

        def handle_data(self, data):
            if self.path:
                self.out[self.kept[len(self.path)]][1].append(data)

    reader = Reader()
    reader.feed(page)
    return [(p, " ".join("".join(t).split())) for p, t in reader.out]


def test_template_is_what_pages_of_a_host_share(spark):
    """Blocks that all pages of a host have at the same path with the same text go, all others stay, counted without any alignment."""
    rng = random.Random(11)
    rows, pages = [], {}
    for host in range(4):
        fixed = [f"<p>Shared {host} {i} <b>words</b></p>" for i in range(4)]
        for n in range(9):
            parts = fixed[:2] + [f"<p><b>Summary</b> {rng.randrange(10**9)} and <i>more</i> {n}</p>" for _ in range(rng.randint(1, 40))] + fixed[2:]
            page = "<html><body><div>" + "".join(parts) + f"</div><section><div>Story {host} {n}</div></section></body></html>"
            rows.append((host * 100 + n, f"http://h{host}.example/{n}", page))
            pages.setdefault(host, []).append((host * 100 + n, plain_blocks(page)))
    want = {}
    for of_host in pages.values():
        shared = set.intersection(*({b for b in blocks if b[1]} for _, blocks in of_host))
        want |= {i: " ".join(t for p, t in blocks if t and (p, t) not in shared) for i, blocks in of_host}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrapper_html.extract(frame).collect()} == want


def test_a_large_host_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(wrapper_html, "BLOCK_PAGES", 4)
    rows = [(i, "http://a.example/", f"<body><p>Same words</p><p>Story {i}</p></body>") for i in range(60)] + [(100 + i, f"http://b{i}.example/", "<p>Own</p>") for i in range(9)] + [(300, "http://a.example/", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrapper_html.extract(frame).collect()} == {i: f"Story {i}" for i in range(60)} | {100 + i: "Own" for i in range(9)} | {300: ""}
    hosts, known = wrapper_html.templates(frame.withColumn("host", wrapper_html.host_of(F.col("url"))).select("host", "page_id", "html"))
    dealt = wrapper_html._blocks(frame.withColumn("host", wrapper_html.host_of(F.col("url"))).select("host", "page_id", "html"), hosts, known)
    assert dealt.where("kind = 0").count() == 15 and [r["host"] for r in known.collect()] == ["a.example"]


def test_given_pages(spark):
    """All pages of the given table against the text of their article elements, read by a parser of another make."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.out = 0, []

        def edge(self, tag, by):
            self.depth += by * (tag == "article")
            if tag not in wrapper_html.INLINE:
                self.out.append(" ")

        def handle_starttag(self, tag, attrs):
            self.edge(tag, 1)

        def handle_endtag(self, tag):
            self.edge(tag, -1)

        def handle_data(self, data):
            if self.depth > 0:
                self.out.append(data)

    def text(page):
        reader = Reader()
        reader.feed(page)
        return " ".join("".join(reader.out).split())

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    out = queries.op10_html_text(spark, DATA).collect()
    want = {r["page_id"]: text(r["html"]) for r in pages.collect()}
    assert len(out) == len(want) and {r["page_id"]: (r["text"], r["n_chars"]) for r in out} == {i: (t, len(t)) for i, t in want.items()}

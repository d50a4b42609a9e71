"""Classifiers by held-out accuracy, page text by templates, and every operator on odd tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def labelled(spark, op, label, cut):
    from sedge.llm import queries

    out = queries.queries()[op](spark, SF)
    return out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "held_out", "score", "predicted", F.col(label).alias("y")).toPandas(), out


def test_quality_held_out(spark):
    rows, out = labelled(spark, "op6_quality", "quality", 0.5)
    held = rows[rows.held_out]
    assert len(held) > 60 and ((held.predicted == held.y).mean()) >= 0.95
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_toxicity_held_out(spark):
    rows, out = labelled(spark, "op3_toxicity", "toxic", 0.7)
    held = rows[rows.held_out]
    clean, toxic = held[held.y == 0], held[held.y == 1]
    assert (clean.predicted == 0).mean() >= 0.97
    # over all held-out toxic rows, those that hold no toxic word at all too (labels of this table are toxic at random for 4 of 18)
    assert len(toxic) >= 18 and (toxic.predicted == 1).mean() >= 0.75
    # of toxic rows with a word that toxic training rows share and clean training rows lack, nearly all
    docs = {r["doc_id"]: {w.strip(".,").lower() for w in (r["text"] or "").split()} for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    learnt = rows[~rows.held_out]
    times = [Counter(w for i in learnt[learnt.y == y].doc_id for w in docs[i]) for y in (0, 1)]
    telling = {w for w, n in times[1].items() if n >= 4 and not times[0][w]}
    told = toxic[[bool(docs[i] & telling) for i in toxic.doc_id]]
    assert len(told) >= 10 and (told.predicted == 1).mean() >= 0.9
    assert rows.score.between(0, 1).all()
    assert {"doc_id", "held_out", "score", "predicted"} <= set(out.columns)


def segments_by_definition(scores, lo, hi):
    """The best segment (shortest on ties), then the same left and right of it."""
    found, sums = None, [0.0]
    for s in scores[lo:hi]:
        sums.append(sums[-1] + s)
    for i in range(hi - lo):
        if scores[lo + i] <= 0:
            continue
        for j in range(i + 1, hi - lo + 1):
            v = sums[j] - sums[i]
            if v > 1e-9 and (found is None or v > found[2] + 1e-9 or abs(v - found[2]) <= 1e-9 and j - i < found[1] - found[0]):
                found = (i + lo, j + lo, v)
    if found is None:
        return []
    return segments_by_definition(scores, lo, found[0]) + [found] + segments_by_definition(scores, found[1], hi)


def test_vectors_of_the_largest_doubles_link(spark):
    from sedge.llm import embeddings

    rng = random.Random(2)
    near = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(1, [1e300 * v for v in near], 0), (2, [1e-300 * v for v in near], 0), (3, [v + 1e-3 for v in near], 0), (4, [-v for v in near], 0), (5, [1.7e308] + [0.0] * 7, 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_maximal_segments_equal_definition():
    from sedge.llm.toxicity import maximal_segments

    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice((-3.5, -1.25, -0.5, 0.75, 1.5, 2.125, 5.0)) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        got, want = maximal_segments(scores), segments_by_definition(scores, 0, len(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_training_rows_are_bounded_and_not_held_out(spark, docs_of):
    from sedge.llm.common import crc_held_out
    from sedge.llm.labelled import training_rows

    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 330)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(7, 0), (9, None), (None, 1)], "doc_id bigint, quality int")
    got = training_rows(docs_of(rows), labels, "quality", 40).collect()
    assert 40 <= len(got) <= 80 and not any(crc_held_out(r["doc_id"]) for r in got)
    assert len({r["text"] for r in got if r["label"] == 0}) == sum(r["label"] == 0 for r in got)


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("just a line of text", "just a line of text"),
        ("<article><h1>T &amp; U</h1><p>a\n  b<br>c<p>short</article><footer>no</footer>", "T & U\na b c\nshort"),
        ("<nav>menu</nav><main><p>one</p><aside>side</aside><form>f<input></form><div class='comment-list'>c</div><p>two</main>", "one\ntwo"),
        ("<article><p>x<script>var a='</p><p>no';</script>y</p><!-- <p>no --><style>p{}</style></article>", "xy"),
        ("<article><p>1 &lt; 2 &#39;q&#39; &nbsp; z</p><div class=cookie-notice>no</div></article>", "1 < 2 'q' z"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>body</p></article>", "Title\nbody"),
        ("<article><p title='a > b'>in</p><p hidden>no</p><p style='display: none'>no</p></article>", "in"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
        ("<article></article><div>outside</div>", "outside"),
    ],
)
def test_page_text(html, text):
    from sedge.llm.html_text import main_text

    assert main_text(html) == text


def test_page_without_article_markup():
    from sedge.llm.html_text import main_text

    menu = "".join(f"<div><a href='/{i}'>Link number {i} in the menu</a></div>" for i in range(12))
    body = "".join(f"<div>Paragraph {i} of the text, which is long enough to be told from a menu of links.</div>" for i in range(8))
    lines = main_text(f"<body>{menu}{body}{menu}</body>").split("\n")
    assert len(lines) == 8 and all(line.startswith("Paragraph") for line in lines)


def test_one_long_paragraph_hides_no_other():
    from sedge.llm.html_text import main_text

    lead = "".join(f"<div>Lead {i:3d} {'word ' * 28}</div>" for i in range(10))
    links = "".join(f"<div><a href='/{i}'>Link number {i} in the menu</a></div>" for i in range(5))
    page = f"<body>{links}{lead}<div>Long {'word ' * 4000}</div>{links}<div>Second {'part ' * 30}</div>{links}</body>"
    assert [line.split()[0] for line in main_text(page).split("\n")] == ["Lead"] * 10 + ["Long", "Second"]


def test_surge_and_dive_decide_inside_an_article():
    """Runs of links before the first surge and after the last dive go; a list of links between paragraphs, or below a heading, stays."""
    from sedge.llm.html_text import main_text

    links = "".join(f"<li><a href='/{i}'>Another story of the day {i}</a></li>" for i in range(4))
    stories = "\n".join(f"Another story of the day {i}" for i in range(4))
    page = f"<article><ul>{links}</ul><h1>Title</h1><p>short</p>%s<p>end</p>%s</article>"
    assert main_text(page % ("", f"<p><a href='/x'>more</a></p><ul>{links}</ul>")) == "Title\nshort\nend"
    assert main_text(page % (f"<ul>{links}</ul>", "<p><a href='/x'>more</a></p>")) == f"Title\nshort\n{stories}\nend"
    assert main_text(page % ("", f"<h2>References</h2><ul>{links}</ul>")) == f"Title\nshort\nend\nReferences\n{stories}"


@pytest.mark.parametrize("name", ["market-share", "social-impact", "ad-hoc-networks", "comment-syntax", "most-popular", "related", "login-form"])
@pytest.mark.parametrize("element", ["section", "article", "figure", "div"])
@pytest.mark.parametrize("outer", ["article", "main"])
def test_headings_anchors_are_no_boilerplate(name, element, outer):
    from sedge.llm.html_text import main_text

    title = name.replace("-", " ").capitalize()
    page = f"<{outer}><h1>T</h1><p>before</p><{element} id='{name}'><h2>{title}</h2><p>inside</p></{element}><p>after</p></{outer}>"
    assert main_text(page) == f"T\nbefore\n{title}\ninside\nafter"


@pytest.mark.parametrize("name", ["social-impact", "ad-hoc-networks", "comment-syntax", "share-price", "bannerman", "formula", "adverbs", "sharecroppers", "cookie-recipes"])
def test_names_that_only_hold_a_mark_stay(name):
    from sedge.llm.html_text import main_text

    assert main_text(f"<article><p>a</p><div class='{name}'>b</div></article>") == "a\nb"


@pytest.mark.parametrize(
    "markup", ["div class='comments-area'", "div id=comments", "section class=comments", "div class='social share-buttons'", "div class='c-ad__slot'", "div class='acme-footer'", "ul class='site-nav'", "div class='wp-block-newsletter'", "div class='most-popular'", "div class='cookie-consent-banner'"]
)
def test_marked_boilerplate_goes(markup):
    from sedge.llm.html_text import main_text

    assert main_text(f"<article><p>a</p><{markup}>b <p>c</p></{markup.split()[0]}><p>d</p></article>") == "a\nd"


def test_short_lines_beside_a_surge_and_long_links_stay():
    from sedge.llm.html_text import main_text

    long = "word " * 60
    menu = "".join(f"<div><a href='/{i}'>Link {i}</a></div>" for i in range(5))
    assert main_text(f"<body>{menu}<h1>Title</h1><p>short</p><p>{long}</p>{menu}<div>(c) us</div></body>") == f"Title\nshort\n{long.strip()}"
    linked = f"<article><h2>B</h2><p><a href=x>{long}</a></p><p>end</p></article>"
    assert main_text(f"<main><article><h1>A</h1><p>{long}</p></article>{linked}</main>") == f"A\n{long.strip()}\nB\n{long.strip()}\nend"


def kept_by_definition(weights, surge):
    """Lines between a surge and the dives around it, line by line: those with fewer than three weightless lines at a stretch between them and a line of a window that reaches the threshold."""
    n = len(weights)
    full = [i for i in range(n) if weights[i]]
    groups = []
    for i in full:
        if groups and i - groups[-1][-1] <= 3:
            groups[-1].append(i)
        else:
            groups.append([i])
    return [(g[0], g[-1] + 1) for g in groups if max(sum(weights[i : i + 3]) for i in range(max(0, g[0] - 2), g[-1] + 1)) >= surge]


def test_regions_equal_the_definition():
    from sedge.llm.html_text import surges_to_dives

    rng = random.Random(8)
    for _ in range(3000):
        weights = [rng.choice((0, 0, 0, 1, 5, 40, 300)) for _ in range(rng.randint(0, 25))]
        surge = rng.choice((1, 5, 30, 60, 200))
        assert surges_to_dives(weights, surge) == kept_by_definition(weights, surge)


def unmarked_pages(count, seed=6):
    """Pages without a tag that names anything: (html, the text between menus), lengths drawn at random."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    for _ in range(count):
        link = lambda: f"<div><a href='/x'>{' '.join(rng.choices(words, k=rng.randint(1, 4)))}</a></div>"
        menu = lambda: "".join(link() for _ in range(rng.randint(3, 9)))
        bodies = [[" ".join(rng.choices(words, k=rng.choice((2, 5, 30, 200)))) for _ in range(rng.randint(2, 8))] + [" ".join(rng.choices(words, k=40))] for _ in range(rng.randint(1, 3))]
        html = "<body><div>x y</div>" + "".join(menu() + "".join(f"<div>{t}</div>" for t in body) for body in bodies) + menu() + "<div>z 1</div></body>"
        yield html, "\n".join(t for body in bodies for t in body)


def test_lengths_alone_tell_text_from_menus(monkeypatch):
    """200 pages without markup: text is what lies between menus; without surges and dives every page would differ, and marked pages with link lists too."""
    from sedge.llm import html_text

    pages = list(unmarked_pages(200))
    for html, text in pages:
        assert html_text.main_text(html) == text
    marked = ["<article><ul>" + "<li><a href=x>one story</a></li>" * k + "</ul><h1>T</h1><p>body text</p></article>" for k in range(3, 20)]
    with_regions = [html_text.main_text(h) for h in marked]
    monkeypatch.setattr(html_text, "surges_to_dives", lambda weights, surge: [(0, len(weights))])
    assert all(html_text.main_text(html) != text for html, text in pages)
    assert all(html_text.main_text(h) != t for h, t in zip(marked, with_regions, strict=True))


def test_long_page_in_linear_time():
    from sedge.llm.html_text import main_text

    assert len(main_text("<article>" + "<p>" + "<b" * 20000 + "x" + "<p>word" * 20000)) > 0


def test_odd_tables(spark, docs_of):
    """Empty tables, nulls in every column and rows that repeat: every operator gives its schema and its rows."""
    from sedge.llm import decontaminate, embeddings, html_text, licenses, packing, quality, sharding, simhash, substrings, toxicity
    from sedge.llm.queries import tokenizer_path

    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, None, None), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f g"), (None, None)], "item_id bigint, text string")
    odd = docs_of([(1, "one two"), (1, "one two"), (2, None), (None, None), (None, "x"), (3, ""), (4, "\u0000 ퟿ é"), (5, "long " * 60000)])
    for docs, n in ((odd, 8), (odd.where("false"), 0)):
        for lab in (labels, labels.where("false")):
            assert quality.quality(docs, lab).count() == n
            assert toxicity.toxicity(docs, lab).where("score between 0 and 1").count() == n
        assert quality.keep_good(docs, labels.where("false")).columns == docs.columns
        assert simhash.near_duplicates(docs).count() == n
        assert simhash.keep_one(docs).columns == docs.columns
        assert substrings.substring_dedup(docs).count() == n
        assert substrings.remove_repeats(docs).columns == docs.columns
        assert decontaminate.contaminated(docs, bench).count() == 0
        assert decontaminate.keep_clean(docs, bench.where("false")).count() == n
        assert packing.pack_documents(docs, tokenizer_path()).select("doc_id", "piece").count() >= n
        assert licenses.licences(docs).count() == 0
        assert sharding.shard(docs).count() == n
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (1, None, None)], "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    assert sorted(r["n_chars"] for r in html_text.extract(pages).collect()) == [0, 0, 1]
    assert html_text.extract(pages.where("false")).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embeddings.near_vectors(vectors).count() == 0


def test_pipeline_equals_its_parts(spark):
    """run() against the stages' decisions worked out one by one in plain Python: documents, words, pieces and places."""
    import re
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline
    from sedge.llm import quality, substrings
    from sedge.llm.common import table
    from sedge.llm.queries import tokenizer_path
    from tests.llm.test_brute_force import WORD
    from tests.llm.test_similar import kept_by_all_pairs

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    model = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    ids = sorted(docs)
    good = [i for i, s in zip(ids, model.scores([docs[i] for i in ids])) if s >= quality.CUTOFF]
    ones = sorted(kept_by_all_pairs([(i, docs[i]) for i in good]))
    first, left = {}, {}
    for i in ones:
        w = WORD.findall(docs[i])
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        if not all(gone) or not w:
            left[i] = [x for x, g in zip(w, gone) if not g]
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [set(zip(*[plain(r["text"])[k:] for k in range(5)])) for r in table(spark, sf, "benchmark").collect()]
    grams = {i: set(zip(*[plain(" ".join(w))[k:] for k in range(5)])) for i, w in left.items()}
    clean = {i for i in left if not any(len(x & grams[i]) >= 0.6 * len(x) for x in items)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == clean
    # the pieces are those of the texts that the stages left
    tok = Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(table(spark, sf, "documents").where(F.col("doc_id").isin(ones))).collect()}
    want = set()
    for i in clean:
        assert WORD.findall(texts[i]) == left[i]
        ids_ = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, s, len(ids_[s : s + 2048]), zlib.crc32(ids_[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids_), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        assert [o for o, _ in sorted(members)] == list(np.cumsum([0, *[n for _, n in sorted(members)]])[:-1]) and sum(n for _, n in members) <= 2048


@pytest.mark.parametrize(
    "html,text",
    [
        ('<article><div class="entry-header"><h1>Title</h1></div><p>body</p></article>', "Title\nbody"),
        ("<article><p>x <math><mi>a</mi><mo>+</mo><mi>b</mi></math> y</p></article>", "x a+b y"),
        ('<article><p>x <span class="legal">law</span></p><p class="search-term">term</p><div id="skip-list-notes">notes</div></article>', "x law\nterm\nnotes"),
        ("<article><p>a<svg><svg><text>i</text></svg>leak</svg>b</p></article>", "ab"),
        ("<main><article><h1>T</h1><p>long text here</p></article><article><h2><a href=x>Teaser one link</a></h2><p>s</p></article></main>", "T\nlong text here"),
        ('<article>yes<div class="cookie-notice">no</div><div class="commentList">no</div><div class="ad">no</div><div class="site-footer">no</div></article>', "yes"),
    ],
)
def test_page_markup(html, text):
    from sedge.llm.html_text import main_text

    assert main_text(html) == text


def test_pages_equal_an_independent_reader(spark):
    """The template's pages by the standard library's parser: what stands in the article, block by block."""
    from html.parser import HTMLParser

    from sedge.llm.html_text import main_text

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.skip, self.parts, self.out = 0, 0, [], []

        def flush(self):
            line = " ".join("".join(self.parts).split())
            self.out += [line] if line else []
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.skip += tag in ("script", "style")
            if tag == "br":
                self.parts.append(" ")
            elif tag not in ("a", "b", "i", "em", "span", "script", "style"):
                self.flush()

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")
            if tag not in ("a", "b", "i", "em", "span", "script", "style"):
                self.flush()
            self.depth -= tag == "article"

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.parts.append(data)

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        reader = Reader()
        reader.feed(r["html"])
        reader.flush()
        assert main_text(r["html"]) == "\n".join(reader.out)


def test_maximal_segments_in_linear_time():
    import time

    from sedge.llm.toxicity import maximal_segments

    began = time.time()
    assert len(maximal_segments([4.0, -5.0] * 500_000)) == 500_000
    assert time.time() - began < 20


def test_nearest_takes_ties_in_order():
    import numpy as np

    from sedge.llm.quality import nearest

    cosines = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]], np.float32)
    assert nearest(cosines, 3).tolist() == [[0, 1, 2], [0, 1, 2]]


def test_quality_scores_equal_a_loop(spark):
    """Votes of the model's vectors worked out one document and one neighbour at a time."""
    import numpy as np

    from sedge.llm import quality

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ["", None]
    for text, got in zip(texts, model.scores(texts)):
        own = model.latent([text])[0]
        cosines = [round(float(np.float32(own @ v)), 5) for v in model.vectors]
        near = sorted(range(len(cosines)), key=lambda k: (-cosines[k], k))[: quality.NEIGHBOURS]
        weights = [max(cosines[k], 0) ** quality.SHARPNESS * model.voices[k] for k in near]
        want = (sum(w * model.labels[k] for w, k in zip(weights, near)) + 1e-3) / (sum(weights) + 2e-3)
        assert got == pytest.approx(want, abs=2e-3)


def test_toxic_scores_equal_the_definition(spark):
    """A document's score from its segments found by their definition and the sum statistic written out."""
    import math

    from sedge.llm import toxicity

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = docs.where(F.length("text") < 900).orderBy("doc_id").limit(150)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    seen = 0
    for r in rows.collect():
        words = (r["text"] or "").lower().split()
        sums = sorted((s for *_, s in segments_by_definition([model.word_score(w) for w in words], 0, len(words))), reverse=True)[: toxicity.TOGETHER]
        chances = [1.0]
        for k in range(1, len(sums) + 1):
            t = sum(model.rate * s - math.log(model.scale * len(words)) for s in sums[:k])
            if k == 1:
                chances.append(2 * (1 - math.exp(-math.exp(-t))))
            elif t > k:
                chances.append(2**k * math.exp(-t) * t ** (k - 1) / math.factorial(k) / math.factorial(k - 1))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + 9 * min(chances)) if sums else 0.1, abs=1e-6)
        seen += len(sums) > 1
    assert seen


def test_passages_thirty_words_apart_are_two(spark):
    from sedge.llm import toxicity

    model = toxicity.ToxicModel({"^vile$": 6.0, "^foul$": 6.0}, toxicity.OTHER, 1.0, 0.01)
    words = ["calm"] * 100
    words[10:13], words[43:45] = ["vile", "foul", "vile"], ["foul", "vile"]
    segments, _ = toxicity._scored(words, toxicity.WordScores(model))
    assert [(a, b) for a, b, _ in segments] == [(10, 13), (43, 45)]


def test_stages_return_other_columns_as_they_are(docs_of, spark):
    """Columns of any name keep their values through every stage that returns documents."""
    from sedge.llm import decontaminate, quality, sharding, simhash, substrings
    from tests.llm.test_brute_force import corpus

    docs = docs_of([r for r in corpus() if r[0] is not None])
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    for out in (quality.keep_good(docs, labels), simhash.keep_one(docs), substrings.remove_repeats(docs), decontaminate.keep_clean(docs, bench)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == "x" for r in rows for c in extra)
    store = sharding.ShardStore(spark, f"{sharding.shared_dir(spark)}/clash")
    store.append(docs, sharding.arrival_of(F.col("doc_id"), 2), 2)
    rows = store.read(docs.schema).collect()
    assert len(rows) == docs.count() and all(r[c] == "x" for r in rows for c in extra)
    with pytest.raises(ValueError, match="tier"):
        store.read(docs.schema, tier="tier")

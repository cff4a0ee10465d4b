"""HTML extraction, toxicity, language, decontamination, suffix tree, n-gram join and the pipeline."""

import bisect
import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from motorlens.llm import decontaminate, html_text, kernels, language, mixing, ngram_join, suffix_lm, toxicity
from motorlens.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def tokens_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def held_out(doc_id, mod, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == rest


def test_every_operator_has_one_query():
    numbers = Counter(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == Counter(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("table, find", [(kernels.UNSPACED, words_of), (kernels.ALPHANUMERIC, tokens_of)])
def test_words_of_batches(table, find):
    texts = ["Ab\x00c  d\n", None, "", "ÄÖ é x9 z", " ", "no-space,here", "A" * 3000, "\x7f\x1fq"]
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    seen = {}
    for first, data, offsets in kernels.pieces(column, limit=10):
        starts, ends, bounds = kernels.spans(data, offsets, table)
        hashes = kernels.word_hashes(data, starts, ends, table)
        for i in range(len(offsets) - 1):
            expected = find(texts[first + i])
            assert bounds[i + 1] - bounds[i] == len(expected)
            for word, h in zip(expected, hashes[bounds[i] : bounds[i + 1]]):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


# ---- HTML

PAGES = [
    ("<body><header>top</header><nav><a href=x>menu</a></nav><article><h1>Title</h1><p>One <b>b</b>old<br>two\n &amp; three</p>"
     "<aside>side</aside></article><section class='comments'><p>a reader's long comment that says a lot of things here</p></section>"
     "<div id=\"cookie-notice\">We use cookies on this site to give you the best of everything</div><footer>&copy; end</footer></body>",
     "Title One bold two & three"),
    ("<main><p>first<p>second<script>var t='</p>';</script> rest</main><form>search <input></form>", "first second rest"),
    ("<article>a<!-- <p>no</p> -->b <style>p{}</style>&lt;i&gt; &eacute;&#233;</article>", "ab <i> éé"),
    ("<ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>" + "long text " * 20 + "</p><div class=ad>buy</div>", " ".join(["long text"] * 20)),
    ("<article><div class='share'>share me</div><p>kept</p>", "kept"),
    ("", ""), (None, ""), ("<p", ""), ("<html><head><title>t</title></head><body></body></html>", ""),
]


def test_main_text_of_pages(spark):
    rows = [(i, "u", page, "t", 1) for i, (page, _) in enumerate(PAGES)]
    rows += [rows[0], (None, None, "<article>x</article>", None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    found = html_text.extract_pages(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["text"] == ("x" if r["page_id"] is None else PAGES[r["page_id"]][1])
        assert r["n_chars"] == len(r["text"])
    assert html_text.extract_pages(pages.limit(0)).count() == 0


LONG = " ".join(["several plain words of an article"] * 40)


@pytest.mark.parametrize("page", [
    f"<article class='post category-social'><p>{LONG}</p></article>", f"<article class='post no-comments'><p>{LONG}</p></article>",
    f"<main class='content-with-sidebar'><p>{LONG}</p></main>", f"<body class='has-sidebar'><p>{LONG}</p><p>{LONG}</p></body>",
    f"<article class='widget'><p>{LONG}</p></article>", f"<div class='social-studies'><p>{LONG}</p></div>",
    f"<article><div><select>pick one</div><p>{LONG}</p></article>", f"<article><div><object data=x></div><p>{LONG}</p></article>",
])
def test_whole_articles_are_kept(page):
    assert html_text.main_text(page, html_text.train())[0] == " ".join([LONG] * page.count(LONG))


@pytest.mark.parametrize("around", [
    "<nav>{}</nav>", "<form>{}</form>", "<footer>{}</footer>", "<header>{}</header>", "<aside>{}</aside>", "<div class=cookie-notice>{}</div>",
    "<section class=comments>{}</section>", "<div class='post-comments'>{}</div>", "<div id=comments-area>{}</div>",
    "<ol class='comment-list'>{}</ol>", "<div class='x user-comments'>{}</div>", "<div class=site-header>{}</div>", "<div id='site_footer'>{}</div>",
    "<div class='adContainer'>{}</div>", "<div class='sidebar-left'><article>{}</article></div>", "<section id=comments><article class=c>{}</article></section>",
    "<div role=navigation>{}</div>", "<article><div class=related-posts>{}</div></article>", "<aside><main>{}</main></aside>",
])
def test_nothing_around_the_article_comes_out(around):
    tree = html_text.train()
    for prose_ in (f"<p>{LONG}</p>", f"<p>{LONG}</p><p>{LONG}</p><p>a line</p>", "<p>A line.</p>"):
        page = f"<body><p>{LONG[:90]}</p>{around.format(prose_)}<p>{LONG[:60]}</p></body>"
        assert html_text.main_text(page, tree)[0] == f"{LONG[:90].strip()} {LONG[:60].strip()}"


@pytest.mark.parametrize("page, text", [
    ("<article><p>{0}</p><p><a href=x>{1}</a></p><p>{2}</p></article>", "{0} {1} {2}"),
    ("<article><p>Bye.</p><p><a href=x>one linked sentence</a></p><p>End words here of the article.</p></article>",
     "Bye. one linked sentence End words here of the article."),
    ("<form id=page><article><p>{0}</p></article><p>send</p></form>", "{0}"),
    ("<div class=menu-wrapper><main><p>{0}</p></main></div>", "{0}"),
])
def test_nothing_of_an_article_is_lost(page, text):
    parts = (" ".join(LONG.split()[:60]), " ".join(LONG.split()[:20]), " ".join(LONG.split()[:80]))
    assert html_text.main_text(page.format(*parts), html_text.train())[0] == text.format(*parts)


def test_own_links_decide_unmarked_blocks():
    def columns(tree):
        return set() if len(tree) == 1 else {tree[0]} | columns(tree[2]) | columns(tree[3])

    tree = html_text.train()
    assert {0, 1} < columns(tree)
    words = LONG.split()
    for n in (15, 25, 50, 100, 200):
        own, before, after = " ".join(words[:n]), " ".join(words[:40]), " ".join(words[:35])
        for linked in (False, True):
            block = f"<p><a href=x>{own}</a></p>" if linked else f"<p>{own}</p>"
            found = html_text.main_text(f"<div><p>{before}</p>{block}<p>{after}</p></div>", tree)[0]
            assert found == " ".join([before, *([] if linked else [own]), after])
    menu = "".join(f"<li><a href=x>{w}</a>" for w in words[:9])
    assert html_text.main_text(f"<ul>{menu}</ul><p>{LONG}</p><ul>{menu}</ul>", tree)[0] == LONG


def test_articles_of_the_table(spark, sf_dir):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op2_extract_text"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", article)]
        assert r["text"] == " ".join(x for x in parts if x)


def test_extraction_time_grows_with_the_page():
    tree = html_text.train()
    for page in ("<a " * 50_000, "<!--" * 50_000, '<p title="' * 50_000, "<div>" * 50_000, "<script>" * 50_000):
        html_text.main_text(page, tree)


# ---- toxicity

def test_folding():
    assert toxicity.fold("Ｉd1оt, ÍDIOT!  $tup1d​") == " idiot idiot stupid "
    assert toxicity.fold("word$$$ áb") == " word ab " and toxicity.fold(None) == toxicity.fold("") == " "


def _labelled(make_docs, spark, n=600):
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(60, i) + (" you grumbo and zlatty thing" if bad else "")
        docs.append((i, text, "en", "a"))
        labels.append((i, 1, int(bad), "x"))
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, score string")


def test_toxic_documents_are_found(spark, make_docs):
    docs, labels = _labelled(make_docs, spark)
    docs += [(1000, prose(50, 3) + " GRUMB0 zlаtty", "en", "a"), (1001, prose(50, 4), "en", "a"), (1002, None, None, None), (1003, "", "en", "a"),
             (None, prose(2000, 1) + " zlatty grumbo", "en", None), (1001, prose(50, 4), "en", "a")]
    rows = toxicity.score_toxicity(make_docs(docs), labels).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1000]["predicted"] == 1
    assert all(by_id[i]["predicted"] == 0 for i in (1001, 1002, 1003))
    tested = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in tested) and len(tested) > 100


def test_exceptions_take_matches_back():
    machine = toxicity._automaton({" clown": 5.0, " clown fish ": -5.0})
    assert toxicity.features("a clown fish swims", machine)[0] == 0
    assert toxicity.features("a clown swims", machine)[0] > 0


def test_toxicity_without_labels(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.score_toxicity(odd_docs, labels).collect()
    assert len(rows) == len(odd_rows) and {r["score"] for r in rows} == {0.5}
    assert toxicity.score_toxicity(no_docs, labels).count() == 0


# ---- language

def test_gradients_of_the_network():
    network = language.Network(["a", "b", "c"], states=3)
    network.p = {n: v.astype(np.float64) for n, v in network.p.items()}
    random = np.random.default_rng(0)
    windows, truth = random.integers(97, 100, (5, 4)), np.array([0, 1, 2, 1])
    _, grads = network.gradients(windows, truth)
    for name, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        network.p[name][at] += 1e-4
        up, _ = network.gradients(windows, truth)
        network.p[name][at] -= 2e-4
        down, _ = network.gradients(windows, truth)
        network.p[name][at] += 1e-4
        assert abs((up - down) / 2e-4 - grad[at]) < 0.02 * abs(grad[at]) + 1e-4


def test_pooling_covers_whole_texts(monkeypatch):
    network = language.Network(["a", "b"])
    text = ("abcdefgh" * 100)[: 3 * language.READ_BYTES + 7].encode()
    data = np.frombuffer(text + text, np.uint8)
    shares = language.pooled(network, data, np.array([0, len(text), len(text), 2 * len(text)]))
    assert np.allclose(shares.sum(axis=1), [1, 0, 1], atol=1e-4) and np.allclose(shares[0], shares[2], atol=1e-5)
    one = network.probabilities(np.frombuffer(text, np.uint8)[: language.READ_BYTES, None].astype(int), np.array([language.READ_BYTES]))
    assert abs(one.sum() - language.READ_BYTES) < 1e-2


def test_languages_of_the_table(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_identify_language"](spark, sf_dir).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == held_out(r["doc_id"], 5, 0) for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in tested) >= 0.9 * len(tested)


def test_languages_of_odd_rows(odd_docs, odd_rows, no_docs, make_docs):
    network = language.train(np.array([np.frombuffer(b"abcd" * 12, np.uint8), np.frombuffer(b"wxyz" * 12, np.uint8)] * 20),
                             np.array([0, 1] * 20), ["one", "two"], steps=60)
    rows = language.predict_language(odd_docs, network).collect()
    assert len(rows) == len(odd_rows)
    letters = Counter(any(c.isalpha() for c in t or "") for _, t, *_ in odd_rows)
    assert Counter(r["lang_pred"] != "und" for r in rows) == letters
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0) for r in rows)
    made = language.predict_language(make_docs([(1, "dcba abcd", None, None), (2, "zyx wxyz", None, None), (3, "éà", None, None)]), network)
    assert [r["lang_pred"] for r in sorted(made.collect())][:2] == ["one", "two"]
    assert language.predict_language(no_docs).count() == 0
    unlabelled = language.predict_language(make_docs([(1, "text", None, None)]))
    assert [r["lang_pred"] for r in unlabelled.collect()] == ["und"]


# ---- decontamination

def _contaminated(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        words = tokens_of(text)
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[k : k + n])].add(item)
    out = []
    for doc_id, text in docs:
        words, hit, found = tokens_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    found |= windows[tuple(words[k : k + n])]
                    hit |= set(range(k, k + n))
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return Counter(out)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("most_terms", [decontaminate.MOST_TERMS, 0])
def test_contamination_of_odd_rows(spark, make_docs, odd_rows, no_docs, most_terms):
    passage = "alpha beta Gamma delta, alpha beta gamma delta epsilon zeta eta THETA the the the iota"
    items = [(1, passage), (2, "short item"), (10, "alpha beta gamma delta alpha beta gamma delta epsilon zeta"), (3, None), (4, "..."), (1, passage),
             (None, "lonely words")]
    rows = [(i, t) for i, t, *_ in odd_rows] + [
        (50, "x " + passage + " y " + passage), (51, passage[: len(passage) // 2]), (52, "a short, ITEM here; short item"), (53, "short x item"),
        (54, passage.replace("zeta", "zetas")), (55, passage.upper().replace(" ", "\n-- ")), (56, "lonely words"),
        (57, "alpha " * 30), (58, passage)]
    docs = make_docs([(i, t, "en", "a") for i, t in rows])
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, row string, term int")
    found = decontaminate.contamination(docs, benchmark, most_terms=most_terms)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found.collect()) == _contaminated(rows, items)
    if most_terms:
        assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
        assert decontaminate.contamination(no_docs, benchmark).count() == 0
        left = decontaminate.without_passages(docs, benchmark)
        assert left.columns == docs.columns and left.count() == found.where("not contaminated").count()


def test_contamination_on_the_table(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    expected = _contaminated([(r["doc_id"], r["text"]) for r in read("documents")], [(r["item_id"], r["text"]) for r in read("benchmark")])
    rows = QUERIES["op5_find_benchmark"](spark, sf_dir).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in rows) == expected


def test_proximity(spark):
    texts = spark.createDataFrame([(1, "red x x blue y green"), (2, "green blue z red"), (3, "red q q q q q blue q q q q q green"), (4, "red blue")],
                                  "id bigint, text string")
    items = decontaminate.store_index(spark.createDataFrame([("i", "red blue green")], "id string, text string"))
    index = decontaminate.store_index(texts)
    near = decontaminate.proximity_matches(decontaminate.postings(index), items, within=6)
    assert sorted(r["id"] for r in near.join(index, "row").collect()) == [1, 2]


def _near(docs, items, terms=decontaminate.NEAR_TERMS):
    """Items near in every document: their rarest words, ties by hash, within as many words as the item has."""
    texts = [(i, tokens_of(t)) for i, t in docs]
    counts = Counter(w for _, words in texts for w in words)
    kinds = sorted({w for _, t in items for w in tokens_of(t)})
    data, offsets = np.frombuffer("".join(kinds).encode(), np.uint8), np.cumsum([0] + [len(w.encode()) for w in kinds])
    order = dict(zip(kinds, kernels.word_hashes(data, offsets[:-1], offsets[1:], kernels.ALPHANUMERIC).view(np.int64).tolist()))
    wanted = []
    for _, t in items:
        words = tokens_of(t)
        rarest = sorted(set(words), key=lambda w: (counts[w], order[w]))[:terms]
        if words and all(counts[w] for w in rarest):
            wanted.append((rarest, len(words)))
    out = []
    for doc_id, words in texts:
        n, places = 0, defaultdict(list)
        for k, w in enumerate(words):
            places[w].append(k)
        for rarest, span in wanted:
            if all(w in places for w in rarest):
                ends = sorted(k for w in rarest for k in places[w])
                last = lambda w, k: places[w][bisect.bisect_right(places[w], k) - 1] if places[w][0] <= k else -span
                n += any(k - min(last(w, k) for w in rarest) < span for k in ends)
        out.append((doc_id, n))
    return Counter(out)


@pytest.mark.parametrize("most_terms", [decontaminate.MOST_TERMS, 0])
def test_near_items_of_odd_rows(spark, make_docs, odd_rows, no_docs, most_terms):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "short item"), (3, None), (4, "..."), (5, "unheard alpha"),
             (2, "short item"), (None, "lonely words"), (6, "alpha alpha alpha beta")]
    rows = [(i, t) for i, t, *_ in odd_rows] + [
        (50, "zeta x x eta x theta x epsilon"), (51, "zeta " + "x " * 20 + "eta theta epsilon"), (52, "item short"), (53, "item, a short one"),
        (54, "Theta epsilon " + "alpha " * 4 + "eta zeta"), (55, "words words lonely"), (56, "beta " * 500 + "alpha"), (57, "beta x x alpha"),
        (58, "beta gamma delta alpha " * 5)]
    docs = make_docs([(i, t, "en", "a") for i, t in rows])
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, row string, term int")
    found = decontaminate.contamination(docs, benchmark, most_terms=most_terms, proximity=True).collect()
    assert Counter((r["doc_id"], r["n_near_items"]) for r in found) == _near(rows, items)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found) == _contaminated(rows, items)
    assert {r["doc_id"] for r in found if r["n_near_items"]} >= {50, 52, 54, 55, 56, 57}
    if most_terms:
        assert decontaminate.contamination(docs, benchmark.limit(0), proximity=True).where("n_near_items > 0").count() == 0
        assert decontaminate.contamination(no_docs, benchmark, proximity=True).count() == 0


def test_near_items_on_the_table(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    expected = _near([(r["doc_id"], r["text"]) for r in read("documents")], [(r["item_id"], r["text"]) for r in read("benchmark")])
    rows = QUERIES["op5_find_benchmark"](spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["n_near_items"]) for r in rows) == expected
    assert any(r["n_near_items"] for r in rows)


# ---- suffix tree

def test_base_of_odd_rows(odd_docs, odd_rows, no_docs):
    rows = suffix_lm.score_documents(odd_docs, frequent_words=3).collect()
    counts = Counter()
    for i, t, *_ in odd_rows:
        if not held_out(i, 5, 1):
            counts.update([*words_of(t), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    expected = []
    for i, t, *_ in odd_rows:
        tokens = [*words_of(t), "\n"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        expected.append((i, held_out(i, 5, 1), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 4)))
    found = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows]
    assert Counter(found) == Counter(expected)
    assert all(r["score"] < 0 for r in rows)
    assert suffix_lm.score_documents(no_docs).count() == 0


def _stream(text, depth):
    words = b"".join(w + b" " for w in (x.encode() for x in words_of(text)))
    return b"\0" * (depth - 1) + bytes([suffix_lm.END]) + words + bytes([suffix_lm.END])


def _tree(texts, depth, least_count, least_gain):
    """``{context: counts of next bytes}`` of all contexts, and the retained ones, by dictionaries."""
    counts = defaultdict(Counter)
    for text in texts:
        stream = _stream(text, depth)
        for at in range(depth, len(stream)):
            for k in range(depth + 1):
                counts[stream[at - k : at]][stream[at]] += 1
    kept = set()
    for context, after in counts.items():
        if context:
            shorter, total = counts[context[1:]], after.total()
            gain = sum(n * math.log(n / total * shorter.total() / shorter[x]) for x, n in after.items())
            if total >= least_count and gain >= least_gain + suffix_lm.GAIN_PER_SYMBOL * len(after):
                kept.add(context)
    return counts, kept


def _naive(tree, text, depth):
    """The score with the chances carried from the root over all retained endings."""
    counts, kept = tree
    stream, total = _stream(text, depth), 0.0
    for at in range(depth, len(stream)):
        root = counts[b""]
        p = (root[stream[at]] + 0.5) / (root.total() + 128)
        for k in range(1, depth + 1):
            context = stream[at - k : at]
            if context in kept:
                after = counts[context]
                p = (after[stream[at]] + len(after) * p) / (after.total() + len(after))
        total += math.log10(p)
    return total


@pytest.mark.parametrize("depth", [suffix_lm.LONGEST, 5, 2])
def test_scores_by_dictionaries(make_docs, depth):
    texts = {**{i: prose(60, i) + " xaaaaaap yaaaaaaq" for i in range(60)}, 97: "é" * 9 + " of\x00 \x01", 98: "ZZ qq \x7f", 99: "of the of", 100: "", 101: prose(900, 99)}
    docs = make_docs([(i, t, "en", "a") for i, t in texts.items()])
    tree = _tree([t for i, t in texts.items() if not held_out(i, 5, 1)], depth, suffix_lm.LEAST_COUNT, suffix_lm.LEAST_GAIN)
    assert len(tree[1]) > 20 and (depth < 7 or max(map(len, tree[1])) == 7)
    for frequent in (0, 300, 10**6):
        rows = suffix_lm.score_documents(docs, frequent_grams=frequent, depth=depth).collect()
        assert len(rows) == len(texts) and any(r["held_out"] for r in rows)
        for r in rows:
            assert abs(r["score"] - _naive(tree, texts[r["doc_id"]], depth)) < 2e-3


def test_tree_read_in_small_batches(make_docs, spark, monkeypatch):
    texts = {i: prose(50, i) + " xaaaaaap yaaaaaaq" for i in range(30)}
    docs = make_docs([(i, t, "en", "a") for i, t in texts.items()])
    monkeypatch.setattr(suffix_lm, "TOGETHER", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        tree, _ = suffix_lm.grow_tree(docs)
        found = {(r["level"], r["key"] & 2**64 - 1): (r["n"], r["total"], r["kinds"]) for r in tree.where("level > 0 and n > 0").collect()}
        steps = {(r["level"], (r["key"] & 2**64 - 1) >> 64 - 8 * r["level"]) for r in tree.where("n = 0").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts, kept = _tree(texts.values(), 7, suffix_lm.LEAST_COUNT, suffix_lm.LEAST_GAIN)
    expected = {(len(c), int.from_bytes(c[::-1].ljust(7, b"\0") + bytes([x]))): (n, counts[c].total(), len(counts[c]))
                for c in kept for x, n in counts[c].items()}
    assert found == expected
    # endings that are not retained themselves
    endings = {c[i:] for c in kept for i in range(1, len(c))} - kept
    assert steps == {(len(c), int.from_bytes(c[::-1])) for c in endings} and steps


def test_the_tree_grows_with_the_corpus(make_docs):
    """What is learned of twelve texts is not dropped when others are added."""
    own = [i for i in range(30) if not held_out(i, 5, 1)][:12]
    few = [(i, "quizzical zanzibar", "en", "a") for i in own]
    many = [(i, prose(3000, i), "en", "a") for i in range(100, 400)]
    alone, beside = ({r["doc_id"]: r["score"] for r in suffix_lm.score_documents(make_docs(rows)).collect()}[own[0]] for rows in (few, few + many))
    # the first letters of its words are rarer now, what follows them is as sure as before
    assert beside > alone - 10


def test_grams_count_every_symbol():
    for _, data, offsets in kernels.pieces(pa.array(["ab c", "", None, "x"])):
        symbols, stops = suffix_lm.symbol_stream(data, offsets, kernels.spans(data, offsets, kernels.UNSPACED))
        assert bytes(symbols) == b"ab c \n\n\nx \n" and stops.tolist() == [5, 6, 7, 10]
        keys = [int(k).to_bytes(8, "big") for k in suffix_lm.grams(symbols, stops, 5)]
        keys = [k[6::-1].strip(b"\0") + k[7:] for k in keys]
        assert keys == [b"\na", b"\nab", b"\nab ", b"\nab c", b"\nab c ", b"ab c \n", b"\n\n", b"\n\n", b"\nx", b"\nx ", b"\nx \n"]


def _bundles(spark, rows):
    """Rows ``(level, key, share, weight)`` as the driver gets them, from three tasks."""
    made = spark.createDataFrame(rows, "level int, key long, share float, weight float").repartition(3)
    return made.mapInArrow(suffix_lm._bundle_kernel(), suffix_lm.BUNDLED).toArrow()


def test_held_tree_from_bundles(spark, monkeypatch):
    """Chances of grams are carried from the root over all held endings, whatever the bundles and slices."""
    monkeypatch.setattr(suffix_lm, "SLICE", 3)
    random = np.random.default_rng(3)
    signed = lambda key: key - 2**64 if key >= 2**63 else key
    shares = {b"": {x: float(np.float32(random.uniform(0.1, 0.3))) for x in b"abcz"}}
    weights = {}
    contexts = [bytes(random.choice(list(b"abz\xff"), k).tolist()) for k in range(1, 8) for _ in range(12)]
    for whole in contexts:
        for i in range(len(whole)):
            # every ending; some are only steps to longer ones
            context = whole[i:]
            if context not in shares:
                step = i and random.random() < 0.3
                shares[context] = {} if step else {x: float(np.float32(random.uniform(0.1, 0.4))) for x in random.choice(list(b"abcz"), 2, replace=False).tolist()}
                weights[context] = 1.0 if step else 0.25
    key = lambda c, x: signed(int.from_bytes(c[::-1].ljust(7, b"\0") + bytes([x])))
    rows = [(len(c), key(c, x), p, weights.get(c, 1.0)) for c, after in shares.items() for x, p in after.items()]
    rows += [(len(c), key(c, 0), 0.0, 1.0) for c, after in shares.items() if c and not after]
    bundles = _bundles(spark, rows)
    # the driver gets bundles, not a row for every gram
    assert len(rows) > 200 and bundles.num_rows <= 3 * (suffix_lm.LONGEST + 1)
    tree = suffix_lm.hold(bundles, np.zeros(0, np.uint64), 0.001)

    def chance(context, x):
        p = shares[b""].get(x, 0.001)
        for k in range(1, len(context) + 1):
            if context[-k:] not in shares:
                break
            p = shares[context[-k:]].get(x, 0.0) + weights[context[-k:]] * p
        return p

    wanted = sorted({(key(c.rjust(7, b"q"), x) & 2**64 - 1, c.rjust(7, b"q"), x) for c in shares for x in b"abczy"})
    found, beyond = suffix_lm.chances(tree, np.array([k for k, _, _ in wanted], np.uint64))
    assert np.allclose(found, [chance(c, x) for _, c, x in wanted], rtol=1e-5) and not beyond.any()
    assert [len(keys) for keys, _ in tree[4]] == [sum(len(a) for c, a in shares.items() if len(c) == k) for k in range(1, 8)]


def test_the_driver_opens_one_level_at_a_time():
    """Beside the held tree itself the driver's arrays stay small."""
    n = 400_000
    random = np.random.default_rng(4)
    rows = pa.table({"level": pa.array(np.full(n, 7, np.int32)), "key": random.integers(0, 2**62, n),
                     "share": pa.array(np.full(n, 0.5, np.float32)), "weight": pa.array(np.full(n, 0.5, np.float32))})
    endings = {k: np.unique(suffix_lm.context_of(rows.column("key").to_numpy().view(np.uint64), k)) for k in range(1, 7)}
    tables = [rows]
    for k, contexts in endings.items():
        tables.append(pa.table({"level": pa.array(np.full(len(contexts), k, np.int32)), "key": (contexts << np.uint64(64 - 8 * k)).view(np.int64),
                                "share": pa.array(np.zeros(len(contexts), np.float32)), "weight": pa.array(np.ones(len(contexts), np.float32))}))
    batches = [b for t in tables for b in t.to_batches()]
    bundles = pa.Table.from_batches(list(suffix_lm._bundle_kernel()(iter(batches))))
    held = sum(t.num_rows for t in tables)
    # rows of 20 bytes each came to the driver before
    assert bundles.nbytes < 0.75 * 20 * held
    tracemalloc.start()
    tree = suffix_lm.hold(bundles, np.zeros(0, np.uint64), 0.001)
    size, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(tree[2]) == held and len(tree[4][6][0]) == len(np.unique(rows.column("key").to_numpy()))
    assert peak < 2.5 * size


def test_open_grams_and_rare_words_come_once():
    """A parcel has every key once, with the texts it stands in."""
    keys, text = np.array([9, 5, 9, 9, 5], np.uint64) << np.uint64(50), np.array([3, 1, 1, 3, 0], np.uint32)
    beyond, run = np.array([7, 2, 7, 7, 2], np.uint8), np.array([4, 1, 4, 4, 1], np.int32)
    read = lambda r, column, n, kind: suffix_lm._unsqueezed(r[column], n, kind).tolist()
    for kind, columns in ((suffix_lm.OPEN_GRAMS, (beyond, text)), (suffix_lm.RARE_WORDS, (text,))):
        parcels = suffix_lm._parcels(kind, pa.int64(), run, 10, keys, *columns).to_pylist()
        assert [(r["run"], r["row"], r["size"], suffix_lm._unsqueezed_keys(r["keys"], 1).tolist(), read(r, "first", 1, np.uint32)) for r in parcels] == [
            (1, 10, 1, [5 << 50], [2]), (4, 10, 1, [9 << 50], [3])]
        assert [sorted(read(r, "second", n, np.uint32)) for r, n in zip(parcels, (2, 3))] == [[0, 1], [1, 3, 3]]
        assert [r["third"] and read(r, "third", 1, np.uint8) for r in parcels] == ([[2], [7]] if kind == suffix_lm.OPEN_GRAMS else [None, None])


def test_keys_come_back_from_their_shared_bytes():
    random = np.random.default_rng(6)
    for keys in (random.integers(0, 2**64, 1000, np.uint64), random.integers(0, 9, 1000).astype(np.uint64) << np.uint64(55), np.array([0], np.uint64),
                 np.array([2**64 - 1, 2**64 - 1, 0, 7], np.uint64), np.repeat(random.integers(0, 2**64, 50, np.uint64), 3)):
        for each in (keys, np.sort(keys)):
            assert (suffix_lm._unsqueezed_keys(suffix_lm._squeezed_keys(each), len(each)) == each).all()


def test_score_beats_the_base(make_docs):
    """Words of three syllables, of which each of two languages has its own twenty."""
    random = np.random.default_rng(5)
    syllables = [[c + v for c in consonants for v in "aeiou"] for consonants in ("bdgk", "lmnr")]
    made = [(i, " ".join("".join(random.choice(syllables[i % 2], 3)) for _ in range(200)), "en", "a") for i in range(300)]
    rows = [r for r in suffix_lm.score_documents(make_docs(made)).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)


# ---- n-gram join

def _classes(rows):
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
            for i, w in ((i, words_of(t)) for i, t in rows)]
    distinct = sorted({s for _, s in sets if s}, key=sorted)
    root = {s: s for s in distinct}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    links = Counter()
    for a in range(len(distinct)):
        for b in range(a):
            x, y = distinct[a], distinct[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                links[x] += 1
                links[y] += 1
                root[top(x)] = top(y)
    copies = Counter(s for _, s in sets)
    names = {}
    for i, s in sets:
        if s:
            names[top(s)] = min([n for n in (i, names.get(top(s))) if n is not None], default=None)
    return Counter((i, names[top(s)] if s else i, links[s], copies[s] if s else 1) for i, s in sets)


def _varied(text, at):
    words = text.split()
    words[at] = "changed"
    return " ".join(words)


@pytest.mark.parametrize("block", [1000, 3])
def test_join_of_odd_rows(make_docs, odd_rows, no_docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    monkeypatch.setattr(ngram_join, "TASK_TEXTS", 5)
    base = prose(100, 40)
    rows = [(i, t) for i, t, *_ in odd_rows] + [(100 + k, _varied(base, 5 * k)) for k in range(15)]
    rows += [(200, base.upper()), (201, base.replace(" ", "\n ")), (202, base + " " + prose(22, 41)), (203, base + " " + prose(60, 41)),
             (204, "one"), (205, "ONE "), (206, "two words"), (207, "words two")]
    found = ngram_join.similarity_classes(make_docs([(i, t, "en", "a") for i, t in rows])).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in found) == _classes(rows)
    if block == 1000:
        docs = make_docs([(i, t, "en", "a") for i, t in rows])
        left = ngram_join.one_of_each_class(docs)
        wordless = len({(i, t or "") for i, t in rows if not words_of(t)})
        assert left.columns == docs.columns
        named = {r["class_id"] for r in found if r["n_shingles"] > 0}
        assert left.count() == len(named) + wordless
        assert ngram_join.similarity_classes(no_docs).count() == 0


def test_prefixes_are_shortened_to_the_target():
    depth = ngram_join.prefix_length()
    assert ngram_join.recall_at(depth, 0.8) >= ngram_join.TARGET_RECALL > ngram_join.recall_at(depth + 1, 0.8)
    assert ngram_join.prefix_length(trees=10) < depth


def test_join_on_the_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op1_join_ngrams"](spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in rows) == _classes(docs)


# ---- pipeline

def test_pipeline_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir).cache()
        if name != "sharding":
            assert after.columns == columns
        texts = {r["doc_id"]: r["text"] for r in before.collect()}
        ids = Counter(r["doc_id"] for r in after.select("doc_id").collect())
        if name == "language ID":
            assert set(ids) == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
        elif name == "n-gram Jaccard join":
            assert set(ids) == {c for _, c, *_ in _classes(texts.items())}
        elif name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(ids) == {row[0] for row in _contaminated(texts.items(), items) if not row[-1]}
        elif name == "mixing":
            assert ids == Counter({r["doc_id"]: r["copies"] for r in mixing.mix_documents(before).collect() if r["copies"]})
        else:
            rows = after.collect()
            assert ids == Counter(r["doc_id"] for r in before.collect())
            counts = Counter(r["shard"] for r in rows)
            assert max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count()


def test_pipeline_columns_of_any_name(spark, tmp_path):
    """Null and empty texts, repeated rows, an empty table and columns whose names need quoting."""
    rows = [(i, prose(60, i), "en", "a", 1, "x") for i in range(12)] + [(3, prose(60, 3), "en", "a", 1, "x"), (50, None, "en", "a", 1, None), (51, "", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, `my col` int, `a:b,c<d>` string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i", "no such passage")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids <= set(range(12)) and len(ids) > 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_short_training_texts(make_docs):
    """A language of short posts is learned too."""
    rows = [(i, ("zakka zoku " if i % 2 else "moli mela ")[: 6 + i % 5], "aa" if i % 2 else "bb", "s") for i in range(400)]
    found = language.predict_language(make_docs(rows)).collect()
    truth = {i: lang for i, _, lang, _ in rows}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) > 0.95 * len(rows)


def test_gradients_of_padded_windows():
    network = language.Network(["a", "b"], states=3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    random = np.random.default_rng(0)
    windows, truth, lengths = random.integers(97, 100, (7, 4)), np.array([0, 1, 1, 0]), np.array([7, 3, 1, 5])
    loss, grads = network.gradients(windows, truth, lengths)
    # padding counts for nothing
    other = np.where(np.arange(7)[:, None] < lengths, windows, 120)
    assert abs(network.gradients(other, truth, lengths)[0] - loss) < 1e-6
    for name in ("v", "uf", "ub", "wf", "wb", "c"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        step = 1e-3
        network.p[name][at] += step
        up = network.gradients(windows, truth, lengths)[0]
        network.p[name][at] -= 2 * step
        down = network.gradients(windows, truth, lengths)[0]
        network.p[name][at] += step
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-2 * max(0.05, abs(grads[name][at]))

"""License scans, filter audit and collocations against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from motorlens.llm import collocations, filter_audit, license_scan
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# ---- licenses


def places_of(text):
    words, found = tokens_of(text), []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), found


def base_of(text):
    n, found = places_of(text)
    starts = [i for i, _ in found]
    return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


@pytest.fixture(scope="module")
def licensed(odd_rows):
    mit = license_scan.NOTICES[0][0]
    words = mit.split()
    return odd_rows + [
        (20, "Released under the MIT License. MIT LICENSE mit license", "en", "a"),
        (21, prose(30) + " " + mit + " " + prose(30, 2), "en", "a"),
        (22, prose(9) + " " + " ".join([*words[:20], "new", "words", *words[20:30], *words[31:]]), "en", "a"),
        (23, " ".join(words[:20]) + " " + prose(60), "en", "a"),
        (24, "GNU General\nPublic-License and the Apache licenses, Apache/License", None, None),
        (25, ("general public license " * 40_000).strip(), "en", "b"),
        (26, "Licensed under CC BY-NC 4.0. " * 3, "en", "b"), (26, "Licensed under CC BY-NC 4.0. " * 3, "en", "b"),
        (27, " ".join(reversed(words)), "en", "b"),
    ]


@pytest.mark.parametrize("most_places", [license_scan.MOST_PLACES, 0])
def test_places_of_phrases(make_docs, licensed, most_places):
    found = license_scan.scan_licenses(make_docs(licensed), most_places=most_places).collect()
    seen = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found)
    assert seen == Counter((i, *base_of(t)) for i, t, _, _ in licensed)
    labels = {r.doc_id: (r.labels, round(r.score, 2)) for r in found}
    assert labels[20] == ("mit", 1.0) and labels[21] == ("mit", 1.0) and labels[26] == ("cc-by-nc", 1.0)
    # words put in and left out are met on neighbouring diagonals
    assert labels[22][0] == "mit" and 0.75 <= labels[22][1] < 1
    assert labels[23] == ("", 0.0) and labels[27] == ("", 0.0) and labels[1] == ("", 0.0)


def test_spans_of_notices(make_docs, spark):
    apache = license_scan.NOTICES[1][0]
    text = " ".join([prose(12), apache, prose(40, 3), apache.replace("obtain", "get")])
    templates = license_scan.template_places(spark)
    spans = license_scan.license_spans(license_scan.template_matches(make_docs([(1, text, "en", "a")]), templates), templates)
    n = len(tokens_of(apache))
    found = sorted((r.first_word, r.last_word) for r in spans.where("not exact").collect())
    assert found == [(12, 11 + n), (52 + n, 51 + 2 * n)]
    assert spans.where("exact").count() == sum(len(places_of(t)[1]) for t in (text,))


def test_long_notice_over_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(license_scan, "BLOCK", 7)
    docs = make_docs([(1, prose(25) + " mit license " + prose(9), "en", "a"), (2, "mit", "en", "a")])
    assert {r.doc_id: (r.n_base, r.first_word) for r in license_scan.scan_licenses(docs).collect()} == {1: (1, 25), 2: (0, None)}


def test_no_documents_to_scan(no_docs):
    assert license_scan.scan_licenses(no_docs).count() == 0


# ---- filters


def mask_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
             bool(re.search(r"[#$%&*|]", text))]
    return sum(1 << k for k, t in enumerate(tests) if t)


def audit(rows, labels):
    """Every order run filter by filter over lists of documents."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    parts = defaultdict(list)
    for i, text, lang, _ in rows:
        mask = mask_of(text or "") + (16 if i is not None and first[text or ""] < i else 0)
        parts[lang or ""].append((mask, i in good, i in bad))
    out = set()
    for part, docs in parts.items():
        removed_by, rows_of = Counter(), []
        for order in permutations("ABCDE"):
            alive = docs
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [d for d in alive if d[0] & bit]
                alive = [d for d in alive if not d[0] & bit]
                removed_by[f] += len(gone)
                rows_of.append((part, "".join(order), step, len(alive), len(gone), sum(1 for d in docs if d[0] & bit) - len(gone),
                                sum(d[0] == bit for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out |= {(*r[:-1], removed_by[r[-1]]) for r in rows_of}
    return out


def test_audit_of_odd_rows(make_docs, odd_rows, spark):
    shout = "A#B " * 80
    rows = odd_rows + [(30, shout, "en", "a"), (31, shout, "de", "a"), (29, shout, None, "a"), (29, shout, None, "a"), (32, "", "", None),
                       (33, None, "en", "x"), (None, None, "en", "y")]
    marks = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (31, 0, 1), (29, 1, 1), (99, 1, 1), (6, None, None)]
    labels = spark.createDataFrame([(*m, "s") for m in marks], "doc_id bigint, quality int, toxic int, text string")
    found = filter_audit.audit_filters(make_docs(rows), labels).collect()
    assert len(found) == 600 * 3 and {tuple(r) for r in found} == audit(rows, marks)


def test_no_documents_to_audit(no_docs, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_filters(no_docs, labels).count() == 0


def test_diagram_after_swaps():
    rng = random.Random(5)
    weights = {m: tuple(rng.randint(0, 2) for _ in range(3)) for m in rng.sample(range(32), 20)}
    diagram, orders = filter_audit.Diagram(weights), set()
    for swap in [None, *filter_audit.neighbour_swaps(5)]:
        if swap is not None:
            diagram.swap(swap)
        orders.add("".join(diagram.order))
        for level, nodes in enumerate(diagram.levels):
            # equal subdiagrams are held once, and no more than the masks above allow
            assert len(nodes) == len(set(nodes)) <= 1 << level
        passes = 0
        for name, kept, removed in diagram.steps():
            bit = 1 << "ABCDE".index(name)
            alive = [w for m, w in weights.items() if not m & passes]
            assert tuple(map(sum, zip(kept, removed))) == tuple(map(sum, zip(*alive)))
            passes |= bit
    assert len(orders) == 120


# ---- collocations


def mine(rows, least, best):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        frequent = {g: a for g, a in f.items() if a >= least and len(g) > 1}
        inside = Counter()
        for g, a in frequent.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        ranked = []
        for g, a in frequent.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if 100 * inside[g] < 80 * a:
                ranked.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:best], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.fixture(scope="module")
def phrased(odd_rows):
    rng = random.Random(3)
    words = ["Of", "the", "old", "mill", "é\x00", "\x01", "x" * 40, "#", "Mill's", "a\x02", "a"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(rng.randint(1, 400)))
             for _ in range(40)]
    return odd_rows + [(100 + i, t, rng.choice(["en", "de", None, "und"]), "a") for i, t in enumerate(texts)] + [
        (200, "of the old mill " * 3000, "en", "a")]


@pytest.mark.parametrize("most_words, groups", [(collocations.MOST_WORDS, None), (collocations.MOST_WORDS, 10_000), (0, 10_000), (5, None)])
def test_collocations_by_brute_force(make_docs, phrased, most_words, groups):
    found = collocations.collocations(make_docs(phrased), least=3, best=150, most_words=most_words, groups=groups)
    expected = mine(phrased, 3, 150)
    assert len(expected) > 300 and {tuple(r) for r in found.collect()} == expected


def test_small_runs_of_suffixes(make_docs, phrased, spark, monkeypatch):
    monkeypatch.setattr(collocations, "TOGETHER", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = collocations.collocations(make_docs(phrased), least=4, best=90, groups=60)
        assert {tuple(r) for r in found.collect()} == mine(phrased, 4, 90)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_collocations(no_docs, make_docs):
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(make_docs([(1, "one two", "en", "a"), (2, None, None, None)])).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    share = F.expr(f"(cast(a as decimal(20,0)) * cast({collocations.SCALE} as decimal(7,0))) div cast(l + r as decimal(20,0))")
    rows = [(9 * 10**15, 9 * 10**15 + 7, 9 * 10**15 + 1), (10**18, 10**18 + 1, 3 * 10**18)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, l long, r long").select(share).collect()]
    assert got == [2_000_000 * a // (x + y) for a, x, y in rows]

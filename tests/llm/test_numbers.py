"""Sharding, mixing, URL filter and quality rules."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from motorlens.llm import mixing, numbering, quality, sharding, url_filter
from motorlens.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference
from tests.llm.conftest import prose


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 1000, 4097])
def test_permutation_is_one_to_one_and_inverts(n):
    places = sharding.permute(np.arange(n), n, seed=3)
    assert sorted(places) == list(range(n))
    assert (sharding.permute(places, n, seed=3, inverse=True) == np.arange(n)).all()
    assert n < 40 or (places != sharding.permute(np.arange(n), n, seed=4)).any()


def test_shard_and_slot_are_computable():
    for row in range(0, 500, 37):
        shard, slot = sharding.place_of(row, 500, 40)
        assert sharding.row_number_at(shard, slot, 500, 40) == row


def _lawful(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))


def test_shards_of_odd_rows(odd_docs, odd_rows, no_docs):
    rows = sharding.assign_shards(odd_docs, shards=4).collect()
    assert len(rows) == len(odd_rows)
    _lawful(rows, 4)
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    assert sharding.assign_shards(no_docs).count() == 0


def test_shards_do_not_depend_on_partitions(make_docs, monkeypatch):
    monkeypatch.setattr(numbering, "BUCKET_ROWS", 50)
    monkeypatch.setattr(numbering, "BUCKETS_TOGETHER", 4)
    monkeypatch.setattr(numbering, "EXPANDED", 8)
    docs = make_docs([(i, prose(20, i), "en", "a") for i in range(700)] + [(7, "same", "en", "a")] * 300)
    first = sharding.assign_shards(docs.repartition(3)).collect()
    again = sharding.assign_shards(docs.repartition(11)).collect()
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, first)) == sorted(map(key, again))
    assert sorted(r["row_number"] for r in first) == list(range(1000))
    _lawful(first, 40)


def test_shards_on_the_table(spark, sf_dir):
    rows = QUERIES["op8_shard_documents"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    _lawful(rows, 40)


@pytest.mark.parametrize("counts, budget", [({3: 2, 5: 1}, 10), ({7: 3}, 20), ({2: 5, 9: 1}, 13), ({}, 5), ({4: 1}, 3), ({1: 9, 6: 2}, 0)])
def test_fill_finds_the_best_sum(counts, budget):
    best = max(sum(n * k for n, k in zip(counts, taken)) for taken in itertools.product(*[range(c + 1) for c in counts.values()])
               if sum(n * k for n, k in zip(counts, taken)) <= budget)
    taken = mixing.fill(counts, budget)
    assert all(taken[n] <= counts[n] for n in taken)
    assert sum(n * k for n, k in taken.items()) == best


def _targets(sizes):
    """Targets by resharing the excess again and again."""
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    left, open_sources, fixed = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_sources:
        shares = {s: left * weights[s] / sum(weights[o] for o in open_sources) for s in open_sources}
        over = [s for s in open_sources if shares[s] > 2 * sizes[s]]
        if not over:
            return fixed | shares
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]
            open_sources.discard(s)
    return fixed


def test_mixing_odd_rows(odd_docs, odd_rows, no_docs):
    sizes = defaultdict(int)
    for _, text, _, source in odd_rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = _targets(dict(sizes))
    rows = mixing.mix_documents(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    by_size = {size: targets[source] for source, size in sizes.items()}
    assert all(abs(r["target"] - by_size[r["source_size"]]) < 1e-6 and r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_mixing_reaches_targets_and_agrees_with_itself(make_docs, monkeypatch):
    monkeypatch.setattr(numbering, "SLICE_ROWS", 16)
    docs = make_docs([(i, prose(20 + i % 13, i), "en", "ab"[i % 3 == 0]) for i in range(400)] + [(1000 + i, "x y z", "en", None) for i in range(200)])
    first = mixing.mix_documents(docs.repartition(5)).collect()
    again = mixing.mix_documents(docs.repartition(2)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in first) == sorted((r["doc_id"], r["taken"]) for r in again)
    taken, target = Counter(), {}
    for r in first:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)


def test_url_twin(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(QUERIES["op9_filter_urls"](spark, sf), connect(sf), ORACLES["op9_filter_urls"]) is None


def test_url_rules_and_list(spark):
    urls = {
        1: ("http://WWW.Example.com/en/a?x", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        2: ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        3: ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        4: ("x://b.net/fr/1#top", "b.net", "/fr/1", "net/fr/", "block"),
        5: ("x://b.net/fr", "b.net", "/fr", None, "allow"),
        6: ("x://www.spam.org/p/", "www.spam.org", "/p/", None, "block"),
        7: ("x://spam.org/p.html?q://z", "spam.org", "/p.html", None, "block"),
        8: ("spam.org/p", "", "", None, "allow"),
        9: (None, "", "", None, "allow"),
        10: ("", "", "", None, "allow"),
        11: ("x://spam.com", "spam.com", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u[0], "h", "r", "b") for i, u in urls.items()] + [(6, urls[6][0], "h", "r", "b")],
                                  "page_id bigint, url string, host string, rule string, block string")
    listed = spark.createDataFrame([("spam.org/p", 1), ("spam.org/p", 2), (None, 3)], "canonical string, w0 int")
    rows = url_filter.judge_urls(pages, listed).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["page_id"]][1:]
    assert url_filter.judge_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 2
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0


def test_list_is_gathered_by_words_of_the_host(spark):
    hosts = ["x.poker-room.org", "PILLS.net", "best_slots.org", "trackside.org", "abet.net", "essex.org", "a.org/casino", None, ""]
    pages = spark.createDataFrame([(i, h and "http://" + h + "/p") for i, h in enumerate(hosts)], "page_id bigint, url string")
    listed = {r["canonical"] for r in url_filter.listed_urls(pages).collect()}
    assert listed == {"x.poker-room.org/p", "pills.net/p", "best_slots.org/p"}


def test_filter_passes_every_listed_url_and_few_others(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.org/p') AS canonical")
    table, blocks = url_filter.build_filter(listed, "canonical")
    assert url_filter.possible_hits(listed, "canonical", table, blocks).count() == 3000
    others = spark.range(20_000).selectExpr("concat('other', id) AS canonical")
    assert url_filter.possible_hits(others, "canonical", table, blocks).count() < 1000


def _statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if twice[w] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts_of_odd_rows(odd_docs, odd_rows, no_docs, make_docs):
    rows = quality.quality_verdicts(odd_docs).collect()
    assert Counter((r["doc_id"], *[r[c] for c in BASE]) for r in rows) == Counter((i, *_statistics(t)) for i, t, *_ in odd_rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)  # groups of a few rows have no estimate
    assert quality.quality_verdicts(no_docs).count() == 0
    texts = ["a a a a", "é ü\u00a0x é ü\u00a0x é", "a b c\na b c\n\n \na b c", "#* $%& |<>", "x " * 40 + "y"]
    made = quality.quality_verdicts(make_docs([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    for r in made:
        assert tuple(r[c] for c in BASE) == _statistics(texts[r["doc_id"]])


def test_quality_counts_on_the_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op10_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in BASE) == _statistics(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_outliers_are_rejected_and_others_kept(make_docs):
    rows = [(i, prose(100 + i % 40, i), "en", "a") for i in range(300)]
    odd = [(1000 + i, " ".join(w + "###$$" for w in prose(100, i).split()), "en", "a") for i in range(40)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(make_docs(rows + odd)).collect()}
    assert not any(kept[i] for i, *_ in odd)
    assert sum(kept[i] for i, *_ in rows) >= 298


def test_outliers_of_small_groups_are_rejected(make_docs):
    """Sources of five documents are judged by their language, a language of five by all."""
    rows = [(i, prose(100 + i % 40, i), "en", f"s{i // 5}") for i in range(100)] + [(100 + i, prose(110, i), "de", "t") for i in range(5)]
    odd = [(1000 + i, " ".join(w + "###$$" for w in prose(100, i).split()), *g) for i, g in enumerate([("en", "s0"), ("en", "s7"), ("de", "t"), (None, None)])]
    judged = {r["doc_id"]: r for r in quality.quality_verdicts(make_docs(rows + odd)).collect()}
    assert all(r["distance"] is not None for r in judged.values())
    assert not any(judged[i]["kept"] for i, *_ in odd)
    assert sum(judged[i]["kept"] for i, *_ in rows) >= 104


def test_chi_square():
    assert abs(quality.chi_square_quantile(0.05, 4) - 9.487729) < 1e-5
    assert abs(quality.chi_square_cdf(12.591587, 6) - 0.95) < 1e-6


def test_every_length_has_its_share():
    """Which documents are taken does not depend on how long they are."""
    import pandas as pd

    for seed in range(3):
        size = list(range(1, 3001))
        total = sum(size)
        lengths = pd.DataFrame({"source_key": "=a", "size": size, "count": 1, "source_size": total, "target": total / 2})
        plan = mixing.plan_source(lengths, seed)
        assert int((plan["size"] * plan["further"]).sum()) == total // 2
        shares = [plan["further"][plan["size"].between(a + 1, a + 500)].mean() for a in range(0, 3000, 500)]
        assert all(0.43 < s < 0.57 for s in shares)
    other = mixing.plan_source(lengths, 9)
    assert (other["further"] != plan["further"]).any() and (mixing.plan_source(lengths, 2)["further"] == plan["further"]).all()


def test_share_of_few_and_of_huge_documents():
    import pandas as pd

    for size, count, share in (([5, 10**9, 10**8], [40, 3, 7], 0.4), ([7], [3], 0.5), ([0, 3, 4], [9, 1, 1], 0.9), ([2, 3], [10, 10], 0.01)):
        total = sum(s * n for s, n in zip(size, count))
        lengths = pd.DataFrame({"source_key": "", "size": size, "count": count, "source_size": total, "target": total * share})
        plan = mixing.plan_source(lengths)
        assert ((plan["further"] >= 0) & (plan["further"] <= plan["count"])).all()
        assert abs((plan["size"] * plan["further"]).sum() - total * share) <= max(size)

"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table with one row of bits per block, so it is built by an aggregation
and met by a join on the block number; Spark broadcasts it while it is small and
shuffles it beyond.  Few URLs that are not listed pass it, and an exact hash join of
those that pass removes the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens.session import materialise

# bits of one block, as words of 64 bits; bits set per URL; listed URLs per block
BLOCK_WORDS = 4
PROBES = 6
URLS_PER_BLOCK = 20

# (verdict, host, path)
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)

# words of unwanted trades in host names, by which the list of the registered query is gathered
TRADE_WORDS = (
    "ad", "ads", "adserver", "adult", "banner", "bet", "bets", "betting", "casino", "click", "clicks", "counterfeit", "crack",
    "escort", "gambling", "jackpot", "keygen", "loan", "loans", "malware", "payday", "pharmacy", "phishing", "pills", "poker",
    "porn", "replica", "roulette", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez", "xxx",
)


def with_url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z in lower case) and ``path``; both are empty where the URL is null or has no ``://``."""
    address = F.coalesce(F.col(url), F.lit(""))
    after = F.regexp_extract(address, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.translate(host, upper, lower), "path": path})


def canonical(host: Column, path: Column) -> Column:
    """One spelling of an address: no scheme, query or fragment, no ``www.`` or ``m.``, no final ``/`` or ``.html``."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.concat(bare, F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_for(rules: tuple, host: Column, path: Column) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null where none does.

    A rule fits its host and all hosts below it where the path starts with the rule's.
    """
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest_first]
    chosen = [F.when(fit, F.lit(i)) for i, fit in enumerate(fits)]
    position = F.coalesce(*chosen, F.lit(None).cast("int"))
    texts = F.array(*[F.lit(h + p) for _, h, p in longest_first])
    verdicts = F.array(*[F.lit(v) for v, _, _ in longest_first])
    return F.get(texts, position), F.get(verdicts, position)


def _with_words(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Add the bits of a URL as the words of its block: ``PROBES`` slices of a second hash each set one."""
    hashed = rows.withColumn("_h", F.xxhash64(key, F.lit(7)))
    bits = [F.pmod(F.shiftright("_h", 9 * i), F.lit(64 * BLOCK_WORDS)).cast("int") for i in range(PROBES)]
    placed = hashed.withColumns({f"_b{i}": bit for i, bit in enumerate(bits)})
    none = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    words = {
        name: reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.when(F.floor(F.col(f"_b{i}") / 64) == w, F.call_function("shiftleft", one, F.col(f"_b{i}") % 64)).otherwise(none)
             for i in range(PROBES)],
        )
        for w, name in enumerate(names)
    }
    return placed.withColumns(words).drop("_h", *[f"_b{i}" for i in range(PROBES)])


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def build_filter(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter as a table ``(block, w0 ..)`` and its number of blocks; about ``URLS_PER_BLOCK`` URLs share one."""
    blocks = max(1, -(-listed.count() // URLS_PER_BLOCK))
    words = [f"w{i}" for i in range(BLOCK_WORDS)]
    placed = _with_words(listed.withColumn("block", block_of(F.col(key), blocks)), key, words)
    return materialise(placed.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words])), blocks


def possible_hits(rows: DataFrame, key: str, filter_table: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be listed: every listed key, and few others."""
    columns = rows.columns
    wanted = _with_words(rows, key, [f"_m{i}" for i in range(BLOCK_WORDS)])
    met = wanted.withColumn("block", block_of(F.col(key), blocks)).join(filter_table, "block")
    passed = reduce(
        lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}") for i in range(BLOCK_WORDS)]
    )
    return met.where(passed).select(*columns)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page; the list has a column ``canonical``.

    A rule decides where one fits; elsewhere a listed canonical URL is blocked and any
    other allowed.  A null URL, or one without ``://``, has an empty host and path, fits
    no rule and is never listed.  Repeated pages are judged one by one, an empty list
    blocks nothing, null and repeated entries of the list count once or not at all, and
    further columns of either table are not used.
    """
    entries = materialise(listed.select("canonical").where(F.col("canonical") != "").distinct())
    filter_table, blocks = build_filter(entries, "canonical")
    parts = materialise(with_url_parts(pages.select("page_id", "url")).select("page_id", "host", "path"))
    rule, verdict = rule_for(rules, F.col("host"), F.col("path"))
    judged = parts.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("_by_rule"),
        canonical(F.col("host"), F.col("path")).alias("canonical"),
    )
    # distinct addresses only: a hot address is one row of the exact join
    open_urls = judged.where(F.col("_by_rule").isNull() & (F.col("canonical") != "")).select("canonical").distinct()
    hits = materialise(
        possible_hits(open_urls, "canonical", filter_table, blocks).join(entries, "canonical", "left_semi")
        .select("canonical", F.lit(True).alias("listed"))
    )
    return judged.join(hits, "canonical", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("_by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )


def listed_urls(pages: DataFrame, words: tuple = TRADE_WORDS) -> DataFrame:
    """Canonical URLs of all pages on hosts whose name has one of the words, cut at dots, hyphens and underscores."""
    parts = with_url_parts(pages.select("url"))
    named = F.arrays_overlap(F.split("host", r"[._-]"), F.array(*[F.lit(x) for x in words]))
    return parts.where(named).select(canonical(F.col("host"), F.col("path")).alias("canonical")).distinct()

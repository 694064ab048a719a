"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

Lists hold canonical URLs, whole or cut short at any place after the host, which then cover what lies below;
a host covers its subdomains. A URL turns into its candidate keys, the suffixes of its host times its
path's prefixes of the lengths that the list has, and its canonical form. One 256-bit block of
the filter, with a bit in each of four words, tells most candidates from the listed keys; the
rest meet the list in an exact join, so no false positive remains. DataFrame functions only.

The filter is broadcast whatever the list's length: it has ``MAX_BLOCKS`` blocks at most, so a very long list passes more false hits, which
the exact join removes. Candidates that pass are few and meet the list's keys by broadcast, if they were counted to ``BROADCAST_KEYS``, else by a shuffle.

Rules judge a host as it stands. Other entries judge what a URL's canonical form says: without ``www.`` and a default port.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a list that a join may broadcast: some 10 MB.
BROADCAST_KEYS = 200_000
BITS_PER_KEY = 16
#: Blocks of the filter at most: rows of 40 bytes, for 16 million keys at 16 bits each.
MAX_BLOCKS = 1 << 20
WORDS = 4
#: Query parameters that do not tell pages apart.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without it."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _without_port(host: Column) -> Column:
    return F.regexp_replace(host, ":(80|443)$", "")


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and default port, path without last slash, sorted parameters without tracking, no fragment."""
    host = _without_port(F.regexp_replace(url_host(url), r"^www\.", ""))
    path = F.regexp_replace(url_path(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _mask(h: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1).cast("long"))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of ``keys(key)`` as rows ``(block, w0..w3)``; blocks without keys have no row."""
    h = F.xxhash64("key")
    rows = keys.select(_block(h, blocks).alias("block"), *(_mask(h, i).alias(f"w{i}") for i in range(WORDS)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def listed_hits(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``candidates(key, ...)`` whose key is in ``keys(key, ...)``, joined with its columns: filter, then exact join."""
    n = keys.count()
    blocks = min(MAX_BLOCKS, 1 << max(0, (n * BITS_PER_KEY // (64 * WORDS)).bit_length()))
    small = n <= BROADCAST_KEYS
    h = F.xxhash64("key")
    possible = candidates.withColumn("block", _block(h, blocks)).join(F.broadcast(bloom_blocks(keys, blocks)), "block")
    for i in range(WORDS):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(_mask(h, i)) != 0)
    possible = possible.drop("block", *(f"w{i}" for i in range(WORDS)))
    return possible.join(F.broadcast(keys) if small else keys, "key")


def list_keys(entries: DataFrame) -> DataFrame:
    """``(key, ruled, action)`` of list entries ``(host, path, action, ruled)``; of equal entries that oppose each other block wins."""
    key = F.concat(F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit("")))
    rows = entries.where("host is not null").select(key.alias("key"), "action", "ruled")
    return rows.groupBy("key", "ruled").agg(F.max_by("action", F.struct((F.col("action") == "block").alias("stops"), "action")).alias("action"))


def judge_urls(pages: DataFrame, entries: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` added (replacing columns of these names).

    entries: ``(host, path, action, ruled)``. Entries with ``ruled`` are rules: the longest that fits the host as it stands, ports
    included, decides and is named in ``rule``. Where none fits, the longest other entry that fits the host without a default port, or is the
    canonical URL, decides, and without any the verdict is allow. Defined cases: null urls and
    urls without ``://`` have empty host and path and are allowed; an empty list allows all; equal entries with opposed
    actions block; repeated rows are judged alike; other columns stay as they are.
    """
    keys = list_keys(entries)
    lengths = sorted(r[0] for r in entries.select(F.length(F.coalesce("path", F.lit("")))).distinct().collect())  # at most a URL's length of integers
    url = F.col(url_col)
    urls = pages.where(url.contains("://")).select(url.alias("u"), url_host(url).alias("h"), url_path(url).alias("p"))
    prefixes = F.array(*(F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")

    def tried(host: Column) -> Column:
        """Suffixes of the host times prefixes of the path."""
        labels = F.split(host, r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        return F.flatten(F.transform(F.filter(prefixes, lambda x: x.isNotNull()), lambda x: F.transform(suffixes, lambda s: F.concat(s, x))))

    whole = F.filter(F.array(canonical_url(F.col("u"))), lambda c: c.isNotNull())
    urls = urls.select("u", tried(F.col("h")).alias("raw"), F.array_union(tried(_without_port(F.col("h"))), whole).alias("canonical"))
    candidates = urls.select("u", F.explode(F.array_union("raw", "canonical")).alias("key"), "raw", "canonical")
    candidates = candidates.select("u", "key", F.array_contains("raw", F.col("key")).alias("as_raw"), F.array_contains("canonical", F.col("key")).alias("as_canonical"))
    hits = listed_hits(candidates, keys).where(F.when(F.col("ruled"), F.col("as_raw")).otherwise(F.col("as_canonical")))
    depth = F.struct("ruled", F.length("key"), F.col("action") == "block", "key", "action")
    best = hits.groupBy("u").agg(F.max(depth).alias("b"))
    best = best.select("u", F.when(F.col("b.ruled"), F.col("b.key")).alias("rule"), F.col("b.action").alias("action"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # a row's own columns travel as one, so that none can be mistaken for another
    joined = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), url.alias("u")).join(best, "u", "left")
    return joined.select(*(F.col("row")[c].alias(c) for c in kept), url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"), "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))

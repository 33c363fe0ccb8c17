"""URL filters: a blocked Bloom filter of listed keys in front of an exact hash join.

Listed keys are of two kinds: rules (a host with the start of a path) and canonical URLs.  A page's URL yields the few
keys that could be listed: each suffix of its host with each path start of a length that some rule has, and its own
canonical form.  Keys that hit all their bits in the filter go on to the exact join, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits set for each key, keys for each block of 512 bits, and blocks up to which the filter is broadcast (about 100
#: bytes each); the blocks of a larger one meet the candidates by their number in a shuffled join.
BITS, KEYS_PER_BLOCK, MOST_BLOCKS = 8, 32, 100_000
#: Listed rows up to which the exact join's side is broadcast.
MOST_BROADCAST = 50_000
#: Query parameters that do not change what a URL leads to.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) after the first ``://`` up to / ? # or the end, and path up to ? # or the end; both empty for
    null or where there is no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    part = lambda group: F.coalesce(F.regexp_extract(after, "(?s)^([^/?#]*)([^?#]*)", group), F.lit(""))
    return lower_ascii(part(1)), part(2)


def canonical(url: Column) -> Column:
    """A URL's canonical form: host without www., port 80 or 443, path without index page and last slash, query without
    tracking parameters, no scheme and no fragment."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.[a-z]+$", "/"), "/+$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def bloom_blocks(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(block, words) of a blocked Bloom filter over column ``key``: each key sets BITS bits in one 512-bit block."""
    n_blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))
    word, bit = _bits()
    hashed = keys.select(_block("key", n_blocks).alias("block"), F.explode(F.arrays_zip(word.alias("w"), bit.alias("b"))).alias("x"))
    words = [F.coalesce(F.bit_or(F.when(F.col("x.w") == k, F.col("x.b"))), F.lit(0).cast("long")) for k in range(8)]
    return hashed.groupBy("block").agg(F.array(*words).alias("words")), n_blocks


def _block(key: str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n_blocks))


def _bits() -> tuple[Column, Column]:
    """Word numbers and bit masks of a key's bits, from one more hash: nine bits of it for each."""
    h = F.xxhash64(F.lit("bits"), F.col("key"))
    more = F.xxhash64(F.lit("more"), F.col("key"))
    nine = [F.shiftrightunsigned(h if k < 7 else more, 9 * (k % 7)).bitwiseAND(F.lit(511)) for k in range(BITS)]
    return F.array(*(F.shiftright(n, 6).cast("int") for n in nine)), F.array(*(F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(F.lit(63)).cast("int")) for n in nine))


def possible_hits(candidates: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """The candidates (column ``key``) that the filter of ``keys`` passes: all listed ones and a few others."""
    blocks, n_blocks = bloom_blocks(keys, n_keys)
    word, bit = _bits()
    probed = candidates.withColumn("block", _block("key", n_blocks)).join(F.broadcast(blocks) if n_blocks <= MOST_BLOCKS else blocks, "block")
    probe = F.arrays_zip(word.alias("w"), bit.alias("b"))
    passes = F.forall(probe, lambda x: F.get(F.col("words"), x["w"]).bitwiseAND(x["b"]) != 0)
    return probed.where(passes).drop("block", "words")


def _listed(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """The candidates whose key is one of ``keys``, with its columns: the filter first, then the exact join."""
    n_keys = keys.count()
    return possible_hits(candidates, keys.select("key"), n_keys).join(F.broadcast(keys) if n_keys <= MOST_BROADCAST else keys, "key")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (null if none fits), verdict, listed.

    ``rules`` has rule (host and path start, such as ``example.com/en/``) and verdict; a rule fits its host and all
    subdomains where the path starts with the rule's; the longest fitting rule wins, of equally long ones the first by
    text.  Without a rule a URL is blocked if its canonical form is one of ``listed`` (column key), else allowed.

    Ids and URLs are shuffled, nothing else.  Null or malformed URLs have an empty host and path, fit no rule and are
    allowed; repeated rows stay; repeated rules and listed keys count once; any table may be empty.
    """
    rules = rules.where("rule is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    rules = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substr(rule, instr(rule, '/'))").alias("rule_path"))
    rule_keys = rules.select(F.concat("rule_host", F.lit(" "), "rule_path").alias("key"), "rule", "verdict")
    url_keys = listed.where("key is not null").select("key").distinct()
    # the distinct lengths of rules' paths: a page's path is cut at each of them
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()]
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    fitting = F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.concat(h, F.lit(" "), p)))))
    distinct = urls.select("url", "host", "path").where("host <> ''").distinct()
    by_rule = _listed(distinct.select("url", F.explode(fitting).alias("key")), rule_keys).select("url", "rule", "verdict")
    by_url = _listed(distinct.select("url", canonical(F.col("url")).alias("key")), url_keys).select("url", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    exact = by_rule.unionByName(by_url)
    best = exact.groupBy("url").agg(
        F.min(F.when(F.col("rule").isNotNull(), F.struct((-F.length("rule")).alias("by"), "rule", "verdict"))).alias("best"),
        F.max(F.col("rule").isNull()).alias("listed"),
    )
    out = urls.join(best.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left")
    is_listed = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("best.verdict", F.when(is_listed, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), is_listed.alias("listed"))

"""URL filter: blocked Bloom filter, then an exact join.

Listed URLs are canonical.  Each sets ``BITS`` bits within one 256-bit block,
chosen by its hash; the blocks are built by one aggregate and form an ordinary
table (block, four longs).  A page's URL is tested against its block alone;
possible hits, and only they, are joined with the list itself, which removes
the false positives.  No page is shuffled with its text, and neither the list
nor the filter passes through the driver: Spark decides by their actual sizes
whether to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesight.llm.common import collision_free, staged

BITS = 6               # bits set for each URL
URLS_PER_BLOCK = 20    # 256 bits for 20 URLs: about 1 % false positives

#: query parameters that name a visit, not a page (fixed values)
TRACKING = "utm_[^=&]*|ref|fbclid|gclid"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; empty for null or without "://"."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    pick = lambda g: F.when(has, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", g)).otherwise("")
    return F.translate(pick(1), upper, lower), pick(2)


def canonical(url: Column) -> Column:
    """One spelling of a URL: no scheme, user, default port, "www.", fragment
    or tracking parameters; other parameters sorted; no slash at the end.
    Null where there is no host."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www\.", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), tail))


def _masks(hashed: Column) -> list[Column]:
    """The four words of a URL's bits within its block."""
    at = [F.pmod(F.shiftrightunsigned(hashed, 8 * i), F.lit(256)) for i in range(BITS)]
    bit = lambda p, w: F.when(F.floor(p / 64) == w, F.expr("1L").cast("long")).otherwise(F.lit(0).cast("long"))
    out = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for p in at:
            word = word.bitwiseOR(F.call_function("shiftleft", bit(p, w), F.pmod(p, F.lit(64)).cast("int")))
        out.append(word)
    return out


def bloom_blocks(urls: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the distinct canonical URLs in column ``canon``."""
    hashed = urls.select(F.pmod(F.xxhash64("canon"), F.lit(blocks)).alias("block"), F.xxhash64(F.lit(1), "canon").alias("h"))
    return hashed.select("block", *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("h")))]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def listed_pages(pages: DataFrame, urls: DataFrame, urls_per_block: int = URLS_PER_BLOCK) -> DataFrame:
    """Rows (canon) of ``pages`` that are listed in ``urls`` (both: canon), once each."""
    listed = staged(urls.where("canon is not null").select("canon").distinct(), "listed")
    blocks = max(1, -(-listed.count() // urls_per_block))
    seen = pages.where("canon is not null").select("canon").distinct()
    probe = seen.select("canon", F.pmod(F.xxhash64("canon"), F.lit(blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.xxhash64(F.lit(1), "canon")))])
    possible = probe.join(bloom_blocks(listed, blocks), "block").where(" and ".join(f"(w{i} & m{i}) = m{i}" for i in range(4))).select("canon")
    return possible.join(listed, "canon")


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule; null if none fits.  A rule
    (host, path, verdict) fits its host and all subdomains where the path
    begins with its path.  ``rules`` is a parameter of bounded length."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):   # a longer one overrides
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def judge(pages: DataFrame, urls: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, canon, rule and verdict appended (underscores
    added where the name is taken).  ``urls`` has listed URLs in a column of the
    same name.

    The longest rule decides; without one, listed URLs are blocked and the
    others allowed.  A null URL, or one without "://", has an empty host and
    path and is allowed.  All rows and columns stay, repeated rows too; an empty
    table or list is no error."""
    taken, name = list(pages.columns), {}
    for c in ("host", "path", "canon", "rule", "verdict", "listed_canon"):
        name[c] = collision_free(taken, c)
        taken.append(name[c])
    host, path = host_and_path(F.col(url))
    with_url = pages.withColumn(name["canon"], canonical(F.col(url)))
    hits = listed_pages(with_url.select(F.col(name["canon"]).alias("canon")), urls.select(canonical(F.col(url)).alias("canon")))
    hits = staged(hits.select(F.col("canon").alias(name["listed_canon"])), "hits")
    # URLs without a canonical form get a key of their own row, so that they do not meet in one task
    key = F.coalesce(F.col(name["canon"]), F.concat(F.lit("\n"), F.monotonically_increasing_id().cast("string")))
    probe = collision_free(taken, "probe")
    joined = with_url.withColumn(probe, key).join(hits, F.col(probe) == F.col(name["listed_canon"]), "left")
    rule = best_rule(host, path, rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col(name["listed_canon"]).isNotNull(), "block").otherwise("allow"))
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], host.alias(name["host"]), path.alias(name["path"]), F.col(name["canon"]), rule["rule"].alias(name["rule"]), verdict.alias(name["verdict"]))

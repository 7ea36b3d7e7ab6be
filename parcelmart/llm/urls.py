"""URL filters: rules by host and path, then a blocked Bloom filter before an exact join. DataFrame functions only.

The filter is a table of words of 64 bits, one for each URLS_PER_WORD listed URLs, but MOST_BLOCKS at most, since it travels to
all tasks: a URL's hash names its word and four bits in it. A list beyond that lets more URLs through to the exact join,
which alone decides.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated pages are
judged each. Repeated listed URLs count once; nulls and empty ones in the list are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmart.llm.texts import written

URLS_PER_WORD, LEAST_BLOCKS, MOST_BLOCKS = 4, 1 << 10, 1 << 21
BITS = 4
#: Fixed values: (verdict, host and path) of the rules.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` (A-Z lower-cased) and ``path`` of the url; both empty without one."""
    place = F.instr(F.col(f"`{url}`"), "://")
    rest = F.when(place > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return pages.withColumns({
        "host": F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")),
        "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    })


def rule_columns(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) for columns host and path: the longest rule that fits wins; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, path = text.partition("/")
        fits = (F.concat(F.lit("."), F.col("host")).endswith("." + name)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def canonical_url(host: Column, path: Column) -> Column:
    """Host without ``www.``, path without a closing slash or ``.html``; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html?|/+)$", ""))


def _place(url: Column, blocks: int) -> tuple[Column, Column]:
    """The word of the filter that a URL belongs to, and its bits there."""
    bits = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.pmod(F.shiftrightunsigned(F.xxhash64(url, F.lit(1)), 8 * i), F.lit(64)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(F.xxhash64(url), F.lit(blocks)), bits


def blocks_for(urls: int) -> int:
    """Words of the filter for so many listed URLs."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, urls // URLS_PER_WORD))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word) of the listed canonical URLs (column canonical): at most ``blocks`` rows."""
    block, bits = _place(F.col("canonical"), blocks)
    return listed.groupBy(block.alias("block")).agg(F.bit_or(bits).alias("word"))


def listed_pages(pages: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """``pages`` (with column canonical) and ``listed``, true if the canonical URL is in the list.

    Pages that the filter excludes stay where they are; only the others are shuffled to the exact hash join.
    """
    words = bloom_filter(listed, blocks)
    block, bits = _place(F.col("canonical"), blocks)
    # at most ``blocks`` rows of 16 bytes, and those are at most MOST_BLOCKS: 32 MB
    asked = pages.withColumns({"block": block, "bits": bits}).join(F.broadcast(words), "block", "left")
    possible = asked.withColumn("possible", F.coalesce(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)))
    possible = possible.drop("block", "bits", "word")
    names = listed.select("canonical").distinct().withColumn("listed", F.lit(True))
    exact = possible.where("possible").join(names.hint("shuffle_hash"), "canonical", "left")
    rest = possible.where("not possible").withColumn("listed", F.lit(False))
    return exact.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(rest).drop("possible")


def judge_urls(pages: DataFrame, listed_urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES, blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every page; ``listed_urls`` has a column url.

    The longest fitting rule decides; without one a listed URL is blocked and any other allowed. The list is written
    once; the filter has ``blocks`` words, or as many as its length asks for.
    """
    canonical = canonical_url(F.col("host"), F.col("path"))
    names = with_host_and_path(listed_urls.select("url")).select(canonical.alias("canonical")).where("canonical != ''").distinct()
    names = written(names, "listed-urls")
    asked = with_host_and_path(pages.select("page_id", "url")).select("page_id", "host", "path", canonical.alias("canonical"))
    rule, verdict = rule_columns(rules)
    found = listed_pages(asked, names, blocks or blocks_for(names.count()))
    return found.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")

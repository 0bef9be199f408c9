"""URL filters: ordered prefix rules, then a list of URLs behind a blocked Bloom filter.

The filter has one row per block of 512 bits (eight 64-bit words, one bit of each per URL), so
building it is one aggregation and asking it is one join by block. Possible hits are then
joined with the list itself, which leaves no false positive. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairstream.plans.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
TRACKING = r"(?:^|&)(?:utm_[^&=]*|ref)(?:=[^&]*)?"
WORDS = 8
BITS_A_URL = 16
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without tracking parameters.

    Scheme and fragment do not count. Null where the URL has no host.
    """
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(F.regexp_extract(url, QUERY, 1), F.lit("")), TRACKING, ""), "^&", "")
    return F.when(host != "", F.concat(host, path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise("")))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Position (from 0) of the longest rule that fits; null if none does."""
    found = None
    for at, rule in sorted(enumerate(rules), key=lambda r: -len(r[1].text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(at)) if found is None else found.when(fits, F.lit(at))
    return F.lit(None).cast("int") if found is None else found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit("bits")), 6 * word).bitwiseAND(F.lit(63))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def bloom_filter(listed: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``key`` -> ``block, w0 .. w7`` and the number of blocks, sized for ``rows`` keys."""
    blocks = max(1, -(-rows * BITS_A_URL // 512))
    masks = [F.bit_or(_bit(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)]
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*masks), blocks


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """``page_id, url`` -> ``page_id, host, path, rule, verdict``, one row per row.

    The longest rule that fits decides; without one a URL is blocked if its canonical form is
    in ``listed`` (one column ``key`` of canonical URLs; nulls and repeats do no harm), else
    allowed. A null URL or one without ``://`` has an empty host and path, fits no rule and is
    allowed. Rows that repeat are judged alike; an empty table gives an empty result.
    """
    keys = stored(listed.filter("key IS NOT NULL").select("key").distinct(), "listed-urls")
    count = keys.count()
    small = count <= BROADCAST_ROWS
    bloom, blocks = bloom_filter(keys, count)
    bloom = stored(bloom, "url-filter")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("key"))
    rows = rows.withColumn("at", matching_rule(F.col("host"), F.col("path"), rules))
    texts = F.array(*(F.lit(r.text) for r in rules)).cast("array<string>")
    verdicts = F.array(*(F.lit(r.verdict) for r in rules)).cast("array<string>")
    decided = rows.filter("at IS NOT NULL OR key IS NULL").select(
        "page_id", "host", "path", F.get(texts, "at").alias("rule"),
        F.coalesce(F.get(verdicts, "at"), F.lit("allow")).alias("verdict"),
    )
    open_rows = rows.filter("at IS NULL AND key IS NOT NULL").withColumn("block", _block(F.col("key"), blocks))
    # 64 bytes a block, so the filter is sent to all executors only below a few MB
    asked = open_rows.join(F.broadcast(bloom) if small else bloom, "block", "left")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(_bit(F.col("key"), i)) != 0)
    asked = asked.select("page_id", "host", "path", "key", hit.alias("hit"))
    nothing = F.lit(None).cast("string").alias("rule")
    passed = asked.filter(~F.col("hit")).select("page_id", "host", "path", nothing, F.lit("allow").alias("verdict"))
    exact = keys.select("key", F.lit("block").alias("found"))
    possible = asked.filter("hit").join(F.broadcast(exact) if small else exact, "key", "left")
    checked = possible.select("page_id", "host", "path", nothing, F.coalesce("found", F.lit("allow")).alias("verdict"))
    return decided.unionByName(passed).unionByName(checked)

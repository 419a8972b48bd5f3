"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits on to an exact hash join.

A canonical URL is host + path: what follows the scheme, the host's A-Z lower-cased, query and fragment cut off.  A page
whose canonical URL is listed is blocked: the filter drops nearly all pages that are not listed, and the exact join drops
its false positives, so a verdict never rests on the filter.  Rules come first: a rule is a host (or a parent domain)
followed by a path prefix, with a verdict; a page probes them in the same way with every (domain suffix, path prefix)
pair whose prefix length occurs among the rules, and the longest that fits decides.

Null urls and urls without "://" have an empty host and path and match nothing.  Null rules and list entries are ignored;
of equal rules one that blocks wins.  Repeated pages are judged each by itself (page_id may be null or repeated); extra
columns are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.shared import table

#: Bits set per entry, one in each 64-bit lane of its block; entries per block on average.
LANES = 4
ENTRIES_PER_BLOCK = 8
#: A filter of at most so many blocks (40 bytes each) is broadcast; a larger one is joined by block.
MOST_BROADCAST_BLOCKS = 1 << 18

#: The production rules of op7_url_filter, and the names of sites, under any domain, whose pages it lists.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
SITES = ["ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

_URL = r"^(?s:(.*?))://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end; path: from there up to "?", "#" or the end."""
    host = F.translate(F.regexp_extract(url, _URL, 2), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))


def _lane_bits(key: str) -> list[Column]:
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 'lane'), {6 * k}) & 63 as int))") for k in range(LANES)]


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """entries(key) -> (block long, lane0 .. long): one row for each block that is not empty."""
    bits = entries.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *(b.alias(f"lane{k}") for k, b in enumerate(_lane_bits("key"))))
    return bits.groupBy("block").agg(*(F.bit_or(f"lane{k}").alias(f"lane{k}") for k in range(LANES)))


def possible_hits(probes: DataFrame, entries: DataFrame, count: int) -> DataFrame:
    """The rows of probes(.., key) that the filter of entries(key) lets pass; count is the number of entries."""
    blocks = max(1, -(-count // ENTRIES_PER_BLOCK))
    bloom = bloom_filter(entries, blocks)
    bloom = F.broadcast(bloom) if blocks <= MOST_BROADCAST_BLOCKS else bloom
    passed = probes.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(bloom, "block")
    for k, bit in enumerate(_lane_bits("key")):
        passed = passed.where(F.col(f"lane{k}").bitwiseAND(bit) != 0)
    return passed.select(*probes.columns)


def longest_entries(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """pages(host, path) -> distinct (host, path, entry, verdict): the longest listed entry that fits.

    entries(key, verdict): a host suffix of whole labels followed by the beginning of a path.
    """
    entries = entries.where("key is not null and verdict is not null").groupBy("key").agg(F.max("verdict").alias("verdict"))
    lengths = entries.select((F.length("key") - F.instr("key", "/") + 1).alias("n")).agg(F.count("*").alias("c"), F.sort_array(F.collect_set("n")).alias("n")).first()
    urls = pages.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.array_distinct(F.array(*(F.substring("path", 1, n) for n in lengths["n"] or [1])))
    probes = urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes)).select("host", "path", F.concat("suffix", "prefix").alias("key"))
    exact = possible_hits(probes, entries, lengths["c"]).join(entries, "key")
    best = F.max(F.struct(F.length("key").alias("size"), "key", "verdict")).alias("best")
    return exact.groupBy("host", "path").agg(best).select("host", "path", F.col("best.key").alias("entry"), F.col("best.verdict").alias("verdict"))


def canonical_parts(pages: DataFrame) -> DataFrame:
    """pages(page_id, url) -> (page_id, host, path)."""
    host, path = host_and_path(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def site_urls(parts: DataFrame, names: list[str]) -> DataFrame:
    """parts(host, path) -> (key): the canonical URLs of the sites with one of the names as a label of their host."""
    named = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, names)))
    return parts.where(named).select(F.concat("host", "path").alias("key")).distinct()


def judge(parts: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """parts(page_id, host, path) -> (page_id, host, path, rule string, listed boolean, verdict string).

    rules(key, verdict): the longest that fits decides.  listed(key): otherwise a page whose canonical URL is listed is
    blocked, and any other page allowed.  Pages of one host and path are judged once, before the exact join back.
    """
    by_rule = longest_entries(parts, rules).withColumnsRenamed({"entry": "rule", "verdict": "rule_verdict"})
    listed = listed.where("key is not null").select("key").distinct()
    urls = parts.where("host <> ''").select("host", "path").distinct().withColumn("key", F.concat("host", "path"))
    by_list = possible_hits(urls, listed, listed.count()).join(listed, "key").select("host", "path", F.lit(True).alias("listed"))
    judged = parts.join(by_rule, ["host", "path"], "left").join(by_list, ["host", "path"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    other = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", "listed", F.coalesce("rule_verdict", other).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("verdict")) for k, v in RULES))))
    parts = canonical_parts(table(spark, sf_dir, "pages"))
    return judge(parts, rules, site_urls(parts, SITES)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in RULES)
_SITES = ", ".join(f"'{k}'" for k in SITES)
OP7_SQL = f"""
with parts as (
    select row_number() over () as n, page_id,
        case when contains(url, '://') then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when contains(url, '://') then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
    from pages),
rules(key, verdict) as (values {_VALUES}),
listed as (select distinct host || path as key from parts where list_has_any(string_split(host, '.'), [{_SITES}])),
split as (select key, verdict, split_part(key, '/', 1) as domain, substr(key, instr(key, '/')) as prefix from rules),
fits as (
    select n, key, verdict, row_number() over (partition by n order by length(key) desc, key desc) as k
    from parts join split on (host = domain or ends_with(host, '.' || domain)) and starts_with(path, prefix))
select page_id, host, path, f.key as rule, coalesce(f.verdict, case when l.key is not null then 'block' else 'allow' end) as verdict
from parts p left join fits f on f.n = p.n and f.k = 1 left join listed l on l.key = host || path
"""

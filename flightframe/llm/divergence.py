"""Source divergence audit: how far the term distributions of the sources of a language are apart.

Terms are runs of letters A-Z and of characters from U+0080 on; only A-Z is lower-cased.  A language keeps the terms of at least `least`
of its documents.  A group is a (lang, source) pair; its smoothed share of a kept term is 1 + floor(10^9 * (count + 5) /
(N + 5 * V)), with N its occurrences of kept terms and V their number.

The kept terms of a language are dealt into blocks of about BLOCK by hash, and within a block numbered by falling count.
Over these numbers each group has a segment tree of its counts.  Nodes are hash-consed level by level for all groups of a
tile (a block of terms by up to about TILE groups): equal subtrees of counts are one node, wherever they stand.  Two groups
are priced by going down both trees at once: pairs of nodes that are equal count once, so the long runs of rare terms
that neither group has cost one pair a level.  Blocks add up.  Tiles of groups meet in pairs, so a language with many sources
is spread over tasks; the result itself has a row for each ordered pair of sources, as the report asks.

Null text, lang and source count as empty.  Repeated rows are documents of their own.  Ties are ranked by the bytes of the item.
Very long texts are counted in pieces.  Other columns are left out; an empty table gives an empty result; a language without kept terms
has pairs of value 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightframe.llm.shared import table, text_slices, written
from flightframe.llm.words import LOWER, mix, span_hashes, word_bounds

LEAST, SMOOTH, UNIT, TOP = 30, 5, 10**9, 50
#: Kept terms of a block and groups of a tile, about.
BLOCK, TILE = 2048, 64
#: Bytes of text that are counted at once; a text of more than twice as many is counted in pieces.
SLICE = 2 << 20

#: Bytes of terms; and bytes of terms with A-Z lower-cased, all others as spaces.
TERMS = np.zeros(256, bool)
TERMS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPACED = np.where(TERMS, LOWER, 0x20).astype(np.uint8)
#: Words under another alphabet: a second hash.
OTHER = SPACED ^ np.uint8(0xA5)


def long_text(text: bytes) -> tuple[list[bytes], list[int]]:
    """The distinct terms of one text and how often each stands there, held by distinct terms only."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        part = text[at : at + SLICE].translate(SPACED.tobytes())
        cut = part.rfind(b" ") + 1 if at + SLICE < len(text) else len(part)
        if not cut:  # a term that is longer than a slice
            end = next((k for k in range(at + SLICE, len(text)) if not TERMS[text[k]]), len(text))
            part, cut = text[at:end].translate(SPACED.tobytes()), end - at
        found.update(part[:cut].split())
        at += cut
    return list(found), list(found.values())


def slice_terms(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts (bytes and offsets) of groups (a number each): group, term, occurrences and texts that have it, a row per group and term."""
    starts, ends, bounds = word_bounds(data, offsets, TERMS)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    group = groups[doc]
    first, second = (span_hashes(data, [(starts, ends)], fold)[0] ^ mix(group.astype(np.uint64)) for fold in (SPACED, OTHER))
    order = np.argsort(first, kind="stable")  # texts of a term stay in order
    fresh = lambda x: np.append(True, x[1:] != x[:-1])[: len(x)]
    new = fresh(first[order])
    if (fresh(second[order]) & ~new).any():  # two terms share the first hash
        order = np.lexsort((second, first))
        new = fresh(first[order]) | fresh(second[order])
    heads = np.flatnonzero(new)
    of_text = np.add.reduceat((new | fresh(doc[order])).astype(np.int64), heads) if len(heads) else heads
    at = order[heads]
    size = ends[at] - starts[at]
    cuts = np.concatenate(([0], np.cumsum(size)))
    raw = SPACED[data[np.repeat(starts[at] - cuts[:-1], size) + np.arange(cuts[-1])]]
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)])
    return group[at], terms, np.diff(np.append(heads, len(order))), of_text


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(text, lang, source) -> (lang, source, term, n long, df long), added up: occurrences, and documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", SLICE):
                names = [part.column(c).dictionary_encode() for c in ("lang", "source")]
                lang, source = (np.asarray(x.indices).astype(np.int64) for x in names)
                width = len(names[1].dictionary)
                if len(data) > 2 * SLICE:
                    terms, n = long_text(data.tobytes())
                    group, terms, n, df = np.full(len(n), lang[0] * width + source[0]), pa.array(terms, pa.large_binary()), np.array(n, np.int64), np.ones(len(n), np.int64)
                else:
                    group, terms, n, df = slice_terms(data, offsets, lang * width + source)
                for at in range(0, len(n), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    columns = [names[0].dictionary.take(pa.array(group[some] // width)), names[1].dictionary.take(pa.array(group[some] % width)), terms[some].cast(pa.large_string()).cast(pa.string()), pa.array(n[some]), pa.array(df[some])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])

    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = texts.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (counts + SMOOTH) / total) without a product that leaves 64 bits; total: N + SMOOTH * V."""
    out, rest, total = np.zeros(len(counts), np.int64), counts.astype(np.int64) + SMOOTH, max(1, total)  # 0: no terms
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


class Forest:
    """Hash-consed segment trees over the same places: counts is groups x places; a place beyond the last has count -1."""

    def __init__(self, counts: np.ndarray):
        places = 1 << max(0, counts.shape[1] - 1).bit_length()
        padded = np.full((len(counts), places), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        #: By level from the leaves up: the count of a leaf; left and right node of others.
        self.counts, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(self.counts)
        while nodes.shape[1] > 1:
            pairs, nodes_up = np.unique(nodes[:, ::2] * n + nodes[:, 1::2], return_inverse=True)
            self.levels.append((pairs // n, pairs % n))
            nodes, n = nodes_up.reshape(len(counts), -1), len(pairs)
        self.roots = nodes[:, 0]

    def size(self, level: int) -> int:
        return len(self.levels[level - 1][0]) if level else len(self.counts)


def prices(a: Forest, i: int, total_a: int, b: Forest, js: np.ndarray, totals_b: np.ndarray) -> np.ndarray:
    """For tree i of a and each tree of js of b the sum of the distances of their shares; equal node pairs are priced once."""
    pair, x, y = np.arange(len(js)), np.full(len(js), a.roots[i]), b.roots[js]
    ups = []
    for level in range(len(a.levels), 0, -1):  # down: distinct pairs of nodes of each pair of groups
        (ax, ay), (bx, by) = a.levels[level - 1], b.levels[level - 1]
        na, nb = a.size(level - 1), b.size(level - 1)
        # one id a pair of nodes: at most TILE pairs of groups by the nodes of two tiles, far below 2 ** 63
        keys = np.concatenate(((pair * na + ax[x]) * nb + bx[y], (pair * na + ay[x]) * nb + by[y]))
        keys, place = np.unique(keys, return_inverse=True)
        ups.append(place)
        y, keys = keys % nb, keys // nb
        pair, x = keys // na, keys % na
    ca, cb = a.counts[x], b.counts[y]
    value = np.zeros(len(pair), np.int64)
    for k in range(len(js)):
        low, high = np.searchsorted(pair, (k, k + 1))
        value[low:high] = np.where(ca[low:high] < 0, 0, np.abs(shares(np.maximum(ca[low:high], 0), total_a) - shares(np.maximum(cb[low:high], 0), int(totals_b[k]))))
    for place in reversed(ups):  # up: each pair of nodes is the sum of its two halves
        value = value[place[: len(place) // 2]] + value[place[len(place) // 2 :]]
    return value


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, q_n long): the terms of at least `least` documents of a language, and their occurrences there."""
    return counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("q_n")).where(F.col("df") >= least).select("lang", "term", "q_n")


def _share(count: str, n: str, v: str) -> str:
    return f"1 + (cast({UNIT} as decimal(12,0)) * cast({count} + {SMOOTH} as decimal(20,0))) div ({n} + {SMOOTH} * {v})"


def top_terms(cells: DataFrame, groups: DataFrame, languages: DataFrame) -> DataFrame:
    """cells(lang, source, term, n, q_n) -> (lang, source, part, item, value, rank): the terms a group has most beyond its language."""
    joined = cells.join(groups, ["lang", "source"]).join(languages.select("lang", F.col("n_lang")), "lang")
    values = joined.select("lang", "source", F.col("term").alias("item"), (F.expr(_share("n", "n_group", "v")) - F.expr(_share("q_n", "n_lang", "v"))).cast("long").alias("value")).where("value > 0")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return values.withColumn("rank", place).where(F.col("rank") <= TOP).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def pair_values(spark: SparkSession, cells: DataFrame, groups: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, a, b, value long) for each two sources a < b of a language.  cells(lang, source, term, n, q_n), groups(lang,
    source, n_group, v), languages(lang, v)."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).cast("int")
    dealt = F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block")
    # places of a block: by falling count, so that the rare terms, which most groups lack, are neighbours
    terms = cells.select("lang", "term", "q_n").distinct().join(languages.select("lang", "v"), "lang").select("lang", "term", "q_n", dealt)
    placed = terms.withColumn("place", (F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("q_n"), "term")) - 1).cast("int"))
    placed = written(spark, placed.select("lang", "term", "block", "place"), "places")
    widths = placed.groupBy("lang", "block").agg(F.count("*").cast("int").alias("width"))
    # languages without kept terms have one empty block
    widths = widths.unionByName(languages.where("v = 0").select("lang", F.lit(0).alias("block"), F.lit(0).alias("width")))
    tiled = groups.join(groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    members = written(spark, tiled.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("source", (F.col("n_group") + SMOOTH * F.col("v")).alias("total")))).alias("m")), "members")
    counts = cells.join(placed, ["lang", "term"]).join(tiled.select("lang", "source", "tile"), ["lang", "source"])
    held = counts.groupBy("lang", "block", "tile").agg(F.collect_list(F.struct("source", "place", "n")).alias("c"))
    tiles = members.join(widths, "lang").join(held, ["lang", "block", "tile"], "left")
    flat = tiles.select("lang", "block", "tile", "width", F.col("m.source").alias("sources"), F.col("m.total").alias("totals"), F.transform("c", lambda c: F.array_position("m.source", c.source).cast("int") - 1).alias("who"), F.col("c.place").alias("place"), F.col("c.n").alias("n"))
    tiles = written(spark, flat, "tiles")
    sides = [tiles.select("lang", "block", *(F.col(c).alias(f"{c}_{s}") for c in ("tile", "width", "sources", "totals", "who", "place", "n"))) for s in "ab"]
    both = sides[0].join(sides[1], ["lang", "block"]).where("tile_a <= tile_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(batch: pa.RecordBatch, i: int, s: str) -> tuple[Forest, list[str], np.ndarray]:
            value = lambda c: np.asarray(batch.column(f"{c}_{s}")[i].values) if batch.column(f"{c}_{s}")[i].is_valid else np.zeros(0, np.int64)
            names = batch.column(f"sources_{s}")[i].as_py()
            counts = np.zeros((len(names), batch.column(f"width_{s}")[i].as_py()), np.int64)
            counts[value("who"), value("place")] = value("n")
            return Forest(counts), names, value("totals")

        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("tile_a")[i].as_py() == batch.column("tile_b")[i].as_py()
                (fa, names_a, totals_a) = forest(batch, i, "a")
                (fb, names_b, totals_b) = (fa, names_a, totals_a) if same else forest(batch, i, "b")
                lang = batch.column("lang")[i].as_py()
                for k, name in enumerate(names_a):
                    js = np.arange(k + 1 if same else 0, len(names_b))
                    if len(js):
                        value = prices(fa, k, int(totals_a[k]), fb, js, totals_b[js])
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(js)), pa.array([name] * len(js)), pa.array([names_b[j] for j in js]), pa.array(value)], ["lang", "a", "b", "value"])

    return both.mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(spark: SparkSession, docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs(text, lang, source) -> (lang, source, part, item, value long, rank int): part pair has each other source of the
    language by falling distance, part term the group's TOP terms that are most above its language."""
    counts = written(spark, term_counts(docs), "counts")
    cells = written(spark, counts.join(kept_terms(counts, least), ["lang", "term"]).select("lang", "source", "term", "n", "q_n"), "cells", counts)
    known = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    v = cells.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    groups = known.join(sums, ["lang", "source"], "left").join(v, "lang", "left").select("lang", "source", F.coalesce("n_group", F.lit(0)).alias("n_group"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = written(spark, groups, "groups")
    languages = groups.groupBy("lang").agg(F.sum("n_group").alias("n_lang"), F.first("v").alias("v"))
    pairs = written(spark, pair_values(spark, cells, groups, languages), "pairs")
    ways = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = ways.select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", place)
    return ranked.unionByName(top_terms(cells, groups, languages))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark, table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""
with docs as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), words as (
  select doc, lang, source, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs
), kept as (
  select lang, term, count(*) as q_n from words group by all having count(distinct doc) >= 30
), cells as (
  select w.lang, w.source, w.term, count(*) as n, any_value(q_n) as q_n from words w join kept using (lang, term) group by all
), grp as (
  select g.lang, g.source, coalesce(s.n, 0)::hugeint as n, coalesce(k.v, 0)::hugeint as v, coalesce(k.n, 0)::hugeint as n_lang
  from (select distinct lang, source from docs) g
  left join (select lang, source, sum(n) as n from cells group by all) s using (lang, source)
  left join (select lang, count(*) as v, sum(q_n) as n from kept group by all) k on g.lang = k.lang
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) as p,
         1 + (1000000000::hugeint * (k.q_n + 5)) // (g.n_lang + 5 * g.v) as q
  from grp g join kept k on g.lang = k.lang left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0)::bigint as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) d
    on d.lang = a.lang and d.source = a.source and d.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from found
)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""

"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison.

Null texts count as empty.  Rows with a null doc_id get a fingerprint and take part in no component (component_id null).
Repeated rows and exact copies share a fingerprint, so they fall into one component.  Extra columns are left out of the
result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.components import connected_components
from flightframe.llm.line_dedup import FILTER_ENTRIES, with_mixed_roots
from flightframe.llm.shared import table, written
from flightframe.llm.url_filter import possible_hits

BITS = 64
SEED = 42
#: Bits in which fingerprints of near copies may differ: of the first 64, and of all 128.
FIRST_RADIUS, WIDE_RADIUS = 20, 34


#: Points of the hash range and hashes from each on that are a band of a text.
BAND_POINTS, BAND_ROWS = 16, 3


#: Pairs of tile rows that one task gets, about: they come to it in one Arrow batch.
PAIRS_PER_TASK = 1024


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of one text: bit i is set if over half the shingles' XXH64 values (repeats included) have it set.

    bytes.lower() and bytes.split() touch ASCII only: A-Z, and white space 0x20 and 0x09 to 0x0D.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    first, last = starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist()
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(first, last, strict=True)), np.uint64, len(first))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, bits long): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, bits long")


def _forest(links_i: np.ndarray, links_j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of many links between n nodes, as few as connect the same nodes: each node with the smallest one it reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[links_i], root[links_j])
        new = root.copy()
        np.minimum.at(new, links_i, low)
        np.minimum.at(new, links_j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (as values) between two tiles: exclusive-or and bit counts, block by block; a spanning forest of them."""
    found_i, found_j = [], []
    for at in range(0, len(a), block):
        near = np.bitwise_count(a[at : at + block, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        found_i.append(i + at)
        found_j.append(j + len(a))
        if sum(map(len, found_i)) > 64 * (len(a) + len(b)):  # dense tiles: keep what connects
            i, j = _forest(np.concatenate(found_i), np.concatenate(found_j), len(a) + len(b))
            found_i, found_j = [i], [j]
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    both = np.concatenate((a, b))
    i, j = _forest(i, j, len(both)) if len(i) > len(both) else (i, j)
    apart = both[i] != both[j]
    return both[i[apart]], both[j[apart]]


def fingerprint_links(spark: SparkSession, prints: DataFrame, radius: int = 3, tile_rows: int = 4096) -> DataFrame:
    """Distinct prints(bits long) -> links(a long, b long) that connect all pairs at a distance of at most radius.

    A tile holds fingerprints whose four 16-bit quarters have the same bit counts.  Two fingerprints that differ in at
    most radius bits have quarter counts that differ by at most radius in sum, so every other tile pair is skipped
    without loss.  Tiles are cut into rows of at most about tile_rows fingerprints; one row pair is one comparison.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("bits", 16 * k).bitwiseAND(0xFFFF)) for k in range(4)]
    cell = sum((q.cast("int") * 32**k for k, q in enumerate(quarter)), F.lit(0))
    cells = prints.select("bits", cell.alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    salted = cells.join(sizes, "cell").select("cell", "bits", F.pmod(F.xxhash64("bits"), F.ceil(F.col("n") / tile_rows)).cast("int").alias("part"))
    tiles = written(spark, salted.groupBy("cell", "part").agg(F.collect_list("bits").alias("fps")), "tiles")
    steps = [sum(d * 32**k for k, d in enumerate(delta)) for delta in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, delta)) <= radius]
    steps = sorted(s for s in steps if s >= 0)  # each unordered pair of tiles once
    # pairs of tile rows first, by name; the arrays go to pairs that there are, and each pair is dealt by itself
    names = tiles.select("cell", "part")
    probes = names.select(F.explode(F.transform(F.array(*map(F.lit, steps)), lambda s: s + F.col("cell"))).alias("to"), "cell", "part")
    pairs = probes.join(names.select(F.col("cell").alias("to"), F.col("part").alias("part_b")), "to").where("cell <> to or part <= part_b")
    pairs = written(spark, pairs.select("cell", "part", "to", "part_b"), "tile_pairs")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // PAIRS_PER_TASK)
    first = pairs.join(tiles, ["cell", "part"]).join(tiles.select(F.col("cell").alias("to"), F.col("part").alias("part_b"), F.col("fps").alias("fps_b")), ["to", "part_b"])
    sides = first.repartition(tasks, "cell", "part", "to", "part_b").select("fps", "fps_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("fps"), batch.column("fps_b")
            out_a, out_b = [], []
            for k in range(batch.num_rows):
                a, b = (np.asarray(x[k].values).view(np.uint64) for x in (left, right))
                i, j = compare_tiles(a, b, radius)
                if len(i):
                    out_a.append(i.view(np.int64))
                    out_b.append(j.view(np.int64))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return sides.mapInArrow(run, "a long, b long")


def simhash_components(spark: SparkSession, docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id long, fingerprint string, component_id long).

    component_id is the smallest doc_id reachable over links of at most radius differing bits, itself included.
    """
    prints = written(spark, with_fingerprint(docs, words), "prints")
    classes = written(spark, prints.groupBy("bits").agg(F.min("doc_id").alias("rep")), "classes")
    parts = connected_components(spark, fingerprint_links(spark, classes.select("bits"), radius))
    of_class = classes.join(parts.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "rep", F.coalesce("root", "bits").alias("root"))
    lowest = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = of_class.join(lowest, "root").select("bits", "component_id")
    return prints.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def gram_set(text: bytes, words: int) -> np.ndarray:
    """The distinct XXH64 values of a text's word shingles, sorted; folded and split as in fingerprint."""
    tokens = text.lower().split()
    size = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    grams = {digest(b" ".join(tokens[k : k + size]), SEED) for k in range(len(tokens) - size + 1)} if tokens else ()
    return np.sort(np.fromiter(grams, np.uint64, len(grams)))


def _bits(hashes: np.ndarray) -> int:
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def wide_fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """SimHash of 128 bits of a set of hashes: theirs and those of their mixed values."""
    mixed = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return _bits(grams), _bits((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """Keys of a sorted set of hashes: the BAND_ROWS lowest from each of BAND_POINTS points of the hash range on, wrapped around."""
    if not len(grams):
        return np.zeros(0, np.int64)
    points = np.arange(BAND_POINTS, dtype=np.uint64) * np.uint64((1 << 64) // BAND_POINTS)
    ring = grams[(np.searchsorted(grams, points)[:, None] + np.arange(BAND_ROWS)) % len(grams)]
    key = np.zeros(BAND_POINTS, np.uint64)
    for k in range(BAND_ROWS):
        key = (key ^ ring[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return np.unique(key).view(np.int64)


def near_in_tiles(a: np.ndarray, b: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of two tiles (n x 2 words of 64 bits) within FIRST_RADIUS of the first word and WIDE_RADIUS of both."""
    out_i, out_j = [], []
    for at in range(0, len(a), block):
        i, j = np.nonzero(np.bitwise_count(a[at : at + block, None, 0] ^ b[None, :, 0]) <= FIRST_RADIUS)
        near = np.bitwise_count(a[i + at] ^ b[j]).sum(axis=1, dtype=np.int64) <= WIDE_RADIUS
        out_i.append(i[near] + at)
        out_j.append(j[near])
    return np.concatenate(out_i), np.concatenate(out_j)


def _near_prints(a: str, b: str) -> Column:
    """near_in_tiles for two columns of structs, and sizes that don't rule out a similarity of 0.8."""
    first, second = (F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("b0", "b1"))
    sizes = (5 * F.col(f"{a}.size") >= 4 * F.col(f"{b}.size")) & (5 * F.col(f"{b}.size") >= 4 * F.col(f"{a}.size"))
    return (first <= FIRST_RADIUS) & (first + second <= WIDE_RADIUS) & sizes


def pairs_apart(spark: SparkSession, rooted: DataFrame, tile_rows: int) -> DataFrame:
    """rooted(key, id, root, b0, b1) -> distinct pairs(a, b) of near fingerprints in one band and different components.

    A band is cut into tiles of about tile_rows rows; each pair of a band's tiles is dealt by itself.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.stack([np.asarray(batch.column(c)[k].values) for c in ("i", "r", "p", "q")], axis=1).astype(np.int64).tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("parts"), pa.array(rows, pa.binary())], ["key", "part", "parts", "tile"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for x, y, same in zip(batch.column("x"), batch.column("y"), batch.column("same").to_pylist(), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.int64).reshape(-1, 4) for v in (x, y))
                i, j = near_in_tiles(a[:, 2:].view(np.uint64), b[:, 2:].view(np.uint64))
                i, j = a[i, :2], b[j, :2]
                apart = (i[:, 1] != j[:, 1]) & ((i[:, 0] < j[:, 0]) | (not same))
                found.append(np.sort(np.stack([i[apart, 0], j[apart, 0]], axis=1), axis=1))
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    mixed = with_mixed_roots(rooted.select("key", "id", "root")).select("key", F.ceil(F.col("n") / tile_rows).alias("parts"))
    placed = rooted.join(mixed, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    lists = placed.groupBy("key", "part", "parts").agg(F.collect_list(F.struct("id", "root", "b0", "b1")).alias("l"))
    columns = [F.col(f"l.{c}").alias(n) for c, n in (("id", "i"), ("root", "r"), ("b0", "p"), ("b1", "q"))]
    tiles = written(spark, lists.select("key", "part", "parts", *columns).mapInArrow(pack, "key long, part long, parts long, tile binary"), "tiles")
    far = tiles.select("key", F.col("part").alias("own"), F.col("tile").alias("x"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("part"))
    sides = far.join(tiles.select("key", "part", F.col("tile").alias("y")), ["key", "part"])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.withColumn("same", F.col("own") == F.col("part")).repartition(tasks, "key", "own", "part")
    return written(spark, dealt.select("x", "y", "same").mapInArrow(compare, "a long, b long").distinct(), "pairs", tiles)


def near_copies(spark: SparkSession, docs: DataFrame, words: int = 5, tile_rows: int = 8192) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, component_id): components of texts whose word shingles have a Jaccard similarity of 0.8 or more.

    Texts meet where they share a band (see band_keys; over 0.9999 of the pairs at 0.8 do), so the work grows with the texts and not with their
    square.  A text meets the first and the last of its bands; bands that then still mix components are compared whole, by tiles.
    Their 128-bit fingerprints are compared with a radius that at 0.8 (about 19 bits apart on average)
    loses few pairs (a test finds at least 0.97 of those of 5 shingles and 0.99 of those of 30 to 300); each pair found is verified by the exact similarity of its shingle sets.
    Rows with a null doc_id are left out.
    """

    def sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [gram_set(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column("text")]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch)
            both = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes), keys], ["doc_id", "node", "b0", "b1", "size", "keys"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in sets_of(batch)]
            nodes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.binary())], ["node", "grams"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                good.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = written(spark, known.mapInArrow(prints, "doc_id long, node long, b0 long, b1 long, size long, keys array<long>"), "prints")
    # equal sets are one node
    nodes = written(spark, rows.groupBy("node").agg(F.min("doc_id").alias("rep")), "nodes")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs with a similarity of 0.8 or more; a text's gram set is several times its size, so only those that are compared are made again and stored."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # of equal sets that of the document with the smallest doc_id; one that repeats its doc_id may have other sets as well
        wanted = written(spark, nodes.join(ends, "node", "left_semi").select("node", F.col("rep").alias("key")), "wanted")
        some = possible_hits(known.withColumnRenamed("doc_id", "key"), wanted.select("key").distinct(), FILTER_ENTRIES)
        again = some.join(wanted.select("key").distinct(), "key", "left_semi").select("text").mapInArrow(grams, "node long, grams binary")
        sets = written(spark, again.join(wanted.select("node"), "node", "left_semi").select("node", "grams").dropDuplicates(["node"]), "sets", wanted)
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        return written(spark, both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "near", pairs, sets)

    # a band's texts first meet two of them, so a group of near copies of any size costs two pairs a text and band
    bands = rows.select("node", F.struct("b0", "b1", "size").alias("own"), F.explode("keys").alias("key")).groupBy("key", "node").agg(F.min("own").alias("own"))
    bands = written(spark, bands, "bands")
    ends = [f(F.struct("node", "own.b0", "own.b1", "own.size")).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    hubs = written(spark, bands.groupBy("key").agg(*ends).where("low.node < high.node"), "hubs")
    members = written(spark, possible_hits(bands, hubs.select("key"), FILTER_ENTRIES).join(hubs, "key"), "members", bands, hubs)
    met = members.select("node", "own", F.explode(F.array("low", "high")).alias("hub")).where((F.col("node") != F.col("hub.node")) & _near_prints("own", "hub"))
    pairs = written(spark, met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct(), "pairs")
    links = verified(pairs)
    roots = written(spark, connected_components(spark, links), "roots")
    # pairs with the hubs are known; bands of three texts or fewer have no others
    inner = members.where("node <> low.node and node <> high.node").select("key", F.col("node").alias("id"), "own.b0", "own.b1")
    rooted = inner.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rest = pairs_apart(spark, written(spark, rooted.select("key", "id", "root", "b0", "b1"), "rooted", members), tile_rows)
    if rest.limit(1).count():
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(rest))
        roots = written(spark, connected_components(spark, stars), "roots")
    roots = roots.withColumnRenamed("root", "top")
    named = nodes.join(roots, "node", "left").select("node", "rep", F.coalesce("top", "node").alias("top"))
    lowest = named.groupBy("top").agg(F.min("rep").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(lowest, "top").select("node", "component_id"), "node").select("doc_id", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark, table(spark, sf_dir, "documents"))

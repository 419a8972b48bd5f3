"""Exact top-k search by inner product: ball trees per shard, searched by branch and bound.

Components are scaled to integers, so scores are exact.  Rows are dealt to shards of about SHARD_BYTES by a hash of their
vector; each shard gets a balanced ball tree (halves along the axis of greatest spread, a centre and a radius a node).
A block of queries goes down a tree: no row below a node can score more than query * centre + length of the query *
radius.  Leaves are read in the order of that bound, and a node is left out once its bound is below the k-th score known
so far.  That score is shared: each block searches one shard first, all others start from what came out, and a task hands
it on from shard to shard.  Bounds are rounded up and ties are followed, so nothing is lost.

Equal vectors are searched once: of the rows that share a vector only the k + 1 with the smallest ids can be in a result, and of
the queries that share one each gets the same rows, without its own.

A row takes part if its vector is not null and holds no null and no component that is not finite; vectors of different
numbers of components are not compared, an empty vector scores 0 with every other empty one.  A row with a null id is a candidate
(behind all others of its score) and no query.  Rows that repeat, or repeat an id, are rows of their own: a query leaves
out one row of its own id and vector.  Extra columns are left out; an empty table gives an empty result.  A score that needs more
than 64 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightframe.llm.shared import table, written

#: Bytes of scaled components in a shard, and queries in a block, about.
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 1 << 19
LEAF = 64
#: Shards that one task searches for a block, one after the other.
SHARE = 4
EXACT = float(1 << 53)


def with_vectors(rows: DataFrame, column: str, scale: int) -> DataFrame:
    """rows(vec_id, column) -> (vec_id long, key string, x array<long>) of the rows that take part."""
    fit = F.forall(column, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    x = rows.where(F.col(column).isNotNull()).where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda v: F.floor(scale * v.cast("double"))).alias("x"))
    half = lambda *more: F.lpad(F.hex(F.xxhash64(*more, "x", F.size("x"))), 16, "0")
    return x.select("vec_id", F.concat(half(), half(F.lit("second"))).alias("key"), "x")


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x (n x d) -> order of its rows by leaf, bounds (nodes x 2) in that order, centres and radii.

    Nodes stand level by level: the children of node i are 2i + 1 and 2i + 2, and all leaves are on the last level.
    """
    order, bounds = np.arange(len(x)), [(0, len(x))]
    levels = max(0, (len(x) - 1) // LEAF).bit_length()
    for level in range(levels):
        for low, high in bounds[-(1 << level) :]:
            part = order[low:high]
            axis = int(np.argmax(x[part].var(axis=0))) if len(part) > 1 and x.shape[1] else -1
            mid = len(part) // 2
            if axis >= 0:
                order[low:high] = part[np.argpartition(x[part, axis], mid)]
            bounds += [(low, low + mid), (low + mid, high)]
    centres = np.array([x[order[low:high]].mean(axis=0) if high > low else np.zeros(x.shape[1]) for low, high in bounds])
    radii = np.array([np.sqrt(((x[order[low:high]] - c) ** 2).sum(axis=1).max()) if high > low else 0.0 for (low, high), c in zip(bounds, centres, strict=True)])
    return order, np.array(bounds, np.int64), centres, radii


class Search:
    """The best k rows of each query of a block, over any number of trees.

    q: queries (m x d integers).  least: a score that k rows of each query are known to have (or less).
    """

    def __init__(self, q: np.ndarray, least: np.ndarray, k: int):
        self.q, self.k, self.least = q, k, least.copy()
        self.norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        none = np.zeros(0, np.int64)
        self.who, self.score, self.nulls, self.ids, self.keys = none, none, none, none, np.zeros(0, object)

    def keep(self, who: np.ndarray, score: np.ndarray, nulls: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        who, score, nulls, ids, keys = (np.concatenate(both) for both in ((self.who, who), (self.score, score), (self.nulls, nulls), (self.ids, ids), (self.keys, keys)))
        order = np.lexsort((ids, nulls, -score, who))
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        order, last = order[place < self.k], who[place == self.k - 1]
        self.least[last] = np.maximum(self.least[last], score[order[place[place < self.k] == self.k - 1]])
        self.who, self.score, self.nulls, self.ids, self.keys = who[place < self.k], score[order], nulls[order], ids[order], keys[order]

    def tree(self, x: np.ndarray, bounds: np.ndarray, centres: np.ndarray, radii: np.ndarray, nulls: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> int:
        """Search one tree; x, nulls, ids and keys in the order of its leaves.  Returns the number of leaves read."""
        largest = lambda a: float(np.abs(a.astype(np.float64)).max(initial=0))
        kind = np.float64 if largest(self.q) * largest(x) * x.shape[1] < EXACT else object  # exact either way
        q, x, floats = self.q.astype(kind), x.astype(kind), self.q.astype(np.float64)
        first_leaf, read = len(bounds) // 2, 0

        def upper(who: np.ndarray, node: np.ndarray) -> np.ndarray:
            reach = self.norms[who] * radii[node]
            middle = np.einsum("ij,ij->i", floats[who], centres[node])
            return middle + reach + 1e-9 * (self.norms[who] * np.sqrt((centres[node] ** 2).sum(axis=1)) + reach + 1)

        def visit(who: np.ndarray, leaf: np.ndarray) -> int:
            order = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[order])) + 1
            found = []
            for part in np.split(order, cuts):
                if not len(part):
                    continue
                low, high = bounds[leaf[part[0]]]
                scores = (q[who[part]] @ x[low:high].T).astype(np.int64)
                i, j = np.nonzero(scores >= self.least[who[part], None])
                found.append((who[part][i], scores[i, j], j + low))
            if found:
                w, s, at = (np.concatenate(c) for c in zip(*found, strict=True))
                self.keep(w, s, nulls[at], ids[at], keys[at])
            return len(who)

        every = np.arange(len(q))
        node = np.zeros(len(q), np.int64)
        while first_leaf and node[0] < first_leaf:  # straight down to one leaf: a k-th score to begin with
            left, right = upper(every, 2 * node + 1), upper(every, 2 * node + 2)
            node = 2 * node + 1 + (right > left)
        read += visit(every, node)
        who, at = every, np.zeros(len(q), np.int64)
        bound = upper(who, at)
        while len(at) and at[0] < first_leaf:
            who, at = np.repeat(who, 2), np.stack((2 * at + 1, 2 * at + 2), axis=1).ravel()
            bound = upper(who, at)
            good = bound >= self.least[who]
            who, at, bound = who[good], at[good], bound[good]
        new = at != node[who]
        who, at, bound = who[new], at[new], bound[new]
        order = np.lexsort((-bound, who))
        who, at, bound = who[order], at[order], bound[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        for turn in range(int(place.max(initial=-1)) + 1):  # each query's leaves, best bound first
            now = (place == turn) & (bound >= self.least[who])
            read += visit(who[now], at[now])
        return read


def shards(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows(vec_id, key, x) -> a row per shard: (dim int, part int, tree struct of binaries), written."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("x", "bounds", "centres", "radii", "nulls", "ids", "keys")}
            for k, dim in enumerate(batch.column("dim").to_pylist()):
                ids, keys, nulls = (batch.column(c)[k].values for c in ("ids", "keys", "nulls"))
                x = np.asarray(batch.column("xs")[k].values.flatten()).reshape(len(keys), dim)
                order, bounds, centres, radii = ball_tree(x.astype(np.float64))
                out["x"].append(x[order].tobytes())
                out["bounds"].append(bounds.tobytes())
                out["centres"].append(centres.tobytes())
                out["radii"].append(radii.tobytes())
                out["ids"].append(np.asarray(ids)[order].tobytes())
                out["nulls"].append(np.asarray(nulls, np.int64)[order].tobytes())
                out["keys"].append("".join(keys.take(pa.array(order)).to_pylist()).encode())
            columns = [batch.column("dim"), batch.column("part"), *(pa.array(v, pa.binary()) for v in out.values())]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "part", *out])

    dealt = in_parts(rows, SHARD_BYTES)
    lists = dealt.groupBy("dim", "part").agg(F.collect_list(F.struct("vec_id", "key", "x")).alias("r"))
    flat = lists.select("dim", "part", F.transform("r", lambda r: F.coalesce(r.vec_id, F.lit(0))).alias("ids"), F.transform("r", lambda r: r.vec_id.isNull().cast("long")).alias("nulls"), F.col("r.key").alias("keys"), F.col("r.x").alias("xs"))
    return written(spark, flat.mapInArrow(build, "dim int, part int, x binary, bounds binary, centres binary, radii binary, nulls binary, ids binary, keys binary"), "shards")


def in_parts(rows: DataFrame, most_bytes: int) -> DataFrame:
    """rows(key, x) with dim and part: vectors of one length, dealt into parts of about most_bytes by their key."""
    sized = rows.withColumn("dim", F.size("x"))
    parts = sized.groupBy("dim").agg(F.ceil(F.count("*") * (F.col("dim") + 1) * 8 / most_bytes).cast("int").alias("parts"))
    return sized.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))


def search(spark: SparkSession, pairs: DataFrame, trees: DataFrame, blocks: DataFrame, known: DataFrame | None, k: int) -> DataFrame:
    """pairs(dim, block, part) -> (query string, score long, vec_id long, key string): what can be among a query's best k.

    known(query, least): scores that k rows of a query have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, names = None, None, []

        def told() -> Iterator[pa.RecordBatch]:
            if state is not None and len(state.who):
                ids = pa.array(state.ids, mask=state.nulls.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in state.who]), pa.array(state.score), ids, pa.array(state.keys.tolist())], ["query", "score", "vec_id", "key"])

        for batch in batches:
            for i, (dim, block) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                if last != (dim, block):  # the pairs of a block come one after the other and share its scores
                    yield from told()
                    last, names = (dim, block), batch.column("names")[i].as_py()
                    q = np.asarray(batch.column("qs")[i].values.flatten()).reshape(len(names), dim)
                    state = Search(q, np.array(batch.column("least")[i].values, np.int64), k)
                part = {c: np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("x", np.int64), ("bounds", np.int64), ("centres", np.float64), ("radii", np.float64), ("nulls", np.int64), ("ids", np.int64))}
                n, keys = len(part["ids"]), batch.column("keys")[i].as_py()
                state.tree(part["x"].reshape(n, dim), part["bounds"].reshape(-1, 2), part["centres"].reshape(len(part["radii"]), dim), part["radii"], part["nulls"], part["ids"], np.array([keys[32 * j : 32 * j + 32].decode() for j in range(n)], object))
        yield from told()

    lowest = F.lit(-(1 << 63))
    least = blocks.withColumn("least", lowest) if known is None else blocks.join(known, "query", "left").withColumn("least", F.coalesce("least", lowest))
    lists = least.groupBy("dim", "block").agg(F.collect_list(F.struct("query", "x", "least")).alias("r")).select("dim", "block", F.col("r.query").alias("names"), F.col("r.x").alias("qs"), F.col("r.least").alias("least"))
    lists = written(spark, lists, "queries")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // SHARE)
    sides = pairs.join(lists, ["dim", "block"]).join(trees, ["dim", "part"]).repartition(tasks, "dim", "block", F.expr(f"part div {SHARE}")).sortWithinPartitions("dim", "block", "part")
    return sides.mapInArrow(run, "query string, score long, vec_id long, key string")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("place", place).where(F.col("place") <= k)


def top_k(spark: SparkSession, rows: DataFrame, is_query: Column, k: int, column: str = "embedding", scale: int = 256) -> DataFrame:
    """rows(vec_id, column) -> (query_id, rank int, vec_id, score long): the k rows with the highest inner products with each
    row that is_query (a condition on vec_id) holds for, without that row; ties go to the smaller vec_id."""
    vectors = written(spark, with_vectors(rows, column, scale), "vectors")
    of_key = F.row_number().over(Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last()))
    candidates = vectors.withColumn("copy", of_key).where(F.col("copy") <= k + 1).drop("copy")
    trees = shards(spark, candidates)
    asked = vectors.where(is_query)
    blocks = written(spark, in_parts(asked.dropDuplicates(["key"]).select("key", "x"), BLOCK_BYTES).select("dim", F.col("part").alias("block"), F.col("key").alias("query"), "x"), "blocks")
    names = trees.select("dim", "part").join(blocks.select("dim", "block").distinct(), "dim")
    turns = written(spark, names.withColumn("first", F.row_number().over(Window.partitionBy("dim", "block").orderBy(F.xxhash64("block", "part"))) == 1), "turns")
    begun = written(spark, search(spark, turns.where("first").drop("first"), trees, blocks, None, k + 1), "begun")
    known = begun.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k + 1).select("query", "least")
    rest = search(spark, turns.where("not first").drop("first"), trees, blocks, known, k + 1)
    best = _best(begun.unionByName(rest), k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id", "key"))).alias("best"))
    # each query row leaves out one row of its id and vector
    wanted = asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).join(best, "query")
    own = wanted.withColumn("own", F.array_position(F.transform("best", lambda b: b.vec_id.eqNullSafe(F.col("query_id")) & (b.key == F.col("query"))), True))
    others = own.select("query_id", F.posexplode(F.slice(F.filter("best", lambda _, i: i + 1 != F.col("own")), 1, k)).alias("at", "b"))
    return others.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP13_SQL = """
with fit as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), scored as (
  select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
  from fit q join fit c on q.r <> c.r and len(q.x) = len(c.x) where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""

"""Prefix trie of conversations, built as a burst trie.

A turn is a record: 128 bits of hash of role and text, and the number of code points of the text.  Conversations are cut
into blocks of BLOCK turns, so that one of any length is rows of bounded size; a block hangs below its head, the sequence
of all turns before it, which a running exclusive-or of block hashes names.  Equal blocks of one head are counted first, so a
sequence that very many conversations share is one string from there on.

Below each head stands a burst trie: a container holds the rests (suffixes) of its strings.  A container of more strings
than fit a task is burst: its strings go on to containers by their next turn, which become nodes of the trie, and that again until
all containers are small.  The remaining containers are shards: each is sorted by suffix and swept once, and the sweep
makes its nodes from what neighbours share, with sums over subtrees.  The burst nodes add up the sums of what hangs
below them, deepest first, and so do heads, last block first.  A head that only one conversation reaches has no branches; its turns are
nodes at once, without a sweep.

The ids that end at a node are sorted by ranges, packed to chunks, and hashed chunk by chunk: the hash of one node is a
chain, so its chunks pass through one task, which holds one batch of them at a time.

Turns are ordered by (turn, hash of role and text), null turns first, so ties have an order of their own; turns without
a conv_id are left out; a null role or text is empty.  Repeated rows are turns of their own.  Other columns are
left out; an empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightframe.llm.shared import table, written

#: Hex digits of a record, 8 of them for code points; turns of a block.
RECORD, BLOCK = 40, 256
#: A container is burst beyond so many strings, or so large a share of all: at most MOST containers are burst in a turn.
LEAST, MOST = 4096, 100_000
#: Ids of a chunk.
CHUNK = 1000
#: Turns of the base conversation that others take over: fewer than this.
SHARED, HUNDRED = 6, 100
NODE = "conv_id long, depth long, parent_conv_id long, n long, children long, leaves long, saved long"


def turn_records(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, turn, rec string)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rec = F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.char_length(text)), 8, "0"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", rec.alias("rec"))


def numbered(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns with pos, from 1 in each conversation.  Dealt by ranges, so that a conversation may be larger than a task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(spark, turns.repartitionByRange(parts, "conv_id", "turn", "rec").withColumn("piece", F.spark_partition_id()), "pieces")
    counts = dealt.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "rec"))
    local = dealt.withColumn("inside", inside)
    return local.join(before.select("conv_id", "piece", "before"), ["conv_id", "piece"]).select("conv_id", "rec", (F.col("inside") + F.col("before")).alias("pos"))


def rebuilt(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, total) of all conversations; (conv_id, total, d, rec) of their turns: the first turns of the base
    conversation of each hundred, then their own."""
    rows = written(spark, numbered(spark, turns), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"))
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    m = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv_id", "h", "base", m.alias("m"), (m + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total"))
    convs = written(spark, convs, "convs")
    own = rows.join(convs, "conv_id").where("pos > h").select("conv_id", "total", (F.col("m") + F.col("pos") - F.col("h")).alias("d"), "rec")
    firsts = rows.where((F.col("pos") < SHARED) & (F.col("conv_id") % HUNDRED == 0)).select(F.col("conv_id").alias("base"), "pos", "rec")
    taken = convs.where("m > 0").join(firsts, "base").where("pos <= m").select("conv_id", "total", F.col("pos").alias("d"), "rec")
    return convs.select("conv_id", "total"), own.unionByName(taken)


def blocks_of(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns(conv_id, total, d, rec) -> (conv_id, total, b, head, key, content): key names all turns up to the block's end."""
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "rec"))), lambda t: t.rec), "")
    blocks = turns.groupBy("conv_id", "total", F.expr(f"(d - 1) div {BLOCK}").alias("b")).agg(content.alias("content"))
    blocks = written(spark, blocks.select("*", F.xxhash64("b", "content").alias("x"), F.xxhash64(F.lit("second"), "b", "content").alias("y")), "blocks")
    before = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.where(F.col("total") > BLOCK).select("conv_id", "b", F.bit_xor("x").over(before).alias("hx"), F.bit_xor("y").over(before).alias("hy"))
    name = lambda x, y: F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0"))
    both = blocks.join(heads, ["conv_id", "b"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("hx", "hy")})
    key = name(F.col("hx").bitwiseXOR(F.col("x")), F.col("hy").bitwiseXOR(F.col("y")))
    return both.select("conv_id", "total", "b", F.when(F.col("b") == 0, "").otherwise(name(F.col("hx"), F.col("hy"))).alias("head"), key.alias("key"), "content")


def burst(spark: SparkSession, strings: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """strings(head, key, depth, suffix, n, conv, ...) -> the strings in containers that fit a task, and the nodes that bursting made.

    Strings get container, at_head (the container is a head itself) and opened (it was burst: what is left ends there).
    Nodes, a table a turn: (container, parent, depth, n, conv, chars).
    """
    parts = strings.select("*", F.col("head").alias("container"), F.lit(True).alias("at_head"), F.lit(False).alias("opened"))
    most = max(LEAST, strings.count() // MOST)
    made: list[DataFrame] = []
    while True:
        large = written(spark, parts.where("not opened").groupBy("container").agg(F.count("*").alias("size")).where(F.col("size") > most).select("container", F.lit(True).alias("large")), "large")
        if not large.limit(1).count():
            return parts, made
        marked = parts.join(F.broadcast(large), "container", "left")  # at most MOST rows
        gone = F.col("large").isNotNull()
        goes = gone & (F.col("suffix") != "")
        child = F.md5(F.concat("container", F.substring("suffix", 1, RECORD)))
        step = marked.select(
            *strings.drop("depth", "suffix").columns,
            F.when(goes, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), F.when(goes, F.expr(f"substring(suffix, {RECORD + 1})")).otherwise(F.col("suffix")).alias("suffix"),
            F.when(goes, child).otherwise(F.col("container")).alias("container"), (~goes & F.col("at_head")).alias("at_head"), (F.col("opened") | (gone & ~goes)).alias("opened"),
            F.when(goes, F.col("container")).alias("parent"), F.when(goes, F.substring("suffix", RECORD - 7, 8)).alias("chars"),
        )
        step = written(spark, step, "containers")
        sums = [F.sum("n").alias("n"), F.min("conv").alias("conv"), F.conv(F.first("chars"), 16, 10).cast("long").alias("chars")]
        made.append(written(spark, step.where("parent is not null").groupBy("container", "parent", "depth").agg(*sums), "burst"))
        parts = step.drop("parent", "chars")


def sweep(parts: DataFrame) -> DataFrame:
    """Sorted containers to nodes: rows of kind node, end (the node at which a string's key ends) and top (sums below the
    container's own node).  parts also has children, leaves, saved: what hangs below the end of a string, or nulls."""

    def one(container: str, rows: list[tuple]) -> Iterator[tuple]:
        at_head, opened, top = rows[0][0], rows[0][1], rows[0][2]
        parent, chars, n, conv, children, leaves, saved = [-1], [0], [0], [None], [0], [0], [0]
        path, before, ends = [0], "", []
        for _, _, _, suffix, key, count, who, below, below_leaves, below_saved in rows:
            size, common = len(suffix) // RECORD, 0
            while common < min(len(path) - 1, size) and suffix[RECORD * common : RECORD * common + RECORD] == before[RECORD * common : RECORD * common + RECORD]:
                common += 1
            del path[common + 1 :]
            for k in range(common, size):
                parent.append(path[-1])
                chars.append(int(suffix[RECORD * k + RECORD - 8 : RECORD * k + RECORD], 16))
                for column, value in ((n, 0), (conv, who), (children, 0), (leaves, 0), (saved, 0)):
                    column.append(value)
                path.append(len(parent) - 1)
            at, before = path[-1], suffix
            n[at] += count
            conv[at] = who if conv[at] is None else min(conv[at], who)
            children[at] += below
            leaves[at] += below_leaves
            saved[at] += below_saved
            ends.append((key, at, top + size))
        for i in range(len(parent) - 1, 0, -1):  # children come after their parents
            p = parent[i]
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * chars[i]
            n[p] += n[i]
            conv[p] = conv[i] if conv[p] is None else min(conv[p], conv[i])
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
        level = [top] * len(parent)
        for i in range(1, len(parent)):
            p = parent[i]
            level[i] = level[p] + 1
            yield "node", container, None, conv[i], level[i], None if p == 0 and at_head else conv[p], n[i], children[i], leaves[i], saved[i]
        for key, at, depth in ends:
            yield "end", container, key, None if at == 0 and opened else conv[at], depth, None, None, None, None, None
        yield "top", container, None, None, top, None, None, children[0], leaves[0], saved[0]

    names = ["kind", "container", "key", "conv_id", "depth", "parent_conv_id", "n", "children", "leaves", "saved"]
    kinds = [pa.string()] * 3 + [pa.int64()] * 7

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["at_head", "opened", "depth", "suffix", "key", "n", "conv", "children", "leaves", "saved"]
        held, name, out = [], None, []
        for batch in batches:
            for container, *row in zip(batch.column("container").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
                if container != name and held:
                    out.extend(one(name, held))
                    held = []
                    if len(out) > 50_000:
                        yield batch_of(out)
                        out = []
                name = container
                held.append(tuple(row))
        if held:
            out.extend(one(name, held))
        if out:
            yield batch_of(out)

    sums = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("children", "leaves", "saved")}
    dealt = parts.withColumns(sums).repartition("container").sortWithinPartitions("container", "suffix")
    return dealt.mapInArrow(run, "kind string, container string, key string, conv_id long, depth long, parent_conv_id long, n long, children long, leaves long, saved long")


def level_nodes(spark: SparkSession, strings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One block level: strings(head, key, depth, suffix, n, conv, children, leaves, saved) -> nodes with head (null unless
    the parent is the head's node), ends(key, conv_id, depth), tops(head, children, leaves, saved)."""
    parts, made = burst(spark, strings)
    swept = written(spark, sweep(parts), "swept")
    sums = [F.sum(c).alias(c) for c in ("children", "leaves", "saved")]
    below = swept.where("kind = 'top'").select("container", "children", "leaves", "saved")
    nodes = swept.where("kind = 'node'").select(*(c.split()[0] for c in NODE.split(", ")), F.when(F.col("parent_conv_id").isNull(), F.col("container")).alias("head"))
    extra = below.limit(0)
    for turn in range(len(made) - 1, -1, -1):  # deepest first
        known = below.unionByName(extra).groupBy("container").agg(*sums)
        done = made[turn].join(known, "container", "left").select(
            "container", "parent", "depth", "conv", "n", F.coalesce("children", F.lit(0)).alias("children"), F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("chars")).alias("saved"))
        done = written(spark, done, "added")
        extra = done.groupBy(F.col("parent").alias("container")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        if turn:
            of_parent = done.join(made[turn - 1].select(F.col("container").alias("parent"), F.col("conv").alias("parent_conv_id")), "parent", "left")
        else:
            of_parent = done.withColumn("parent_conv_id", F.lit(None).cast("long"))
        # a parent that is no burst node is the head
        rows = of_parent.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n", "children", "leaves", "saved", F.when(F.col("parent_conv_id").isNull(), F.col("parent")).alias("head"))
        nodes = nodes.unionByName(rows)
    tops = below.unionByName(extra).join(strings.select(F.col("head").alias("container")).distinct(), "container", "left_semi").groupBy(F.col("container").alias("head")).agg(*sums)
    ends = swept.where("kind = 'end'")
    if made:
        convs = made[0].select("container", "conv")
        for more in made[1:]:
            convs = convs.unionByName(more.select("container", "conv"))
        ends = ends.join(convs, "container", "left").withColumn("conv_id", F.coalesce("conv_id", "conv"))
    return nodes, ends.select("key", "conv_id", "depth"), written(spark, tops, "tops")


def id_digests(spark: SparkSession, finals: DataFrame) -> DataFrame:
    """finals(key, conv_id) -> (key, ends_sha256): of the ids in order, joined by commas."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, run in groupby(zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True), lambda r: r[0]):
                ids = [i for _, i in run]
                rows += [(key, ids[at], ",".join(map(str, ids[at : at + CHUNK])).encode()) for at in range(0, len(ids), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["key", "least", "ids"]) if rows else batch.slice(0, 0)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            keys, out = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == name:
                    state.update(b"," + ids)
                    continue
                if state is not None:
                    keys.append(name)
                    out.append(state.hexdigest())
                name, state = key, hashlib.sha256(ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = finals.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key string, least long, ids binary")
    return chunks.repartition("key").sortWithinPartitions("key", "least").mapInArrow(digest, "key string, ends_sha256 string")


def trie_nodes(spark: SparkSession, convs: DataFrame, turns: DataFrame) -> DataFrame:
    """convs(conv_id, total), turns(conv_id, total, d, rec) -> the trie's nodes: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    blocks = written(spark, blocks_of(spark, turns), "placed")
    strings = blocks.groupBy("b", "head", "key", "content").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.max("total").alias("total"))
    strings = written(spark, strings.select("b", "head", "key", F.col("content").alias("suffix"), (F.col("b") * BLOCK).alias("depth"), "n", "conv", "total"), "strings")
    later = strings.where("b > 0")
    reach = written(spark, later.groupBy("head", "b").agg(F.sum("n").alias("reach")), "reach")
    alone = later.join(reach.where("reach = 1").select("head"), "head", "left_semi")
    shared = strings.join(reach.where("reach = 1").select("head"), "head", "left_anti")
    # heads that one conversation reaches: a chain of nodes
    length = (F.length("suffix") / RECORD).cast("long")
    chain = alone.select("head", "conv", "total", "depth", F.explode(F.sequence(F.lit(1).cast("long"), length)).alias("k"))
    deep = F.col("depth") + F.col("k")
    nodes = chain.select(
        F.col("conv").alias("conv_id"), deep.alias("depth"), F.when(F.col("k") > 1, F.col("conv")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n"), (deep < F.col("total")).cast("long").alias("children"),
        F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), F.when(F.col("k") == 1, F.col("head")).alias("head"))
    ends = alone.select("key", F.col("conv").alias("conv_id"), (F.col("depth") + length).alias("depth"))
    one = F.lit(1).cast("long")
    tops = alone.select("head", one.alias("children"), one.alias("leaves"), F.lit(0).cast("long").alias("saved"))
    top = reach.where("reach > 1").agg(F.max("b")).first()[0] or 0
    for level in range(top, -1, -1):
        here = shared.where(F.col("b") == level).drop("b", "total").join(tops.withColumnRenamed("head", "key"), "key", "left")
        found, at, sums = level_nodes(spark, written(spark, here, "level"))
        nodes, ends = nodes.unionByName(found), ends.unionByName(at)
        tops = alone.where(F.col("b") == level).select("head", one.alias("children"), one.alias("leaves"), F.lit(0).cast("long").alias("saved")).unionByName(sums)
    ends = written(spark, ends, "ends")
    everyone = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).where("n > 0")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    root = everyone.join(tops.where("head = ''").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n", zero("children"), F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).cast("long").alias("leaves"), zero("saved"))
    least = (everyone.first() or [None])[0]
    of_head = ends.select(F.col("key").alias("head"), F.col("conv_id").alias("head_conv"))
    inner = nodes.join(of_head, "head", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.when(F.col("head") == "", F.lit(least).cast("long")).otherwise(F.col("head_conv")))).drop("head", "head_conv")
    finals = blocks.where(F.col("b") == F.expr(f"(total - 1) div {BLOCK}")).select("key", "conv_id")
    inside = id_digests(spark, finals).join(ends, "key").select("conv_id", "depth", "ends_sha256")
    turnless = id_digests(spark, convs.where("total = 0").select(F.lit("").alias("key"), "conv_id"))
    digests = inside.unionByName(turnless.select(F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "ends_sha256"))
    named = inner.unionByName(root).join(digests, ["conv_id", "depth"], "left")
    return named.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(spark, *rebuilt(spark, turn_records(table(spark, sf_dir, "conversations"))))


OP11_SQL = """
with turns as (
  select conv_id, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as rec, length(coalesce(text, '')) as chars,
         row_number() over (partition by conv_id order by turn nulls first, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as pos
  from conversations where conv_id is not null
), convs as (
  select conv_id, max(pos) as n, conv_id - conv_id % 100 as base,
         xor(list_reduce([4294967295] || list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6 as h
  from turns group by conv_id
), rebuilt as (
  select c.conv_id, t.pos as d, t.rec, t.chars from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
  union all
  select c.conv_id, least(c.h, coalesce(b.n, 0)) + t.pos - c.h, t.rec, t.chars from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h left join convs b on b.conv_id = c.base
), paths as (
  select conv_id, d, chars, string_agg(rec, '') over (partition by conv_id order by d) as path, count(*) over (partition by conv_id) as total from rebuilt
  union all
  select c.conv_id, 0, 0, '', (select count(*) from rebuilt r where r.conv_id = c.conv_id) from convs c
), nodes as (
  select path, d, min(conv_id) as conv_id, count(*) as n, any_value(chars) as chars,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = total), '')) as ends_sha256
  from paths group by path, d
), kids as (
  select left(path, 32 * (d - 1)) as path, count(*) as n from nodes where d > 0 group by 1
), sums as (
  select left(path, 32 * k) as path, sum((path not in (select path from kids))::int) as leaves, sum((n - 1) * chars) as saved
  from (select path, n, chars, unnest(range(0, d + 1)) as k from nodes) group by 1
)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(k.n, 0) as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, n.ends_sha256
from nodes n join sums s using (path) left join kids k using (path) left join nodes p on n.d > 0 and p.d = n.d - 1 and p.path = left(n.path, 32 * (n.d - 1))
"""

"""The prefix trie, the divergence audit and the exact search, held against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightframe.llm import divergence, prefix_trie, top_k


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), prefix_trie_order(role, text), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        text = ",".join(map(str, sorted(ends[node])))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def prefix_trie_order(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize(("block", "least"), [(256, 4096), (2, 2), (3, 1)])
def test_trie_against_all_prefixes(spark, monkeypatch, block, least):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "LEAST", least)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(-120, 340, 7), *range(1000, 1040), 400, 401, 402]:
        for turn in range(int(rng.integers(1, 9))):
            rows.append((c, turn, "user" if turn % 2 else "assistant", "é" * int(rng.integers(0, 3))))
    rows += [(500 + k, t, "user", f"same {t}") for k in range(30) for t in range(9)]  # copies
    rows += [(701, t, None, f"long {t}") for t in range(40)] + [(702, t, None, f"long {t}") for t in range(25)]
    rows += [(800, None, "a", "x"), (800, None, None, None), (800, 3, "a", ""), (800, 3, "b", ""), (800, 3, "b", ""), (None, 1, "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("rec", "pos", "key", "head", "n", "total")}).repartition(5)
    got = prefix_trie.trie_nodes(spark, *prefix_trie.rebuilt(spark, prefix_trie.turn_records(df)))
    assert rows_of(got, *TRIE) == plain_trie(rows)


def test_trie_of_few_or_no_turns(spark):
    def nodes(rows):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        return rows_of(prefix_trie.trie_nodes(spark, *prefix_trie.rebuilt(spark, prefix_trie.turn_records(df))), *TRIE)

    assert nodes([]) == []
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "user", "gone: its base is absent")]
    assert nodes(rows) == plain_trie(rows)
    assert nodes(rows)[0][1:7] == (0, None, 1, 0, 1, 0)


def plain_divergence(rows, least):
    docs = [(t or "", lang or "", s or "") for t, lang, s in rows]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, *_ in docs]
    df, n = Counter(), defaultdict(Counter)
    for ts, (_, lang, s) in zip(terms, docs, strict=True):
        ts = [t.translate(fold) for t in ts]
        df.update({(lang, t) for t in ts})
        n[lang, s].update(ts)
        n[lang, None].update(ts)
    out = []
    for lang, s in [g for g in n if g[1] is not None]:
        kept = [t for (of, t), k in df.items() if of == lang and k >= least]

        def share(source):
            c = n[lang, source]
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p, q = share(s), share(None)
        pairs = [(sum(abs(p[t] - o[t]) for t in kept), x) for of, x in n if of == lang and x not in (None, s) for o in [share(x)]]
        some = [(p[t] - q[t], t) for t in kept if n[lang, s][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", some, 50)):
            found = sorted(found, key=lambda f: (-f[0], f[1].encode()))
            out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out, key=repr)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize(("block", "tile", "size"), [(2048, 64, 8 << 20), (7, 2, 50)])
def test_divergence_against_counters(spark, monkeypatch, block, tile, size):
    for name, value in (("BLOCK", block), ("TILE", tile), ("SLICE", size)):
        monkeypatch.setattr(divergence, name, value)
    rng = np.random.default_rng(5)
    words = [*(f"w{chr(97 + k)}x" for k in range(26)), "Ünd", "ünd", "日本", "A", "a", "don't", "x\u0080y", "The", "THE"]
    rows = [(" ".join(rng.choice(words, int(rng.integers(0, 40)), p=rng.dirichlet(np.ones(len(words))))), lang, s) for lang in ("en", "de", None) for s in ("a", "b", "ß", None, "zz") for _ in range(12)]
    rows += [("alone 1234", "fr", "one"), (None, "fr", "two"), ("", "fr", "three"), ("x" * 400 + " y" * 300, "en", "a"), ("\x00\t-", "it", "only")] + rows[:3] * 2
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("n", "df", "term", "tile", "v", "block")}).repartition(4)
    assert rows_of(divergence.divergence(spark, df, 8), *AUDIT) == plain_divergence(rows, 8)


def test_divergence_of_no_documents_and_large_counts(spark):
    assert divergence.divergence(spark, spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    counts = np.array([0, 1, 10**13, 7 * 10**11], np.int64)
    total = 3 * 10**14 + 1
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]


def test_segment_trees_share_nodes_and_price_exactly():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.3, (6, 37)).astype(np.int64)
    forest = divergence.Forest(counts)
    assert len(forest.levels) == 6 and forest.size(1) < 6 * 32  # equal pairs of counts are one node
    totals = counts.sum(axis=1) + 5 * 37
    value = divergence.prices(forest, 0, int(totals[0]), forest, np.arange(1, 6), totals[1:])
    shares = [divergence.shares(c, int(t)) for c, t in zip(counts, totals, strict=True)]
    assert value.tolist() == [int(np.abs(shares[0] - s).sum()) for s in shares[1:]]


def plain_top(rows, k, every):
    fit = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fit = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in fit]
    out = []
    for at, (i, v) in enumerate(fit):
        if i is None or i % every:
            continue
        found = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, j) for other, (j, w) in enumerate(fit) if other != at and len(w) == len(v)]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


TOP = ("query_id", "rank", "vec_id", "score")


@pytest.mark.parametrize(("shard", "leaf"), [(2 << 20, 64), (700, 3)])
def test_top_k_against_all_pairs(spark, monkeypatch, shard, leaf):
    for name, value in (("SHARD_BYTES", shard), ("BLOCK_BYTES", shard), ("LEAF", leaf)):
        monkeypatch.setattr(top_k, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (4, 6))
    rows = [(k, (centres[k % 4] + rng.normal(0, 0.1, 6)).astype(np.float32).tolist()) for k in range(160)]
    rows += [(200 + k, rows[5][1]) for k in range(25)]  # copies of one vector
    rows += [(3, rows[5][1]), (205, rows[5][1]), (5, rows[7][1]), (None, rows[5][1]), (None, [1.0] * 6)]  # repeated ids and rows
    rows += [(300, None), (305, [None, 1.0]), (310, [float("nan")] * 6), (315, [float("inf")] * 6), (320, []), (321, []), (325, [2.0, 3.0]), (330, [0.0] * 6), (335, [1e6] * 6), (340, [-1e6] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("key", "x", "dim", "part", "score", "rank")}).repartition(3)
    assert rows_of(top_k.top_k(spark, df, F.col("vec_id") % 5 == 0, 5), *TOP) == plain_top(rows, 5, 5)


def test_top_k_of_nothing(spark):
    assert top_k.top_k(spark, spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0, 5).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert top_k.top_k(spark, one, F.col("vec_id") % 5 == 0, 5).count() == 0


def test_ball_tree_leaves_out_far_nodes():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 300, (32, 8))
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 5, (6400, 8))).astype(np.int64)
    order, bounds, balls, radii = top_k.ball_tree(x.astype(float))
    assert sorted(order.tolist()) == list(range(len(x))) and all(high - low <= top_k.LEAF for low, high in bounds[len(bounds) // 2 :])
    for (low, high), c, r in zip(bounds, balls, radii, strict=True):
        assert np.sqrt(((x[order[low:high]] - c) ** 2).sum(axis=1)).max() <= r + 1e-9
    q = x[:40]
    found = top_k.Search(q, np.full(40, -(1 << 62)), 5)
    read = found.tree(x[order], bounds, balls, radii, np.zeros(len(x), np.int64), order, np.array(["k"] * len(x), object))
    best = np.sort(q @ x.T, axis=1)[:, -5:]
    assert read < 40 * (len(bounds) // 2 + 1) / 4
    assert sorted(found.score.tolist()) == sorted(best.ravel().tolist())



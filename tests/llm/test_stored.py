"""Stored media columns, and the recall and pairing of near copies in the pipeline."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from flightframe.llm import line_dedup, shared, simhash, telephony
from tests.llm.test_exact import frame, text_of


def test_op10_goes_through_stored_columns(spark, monkeypatch):
    stored, write = [], telephony.written
    monkeypatch.setattr(telephony, "written", lambda spark, df, name, *more, **how: (stored.append((name, df)), write(spark, df, name, *more, **how))[1])
    docs = frame(spark, ["", None, "some text", "é" * 5000, "some text", "x" * 3_000_000] + [f"text {k}" * k for k in range(60)], extra=True)
    got = telephony.stored_digests(spark, docs.select("doc_id", "text"))
    assert sorted(map(str, got.collect())) == sorted(map(str, telephony.text_digests(docs).collect()))
    assert [name for name, _ in stored] == ["media", "pcm", "digests"] * telephony.ROUNDS
    for before, (name, df) in zip(stored, stored[1:], strict=False):
        if name in ("pcm", "digests"):  # reads the table that was written before
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert f"/{before[0]}-" in plan and "FileScan parquet" in plan
    assert telephony.stored_digests(spark, docs.select("doc_id", "text").limit(0)).count() == 0


@pytest.mark.parametrize(("size", "least"), [(5, 0.97), (10, 0.97), (30, 0.99), (100, 0.99), (300, 0.99)])
def test_fingerprints_find_sets_at_the_limit(size, least):
    rng = np.random.default_rng(size)
    found, pairs = 0, 400
    for _ in range(pairs):
        # 4 of 5 values in common: a similarity of 0.8 or just above
        common = rng.integers(0, 1 << 63, max(1, -(-8 * size // 9)), dtype=np.int64).view(np.uint64)
        rest = rng.integers(0, 1 << 63, 2 * (size - len(common)), dtype=np.int64).view(np.uint64)
        sets = [np.sort(np.concatenate((common, rest[k::2]))) * np.uint64(0x9E3779B97F4A7C15) for k in range(2)]
        assert 9 * len(common) >= 4 * 2 * size
        a, b = (np.array([simhash.wide_fingerprint(np.sort(s))], np.int64).view(np.uint64) for s in sets)
        found += len(simhash.near_in_tiles(a, b)[0])
    assert found >= least * pairs


@pytest.mark.parametrize("tile_rows", [8192, 40, 25, 7])
def test_near_copies_compare_every_pair_of_tiles(spark, tile_rows):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    texts += [t + " more" for t in texts]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark, frame(spark, texts), tile_rows=tile_rows).collect()}
    assert got == {k: k % 60 for k in range(120)}


def test_near_copies_store_no_gram_sets(spark, monkeypatch):
    columns = []
    write = simhash.written
    monkeypatch.setattr(simhash, "written", lambda spark, df, name, *more: (columns.append((name, df.columns, df.count())), write(spark, df, name, *more))[1])
    rng = np.random.default_rng(31)
    texts = [text_of(rng, 60) for _ in range(40)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark, frame(spark, [*texts, texts[0] + " end", texts[7]])).collect()}
    assert got == {k: k for k in range(40)} | {40: 0, 41: 7}
    assert [(name, n) for name, names, n in columns if "grams" in names] == [("sets", 2)]


def test_written_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(shared.CLEANUP, None)
    df = shared.written(spark, spark.range(1000).repartition(4, "id"), "dealt")
    assert shuffled() <= before and spark.conf.get(shared.CLEANUP, None) == setting
    assert df.count() == 1000


def test_copies_of_one_text_make_pairs_of_different_components_only(spark):
    # a band of 300 lines of one component and three of their own: each pair of different components once, however lists are cut
    rows = [(1, k, 0, 100) for k in range(300)] + [(1, 1000 + k, 1000 + k, (100, 110, 300)[k]) for k in range(3)]
    rooted = spark.createDataFrame(rows, "key long, id long, root long, size int")
    mixed = line_dedup.with_mixed_roots(rooted)
    assert [(r.n, r.least, r.apart) for r in mixed.collect()] == [(303, 0, 903.0)]
    every = line_dedup.apart_pairs(spark, rooted.drop("size"), mixed)
    assert every.count() == 903
    plan = line_dedup.apart_pairs(spark, rooted, mixed)
    # the third is too long to be near any other
    assert {(r.a, r.b) for r in plan.collect()} == {(k, 1000 + j) for k in range(300) for j in range(2)} | {(1000, 1001)}


def test_near_copies_compare_few_of_many_texts(spark, monkeypatch):
    # of 600 texts, none near another but the last 20, only pairs that share a band are compared
    compared, write = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda spark, df, name, *more: (compared.append(df.count()) if name in ("pairs", "tiles") else None, write(spark, df, name, *more))[1])
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(580)]
    texts += [t + " more" for t in texts[:20]]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark, frame(spark, texts), tile_rows=16).collect()}
    assert got == {k: k % 580 for k in range(600)}
    assert compared == [20, 0, 0]  # pairs with the hubs; tiles and pairs of mixed bands; all tiles of 16 made 741 pairs of tiles before


def test_near_copies_between_the_hubs_of_a_band(spark, monkeypatch):
    # one band for all texts: what neither the first nor the last of it is near must be compared as well, however tiles are cut
    monkeypatch.setattr(simhash, "band_keys", lambda grams: np.ones(1, np.int64))
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(400)], 60)) for _ in range(30)]
    texts += [t + " more" for t in texts]
    for tile_rows in (7, 8192):
        got = {r.doc_id: r.component_id for r in simhash.near_copies(spark, frame(spark, texts), tile_rows=tile_rows).collect()}
        assert got == {k: k % 30 for k in range(60)}


@pytest.mark.parametrize("size", [5, 10, 30, 100, 300])
def test_bands_of_sets_at_the_limit(size):
    rng = np.random.default_rng(size)
    lost = 0
    for _ in range(2000):
        common, more = rng.integers(0, 1 << 63, -(-8 * size // 9), dtype=np.int64).view(np.uint64), 2 * (size - -(-8 * size // 9))
        rest = rng.integers(0, 1 << 63, more, dtype=np.int64).view(np.uint64)
        a, b = (np.sort(np.concatenate((common, rest[k::2])) * np.uint64(0x9E3779B97F4A7C15)) for k in range(2))
        lost += not len(np.intersect1d(simhash.band_keys(a), simhash.band_keys(b)))
    assert lost <= 2
    assert len(simhash.band_keys(np.zeros(0, np.uint64))) == 0


def test_sketches_leave_out_pairs_that_are_not_near_and_no_others(spark, monkeypatch):
    # long lines of one beginning: in one band, but few pairs of them are compared by their texts
    compared, check = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda spark, pairs, texts: (compared.append(pairs.count()), check(spark, pairs, texts))[1])
    monkeypatch.setattr(line_dedup, "band_keys", lambda df: df.select("id", F.lit(1).cast("long").alias("key")))
    rng = np.random.default_rng(17)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    lines = ["the same words at the beginning of each line " + "".join(rng.choice(letters, 200)) for _ in range(120)]
    lines += [line[:60] + "!!" + line[62:] for line in lines[:30]] + [line[:50] + "".join(rng.choice(letters, 12)) + line[62:] for line in lines[30:60]]
    links = line_dedup.similar_lines(spark, spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    assert {(r.a, r.b) for r in links.collect()} == {(k, 120 + k) for k in range(60)}
    assert sum(compared) <= 80  # of some 16,000


def test_shingles_are_characters_of_any_width(spark):
    # equal shingles have equal hashes, whether or not a character of four bytes is elsewhere in the line
    lines = ["plain text of some length", "plain text of some length \U0001f600 and more", "naïve 漢字 text of some length", "\U0001f600" * 9, "x" * 5000, "ab" * 4000]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {r.id: set(r.s) for r in rows.select("id", line_dedup.shingles(F.col("line")).alias("s")).collect()}
    sets = [{s[k : k + 8] for k in range(len(s) - 7)} for s in lines]
    assert all(len(got[a] & got[b]) == len(sets[a] & sets[b]) for a in range(len(lines)) for b in range(a + 1))
    keys = {k: {r.key for r in line_dedup.band_keys(rows).where(F.col("id") == k).collect()} for k in range(len(lines))}
    more = spark.createDataFrame([(0, "x" * 90), (1, "ab" * 70), (2, "\U0001f600" * 11)], "id long, line string")
    again = {k: {r.key for r in line_dedup.band_keys(more).where(F.col("id") == k).collect()} for k in range(3)}
    assert again[0] == keys[4] and again[1] == keys[5] and again[2] == keys[3]  # equal sets, however often they repeat

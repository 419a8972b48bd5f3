"""Operators with exact answers, held against plain Python."""

import hashlib
import re
import struct
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightframe.llm import bpe, components, decontaminate, line_dedup, registry, simhash, substring, telephony, url_filter, warc
from flightframe.llm.components import connected_components
from flightframe.llm.words import gram_hashes, word_bounds, word_hashes
from tests.compare import SF_DIR, assert_same, connection

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups phi chi psi ome".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS, n))


def frame(spark, texts, extra=False):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"score": F.lit("x"), "ids": F.lit(1), "media": F.lit(2), "component": F.lit(3), "lang": F.lit(None).cast("string"), "key": F.lit(4)}) if extra else df


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF_DIR), connection(), registry.ORACLES[name])


def test_components_of_chains_stars_and_loops(spark, monkeypatch):
    rng = np.random.default_rng(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 300, (60, 2))] + [(-5, -9), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x in got} and len(got) == len({x for link in links if link[0] != link[1] for x in link})
    monkeypatch.setattr(components, "LEAST_PART", 50)
    hub = [(-7 * k, 7000) for k in range(1, 700)] + [(7000, 7000 + k) for k in range(1, 700)]
    assert {r.root for r in connected_components(spark, spark.createDataFrame(hub, "a long, b long")).collect()} == {-7 * 699}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = [text_of(rng, 60) for _ in range(30)]
    texts = base + [b + " end" for b in base[:10]] + base[:3] + ["", None, " \t\n", "One", "ONE", "one two", "Ä b c d", "ä b c d"]
    got = {r.doc_id: r for r in simhash.simhash_components(spark, frame(spark, texts, extra=True).drop("component")).collect()}
    prints = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        import xxhash

        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    component = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    component[a] = min(component[a], component[b])
    assert [int(got[k].fingerprint, 16) for k in range(len(texts))] == prints
    assert [got[k].component_id for k in range(len(texts))] == component
    assert simhash.simhash_components(spark, frame(spark, texts).limit(0)).count() == 0


def test_pipeline_drops_copies_with_edited_words(spark):
    import corpus_pipeline

    rng = np.random.default_rng(10)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 300)) for _ in range(40)]
    texts = list(base)
    for n, b in enumerate(base):
        words = b.split()
        for k in rng.choice(300, n % 10, replace=False):
            words[k] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, "few words", "Few  words"]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    component = list(range(len(texts)))
    for _ in range(3):
        for a in range(len(texts)):
            for b in range(a):
                if 9 * len(grams[a] & grams[b]) >= 4 * (len(grams[a]) + len(grams[b])):
                    component[a] = component[b] = min(component[a], component[b])
    assert 50 < len(set(component)) < 70
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(None, base[0])], "doc_id long, text string"))
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect()]
    assert got.count(None) == 1 and sorted(k for k in got if k is not None) == sorted(set(component))
    split = {r.doc_id: r.component_id for r in simhash.near_copies(spark, docs, tile_rows=16).collect()}
    assert [split[k] for k in range(len(texts))] == component
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF_DIR).count() == 0


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    near = [int(p) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for p in prints[:150]]
    values = sorted({*map(int, prints), *near})
    links = simhash.fingerprint_links(spark, spark.createDataFrame([(v,) for v in values], "bits long"), 3, tile_rows=8)
    got = {frozenset((r.a, r.b)) for r in links.collect()}
    mask = (1 << 64) - 1
    assert got == {frozenset((a, b)) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_dense_tiles_keep_the_components():
    a = np.arange(64, dtype=np.uint64)
    i, j = simhash.compare_tiles(a, a, 3, block=16)
    assert len(i) < 64 * 64 and set(i.tolist()) | set(j.tolist()) == set(range(64))


def brute_repeats(texts, window):
    tokens = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[p : p + window]) for w in tokens for p in range(len(w) - window + 1))
    out = []
    for w in tokens:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [35, 9])
def test_substring_against_brute_force(spark, window):
    rng = np.random.default_rng(4)
    passage = text_of(rng, window + 7)
    texts = [f"{text_of(rng, rng.integers(0, 40))} {passage if k % 3 else ''} {text_of(rng, 20)}" for k in range(40)]
    texts += [passage, passage, " ".join(passage.split()[:window]), " ".join(passage.split()[: window - 1]), "", None, "x " * 200, "a\u00a0b\x1cc " * 50, f"{passage} {passage}"]
    df = frame(spark, texts, extra=True)
    cut = {(r.doc_id, r.thash): r for r in substring.without_repeats(spark, df, window).collect()}
    for r in substring.keyed(df).collect():
        n, removed, kept = brute_repeats(texts, window)[r.doc_id]
        mine = cut.get((r.doc_id, r.thash))
        assert (mine.n_removed if mine else 0) == removed
        if mine:
            assert bytes(mine.kept) == kept and sum(b - a for a, b in zip(mine.spans[::2], mine.spans[1::2])) == removed
    assert substring.without_repeats(spark, df.limit(0), window).count() == 0


def test_substring_query_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "z " + text), (2, "only this")], "doc_id long, text string")
    got = substring.without_repeats(spark, df).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 40), (1, 40)]
    rows = registry.QUERIES["op8_substring"](spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    expected = {d.doc_id: x for d, x in zip(docs, brute_repeats([d.text for d in docs], 35), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == {k: (n, m, hashlib.sha256(t).hexdigest()) for k, (n, m, t) in expected.items()}


def test_word_and_gram_hashes_keep_to_their_texts():
    raw = [b"", b"a b", b"a", b" b a\x0bb ", b"ab"]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, bounds = word_hashes(data, offsets)
    words = [w for r in raw for w in r.split()]
    assert bounds.tolist() == [0, 0, 2, 3, 6, 7] and len(h) == 7
    assert len({(int(a), b) for a, b in zip(h, words)}) == len(set(words)) == len(set(h.tolist()))
    grams, whole = gram_hashes(h, bounds, 2)
    assert whole.tolist() == [True, False, False, True, True, False] and grams[0] != grams[3] and grams[0] == grams[4]


def brute_overlaps(texts, items):
    fold = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            x, y = fold(t), fold(item)
            if not y:
                continue
            size, need = decontaminate.needed(len(y))
            if any(sum(x[a + k] == y[b + k] for k in range(size)) >= need for a in range(len(x) - size + 1) for b in range(len(y) - size + 1)):
                out.add((d, i))
    return out


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(5)
    long = [f"t{k}" for k in range(3000)]
    items = [" ".join(rng.choice(long, n)) for n in (8, 9, 10, 11, 12, 13, 20, 60, 7)] + [None, ""]
    texts = []
    for item in items[:9]:
        for changed in range(5):
            words = item.split()
            for k in rng.choice(len(words), min(changed * max(1, len(words) // 13), len(words)), replace=False):
                words[k] = "changed"
            texts.append(" ".join(rng.choice(long, 15)) + " " + ", ".join(words).upper() + ". " + " ".join(rng.choice(long, 15)))
    texts += ["", None, " ".join(rng.choice(long, 300))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(spark, frame(spark, texts, extra=True).drop("key"), bench).collect()}
    assert got == brute_overlaps(texts, items) and len(got) > 15
    assert decontaminate.overlaps(spark, frame(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.overlaps(spark, frame(spark, texts).limit(0), bench).count() == 0


def test_masks_find_every_tolerated_pattern():
    from itertools import combinations

    for n in range(decontaminate.LEAST, decontaminate.WINDOW + 1):
        size, need = decontaminate.needed(n)
        for wrong in combinations(range(n), n - need):
            assert any(all(m[k] == "0" or k + shift not in wrong for k in range(len(m))) for m in decontaminate.MASKS for shift in range(size - len(m) + 1)), (n, wrong)


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(6)
    lines = [text_of(rng, int(rng.integers(2, 30))) for _ in range(60)]
    near = [line.replace("a", "A", 1) + "!" for line in lines[:25]] + [line[:-1] for line in lines[25:40]]
    texts = ["\n".join(rng.permutation(lines + near)[: int(rng.integers(1, 30))]) for _ in range(25)] + ["", None, "\n \n", "ab", "ab\nab", "x" * 40_000, "x" * 39_999]
    got = {(r.doc_id, r.pos): r.kept for r in line_dedup.line_classes(spark, frame(spark, texts)).collect()}
    places = [(d, p, line) for d, t in enumerate(texts) for p, line in enumerate((t or "").split("\n")) if line.strip()]
    distinct = sorted({line for _, _, line in places})
    sets = [{s[k : k + 8] for k in range(max(1, len(s) - 7))} for s in distinct]
    root = list(range(len(distinct)))
    for _ in range(6):
        for a in range(len(distinct)):
            for b in range(len(distinct)):
                if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                    root[a] = root[b] = min(root[a], root[b])
    first = {}
    for d, p, line in places:
        first.setdefault(root[distinct.index(line)], (d, p))
    assert set(got) == {(d, p) for d, p, _ in places}
    wrong = [(d, p) for d, p, line in places if got[d, p] != (first[root[distinct.index(line)]] == (d, p))]
    assert len(wrong) <= len(places) // 100  # banding finds over 0.99 of the pairs
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark, frame(spark, texts).withColumn("n_chars", F.lit(0).cast("long"))).collect()}
    kept = ["\n".join(line for p, line in enumerate(t.split("\n")) if got.get((d, p), True)) if t is not None else None for d, t in enumerate(texts)]
    assert [out[d].text for d in range(len(texts))] == kept and all(r.n_chars == len(r.text) for r in out.values() if r.text is not None)
    assert line_dedup.dedup_lines(spark, frame(spark, texts, extra=True).limit(0)).count() == 0


def test_line_dedup_links_groups_of_one_band(spark, monkeypatch):
    # one band for all lines: families of two near lines, none near another family's; first few, then with more hubs
    rng = np.random.default_rng(9)
    lines = [f"{text_of(rng, 12)} {k}" for k in range(30)]
    lines += [line + "!" for line in lines]
    ids = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "id long, line string")
    monkeypatch.setattr(line_dedup, "band_keys", lambda df: df.select("id", F.lit(1).cast("long").alias("key")))
    for part, small in ((256, 256), (16, 256), (16, 16)):  # the last by rare shingles
        monkeypatch.setattr(line_dedup, "PART", part)
        monkeypatch.setattr(line_dedup, "SMALL", small)
        got = {frozenset((r.a, r.b)) for r in line_dedup.similar_lines(spark, ids).collect()}
        assert got == {frozenset((k, k + 30)) for k in range(30)}


def test_lines_of_one_template_make_few_pairs(spark):
    # one band for 2,000 lines that share a long template and are not near one another, and ten near pairs among them
    rng = np.random.default_rng(21)
    template = "Licensed under the terms of the notice that comes with this work; see there for "
    lines = [template + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 60)) for _ in range(2000)]
    lines += [line + "." for line in lines[:10]]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    rooted = texts.select(F.lit(1).cast("long").alias("key"), "id", F.col("id").alias("root"))
    fine = line_dedup.by_rare_shingles(spark, rooted, line_dedup.with_mixed_roots(rooted), texts)
    pairs = {(r.a, r.b) for r in line_dedup.apart_pairs(spark, fine, line_dedup.with_mixed_roots(fine)).distinct().collect()}
    assert {(k, k + 2000) for k in range(10)} <= pairs and len(pairs) < 20_000


def test_bands_find_pairs_near_the_limit(spark):
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz    ")
    lines = []
    while len(lines) < 4000:
        line = "".join(rng.choice(letters, rng.integers(75, 121)))
        other = line[int(rng.integers(4, 10)) : len(line) - int(rng.integers(2, 6))]
        x, y = ({s[k : k + 8] for k in range(len(s) - 7)} for s in (line, other))
        if 0.8 <= len(x & y) / len(x | y) < 0.84:
            lines += [line, other]
    rows = line_dedup.band_keys(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect()
    keys = [set() for _ in lines]
    for r in rows:
        keys[r.id].add(r.key)
    lost = sum(not keys[k] & keys[k + 1] for k in range(0, len(lines), 2))
    assert lost <= 6  # of 2,000


def test_pairs_at_the_limit_are_found_among_lines_of_one_template(spark):
    # lines that share a long beginning meet in large bands with many lines that are not near them
    rng = np.random.default_rng(14)
    letters = list("abcdefghijklmnopqrstuvwxyz    ")
    template = "Licensed under the terms of the notice that comes with this work; see there for "
    lines = []
    for words in ([""] * 300, [template] * 300):
        for start in words:
            while True:
                line = start + "".join(rng.choice(letters, rng.integers(75, 160)))
                size = max(1, round((len(line) - 7) * rng.uniform(0.085, 0.11)) - 7)
                at = int(rng.integers(len(start), len(line) - size))
                other = line[:at] + "".join(rng.choice(letters, size)) + line[at + size :]
                x, y = ({s[k : k + 8] for k in range(len(s) - 7)} for s in (line, other))
                if 0.8 <= len(x & y) / len(x | y) <= 0.85:
                    lines += [line, other]
                    break
    lines += [template + "".join(rng.choice(letters, 40)) for _ in range(600)]
    links = line_dedup.similar_lines(spark, spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    root = {r.node: r.root for r in connected_components(spark, links).collect()}
    found = [k in root and root[k] == root.get(k + 1) for k in range(0, 1200, 2)]
    assert sum(found[:300]) >= 0.95 * 300 and sum(found[300:]) >= 0.95 * 300
    assert all(9 * len(x & y) >= 4 * (len(x) + len(y)) for r in links.collect() for x, y in [[{s[k : k + 8] for k in range(len(s) - 7)} for s in (lines[r.a], lines[r.b])]])


def test_places_of_repeated_doc_ids(spark):
    shared, one = "a line that both documents share", "this line is in one document only"
    rows = [(0, shared), (1, one), (1, shared), (2, f"{one}\n{one}"), (3, shared), (3, shared), (None, "x"), (None, "x\ny"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("clash"))
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark, docs).where("doc_id is not null").collect())
    assert got == [(0, shared), (1, ""), (1, one), (2, ""), (3, ""), (3, "")]
    rest = sorted(str(r.text) for r in line_dedup.dedup_lines(spark, docs).where("doc_id is null").collect())
    assert rest in (["None", "x", "y"], ["", "None", "x\ny"])


def test_line_dedup_uses_no_python(spark, monkeypatch):
    plans, write = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda spark, df, *more: (plans.append(df), write(spark, df, *more))[1])
    docs = frame(spark, ["some line of text", "some line of texts\nanother line here", "some line of text.\nx"])
    plans.append(line_dedup.line_classes(spark, docs))
    assert len(plans) > 8
    for df in plans:
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: k for k, t in enumerate(bpe.read_ranks(path))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(7)
    alphabet = list("ab  \n\t'sdtll1é語😀\u3000\x1c\x0b\x85.,!  ")
    texts = ["", None, " ", "it's  <|endoftext|> ok", "日本語 x", "z" * 5000, " lead", "trail ", "a \n b"] + ["".join(rng.choice(alphabet, rng.integers(1, 50))) for _ in range(400)]
    rows = bpe.round_trip(frame(spark, texts, extra=True), path, public_tokenizers.PATTERN).collect()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_bpe_model_has_every_token():
    import public_tokenizers

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec = bpe.Codec(bpe.serialise_model(tokens), public_tokenizers.PATTERN)
    assert codec.tokens == tokens


def test_adpcm_equals_one_sample_at_a_time():
    blocks = np.random.default_rng(8).integers(0, 256, (50, 64)).astype(np.uint8)
    for block, got in zip(blocks, telephony.decode_adpcm(blocks), strict=True):
        sample, index = int(block[:2].view("<i2")[0]), min(int(block[2]), 88)
        expected = [sample]
        for code in block[4:].tolist():
            for nibble in (code & 15, code >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                sample = max(-32768, min(32767, sample - change if nibble & 8 else sample + change))
                index = max(0, min(88, index + int(telephony.CHANGES[nibble])))
                expected.append(sample)
        assert got.tolist() == expected


def test_companding_tables():
    assert telephony.MU[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.A[[0x2A, 0xAA, 0x55, 0xD5]].tolist() == [-32256, 32256, -8, 8]
    assert len(set(telephony.A.tolist())) == 256


def brute_feature(payload):
    """Features of a payload under each code, sample by sample."""

    def said(name, pcm):
        size = [abs(x) for x in pcm]
        return f"{name}:n={len(pcm)},peak={max(size, default=0)},mean={sum(size) // len(pcm) if pcm else 0},crossings={sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))}"

    mu, a = ([int(t[x]) for x in payload] for t in (telephony.MU, telephony.A))
    adpcm = []
    for at in range(0, len(payload) // 64 * 64, 64):
        adpcm += telephony.decode_adpcm(np.frombuffer(payload[at : at + 64], np.uint8)[None, :])[0].tolist()
    wide = b"".join(struct.pack("<hh", x, x + (y - x) // 2) for x, y in zip(mu, [*mu[1:], *mu[-1:]]))
    return ";".join((said("mu", mu), said("a", a), said("adpcm", adpcm), f"pcm:n={len(wide) // 2},rate=16000,crc={zlib.crc32(wide):08x}")), wide


def test_telephony_round_trip(spark):
    texts = ["", None, "a", "b" * 64, "ü" * 100, "a", "long " * 20000]
    for tag in (telephony.MU_LAW, telephony.A_LAW, telephony.IMA_ADPCM):
        media = telephony.text_media(frame(spark, texts, extra=True), tag).withColumn("payload", F.lit(1))
        rows = telephony.media_features(telephony.stored_pcm(media)).orderBy("doc_id").collect()
        for r, t in zip(rows, texts, strict=True):
            raw = (t or "").encode()
            assert bytes(r.payload) == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)) and r.n_bytes == len(raw)
        assert rows[2].feature == rows[5].feature
        pcm = telephony.from_wav(bytes(rows[3].pcm_media))
        assert (pcm.tag, pcm.rate, len(pcm.payload)) == (telephony.PCM, 16000, 2 * 2 * (121 if tag == telephony.IMA_ADPCM else 64))
    frames = lambda x: np.array(x, np.int16)[:, None]
    assert telephony.resample(frames([0, 10, -5]), 8000, 16000).view("<i2").ravel().tolist() == [0, 5, 10, 2, -5, -5]
    assert telephony.resample(frames([0, 30, 60, 90]), 4, 3).ravel().tolist() == [0, 40, 80] and telephony.resample(frames([]), 8, 11).size == 0
    slow = telephony.resample(frames(range(0, 3000, 7)), 8000, 11025).ravel()
    assert slow.tolist() == [int(7 * (k * 8000 // 11025) + (7 if k * 8000 // 11025 < 428 else 0) * (k * 8000 % 11025) // 11025) for k in range(429 * 11025 // 8000)]


def test_odd_media(spark):
    wav = telephony.to_wav
    two = np.array([[1, -1], [3, -3]], "<i2")
    media = [None, b"", b"RIFF", b"no wave", wav(b"abc", telephony.MU_LAW), wav(b"x" * 100, telephony.IMA_ADPCM), wav(b"abc", telephony.PCM), wav(b"", telephony.A_LAW), wav(two.tobytes(), telephony.PCM, 16000, 2), wav(b"abcd", 0x55), wav(b"a" * 64, telephony.MU_LAW)[:40], wav(b"a" * 64, telephony.MU_LAW)[:50]]
    df = spark.createDataFrame([(k, bytearray(m) if m is not None else None) for k, m in enumerate(media)], "doc_id long, media binary")
    rows = telephony.media_features(telephony.stored_pcm(df)).orderBy("doc_id").collect()
    assert [k for k, r in enumerate(rows) if r.pcm_media is None] == [0, 1, 2, 3, 9, 10] == [k for k, r in enumerate(rows) if r.feature is None]
    n = lambda k: len(telephony.from_wav(bytes(rows[k].pcm_media)).payload)
    assert [n(k) for k in (4, 5, 6, 7, 11)] == [12, 121 * 4, 4, 0, 16]
    both = telephony.from_wav(bytes(rows[8].pcm_media))
    assert both.channels == 2 and np.frombuffer(both.payload, "<i2").reshape(-1, 2).tolist() == two.tolist()
    assert telephony.stored_pcm(df.limit(0)).count() == 0 and telephony.text_digests(frame(spark, ["a"]).limit(0)).count() == 0


def test_telephony_query(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op10_telephony"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        raw = d.text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[d.doc_id]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        head = b"WAVEfmt " + struct.pack("<IHHIIHHH", 18, 7, 1, 8000, 8000, 1, 8, 0) + b"data" + struct.pack("<I", len(payload))
        media = b"RIFF" + struct.pack("<I", len(head) + len(payload)) + head + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha(media))
        if len(raw) < 2000:
            feature, wide = brute_feature(payload)
            assert r.feature == feature and r.pcm_sha256 == sha(telephony.to_wav(wide, telephony.PCM, 16000))


def test_url_filter_has_no_false_verdicts(spark):
    urls = ["http://A.Example.org/es/x?q", "https://example.org/en/12#t", "example.org/en/1", None, "http://xexample.org/es/", "ftp://org", "http://b.com/de/", "http://com/fr/", "http://www.cheap-pills.example.com/en/", "http://n.net/", "x://", "http://a/b://c", "https://WWW.cheap-pills.example.com/en/?a", "http://www.cheap-pills.example.com/en", "http://cheap-pillsx.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "key": F.lit(2)})
    parts = url_filter.canonical_parts(pages)
    rules = spark.createDataFrame([*url_filter.RULES, (None, "block")], "key string, verdict string")
    listed = url_filter.site_urls(parts.where("page_id < 13"), url_filter.SITES)
    assert [r.key for r in listed.collect()] == ["www.cheap-pills.example.com/en/"]
    nothing = spark.createDataFrame([(None,)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(parts, rules, listed.unionByName(nothing)).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == got[3] == ("", "", None, "allow") and got[4][2:] == ("org/", "allow") and got[5] == ("org", "", None, "allow")
    assert got[6][2:] == ("com/de/", "block") and got[7][2:] == ("com/fr/", "allow") and got[8][2:] == got[12][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[10] == ("", "", None, "allow") and got[11][:2] == ("a", "/b://c") and got[13][2:] == got[14][2:] == (None, "allow")
    listed = spark.range(2000).select(F.concat(F.lit("site"), "id", F.lit(".net/")).alias("key"))
    probes = spark.range(1000, 9000).select(F.concat(F.lit("site"), "id", F.lit(".net/")).alias("key"))
    passed = url_filter.possible_hits(probes, listed, 2000)
    assert passed.join(listed, "key").count() == 1000 and passed.count() < 2500
    assert url_filter.judge(parts.limit(0), rules, nothing).count() == 0


def test_warc_records_are_linked_and_sized(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "<html><head><title>t</title></head><body><p>Caf&eacute; &lt;b&gt; &amp;lt;</p><script>x</p></script><br>two   words</body>"), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    records = warc.serialised(warc.derivatives(warc.page_responses(pages)))
    got = {(r.refers_to, r.warc_type): r for r in records.collect()}
    ids = [r.record_id for r in warc.page_responses(pages).collect()]
    assert len(got) == 6 and {k[0] for k in got} == set(ids) and len({r.record_id for r in got.values()}) == 6
    text, about = got[ids[0], "conversion"], got[ids[0], "metadata"]
    assert text.block == "Café <b> &lt;\ntwo words" and "WARC-Target-URI: http://a/  X: y\r\n" in text.header
    assert "source-header-Content-Type: text/html; charset=utf-8\r\n" in about.block and f"source-payload-digest: {text.source_digest}\r\n" in about.block
    import base64

    for r in got.values():
        other = got[r.refers_to, "metadata" if r.warc_type == "conversion" else "conversion"]
        assert f"WARC-Concurrent-To: {other.record_id}\r\n" in r.header and f"WARC-Payload-Digest: {r.block_digest}\r\n" in r.header
    assert text.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(text.block.encode()).digest()).decode()
    assert "Target-URI" not in got[ids[1], "conversion"].header and got[ids[1], "conversion"].content_length == 0
    warc.write_warc(warc.derivatives(warc.page_responses(pages)).coalesce(1), str(tmp_path / "w"))
    raw = next((tmp_path / "w").glob("part-*")).read_bytes()
    at = n = 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at) + 4
        size = int(re.search(rb"Content-Length: (\d+)", raw[at:head])[1])
        assert raw[head + size : head + size + 4] == b"\r\n\r\n" and raw[at:].startswith(b"WARC/1.1\r\n")
        at, n = head + size + 4, n + 1
    assert n == 6
    assert warc.derivatives(warc.page_responses(pages.limit(0))).count() == 0


class Reader(HTMLParser):
    """The library's parser, as far as it keeps to the same rules."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in warc.HIDDEN | warc.RAW:
            self.hidden.append(tag)
        elif not self.hidden and tag in warc.LINE_ELEMENTS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[0] == tag:
            self.hidden = []
        elif not self.hidden and tag in warc.LINE_ELEMENTS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(re.sub(r"[ \t\r\n\f]+", " ", data))


def read_by_library(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = [re.sub(" +", " ", line).strip(" ") for line in "".join(reader.parts).split("\n")]
    return "\n".join(line for line in lines if line)


def test_page_text_equals_the_library_parser():
    rng = np.random.default_rng(12)
    pieces = ["word ", "two  words\n", "caf&eacute; ", "&#8217;", "&#x41;", "&amp;lt; ", "&notit; ", "&nbsp;", "a < b ", "<p>", "</p>", "<P class=x>", '<p title="a>b">', "<p title='a>\"b'>", "<br/>", "<b>bold</b>", "<i >", "</i >", "<!-- c > <p> -->", "<!DOCTYPE html>", "<?x y?>", "<script>var t = '<p>';</script>", "<style>p{}</style >", "<noscript>no</noscript>", "<template><p>t</p></template>", "<a href=x>", "</a>", "<td>", "<h1\n>"]
    for _ in range(400):
        page = "".join(rng.choice(pieces, rng.integers(1, 30)))
        assert warc.page_text(page) == read_by_library(page), page
    assert warc.page_text('<p title="a>b">x</p><p>it&#8217;s caf&eacute; &#x41;</p>') == "x\nit\u2019s caf\u00e9 A"
    assert warc.page_text("<head>shown<p>all") == "shown\nall" and warc.page_text("a<!-- b") == "a" == warc.page_text("a<script>b") == warc.page_text("a<b c='")


def test_page_text_is_linear_in_the_page(spark):
    began = time.time()
    for unit in ("<script ", "<script>", "<head>", "<!-- ", "<a b='", '<a b="\'', "</", "<a b=", "&#x", "<", " \n "):
        warc.page_text(unit * (5_000_000 // len(unit)))
    assert time.time() - began < 55  # 5 MB each
    page = spark.createDataFrame([("r", "<noscript>x" * 100_000)], "record_id string, payload string")
    got = warc.derivatives(page.selectExpr("*", "cast(null as string) as target_uri", "'d' as date", "cast(null as string) as http_header"))
    assert got.where("warc_type = 'conversion'").first().content_length == 100_000


#: Two words of 1,024 bytes that a polynomial modulo a power of two can't tell apart.
TWINS = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(1024)) for flip in (0, 1)]


def test_words_that_collide_as_polynomials(spark):
    rest = [f"w{k}" for k in range(34)]
    texts = [" ".join([*rest, twin]) for twin in TWINS]
    assert substring.without_repeats(spark, frame(spark, texts)).count() == 0
    items = spark.createDataFrame([(1, " ".join([TWINS[0]] * 9)), (2, " ".join([*rest[:6], *[TWINS[0]] * 4]))], "item_id long, text string")
    docs = frame(spark, [" ".join([TWINS[1]] * 9), " ".join([*rest[:6], *[TWINS[1]] * 4]), " ".join([TWINS[0]] * 12)])
    assert [(r.doc_id, r.item_id) for r in decontaminate.overlaps(spark, docs, items).collect()] == [(2, 1)]


def test_windows_that_collide_are_told_apart(spark, monkeypatch):
    # every word has one hash: all windows are candidates, and only their words decide
    monkeypatch.setattr(substring, "word_hashes", lambda data, offsets: (lambda b: (np.full(len(b[0]), 7, np.uint64), b[2]))(word_bounds(data, offsets)))
    rng = np.random.default_rng(13)
    texts = [text_of(rng, 60) for _ in range(6)]
    texts += [texts[0] + " tail", texts[1].replace(" ", "\n\t ")]
    starts, words = substring.anchor_rows, frame(spark, texts)
    rows = starts(substring.keyed(words), 64, 35)
    assert rows.where("kind = 0").count()
    data = "  ".join(texts[0].split()).encode()
    for raw in (texts[0].encode(), data):
        starts, ends, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        got = substring.window_digests(np.frombuffer(raw, np.uint8), starts, ends, np.arange(26), 35)
        assert [x.tobytes() for x in got] == [hashlib.blake2b(" ".join(texts[0].split()[k : k + 35]).encode(), digest_size=16).digest() for k in range(26)]


def test_short_items_match_whole(spark):
    items = spark.createDataFrame([(1, "Three short words"), (2, "seven words are less than eight words"), (3, "?!"), (4, "unique")], "item_id long, text string")
    docs = frame(spark, ["a b three, SHORT words c", "three short other words", "so seven words are less than eight words", "seven words are less than nine words", "x unique", "", None])
    got = {(r.doc_id, r.item_id, r.equal) for r in decontaminate.overlaps(spark, docs, items).collect()}
    assert got == {(0, 1, 3), (2, 2, 7), (4, 4, 1)}


def test_clashing_columns_and_empty_tables_of_queries(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine", 5, "x")], "doc_id long, text string, item_id long, n_items string")
    items = spark.createDataFrame([(9, "One two, three four five six seven eight nine", 1)], "item_id long, text string, doc_id long")
    assert [(r.doc_id, r.item_id, r.equal) for r in decontaminate.overlaps(spark, docs, items).collect()] == [(1, 9, 9)]
    pages = spark.createDataFrame([(1, "http://a/", "<p>x", "h", "t", "p")], "page_id long, url string, html string, http_header string, text string, payload string")
    assert sorted(r.block for r in warc.derivatives(warc.page_responses(pages)).collect())[1] == "x"
    for name in ("documents", "pages", "labels", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in registry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name

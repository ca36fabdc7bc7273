"""BPE, packing, SimHash, NN-descent and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import bpe, common, nn_descent, packing, simhash
from keystrata.session import table

P = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
ODD = ["", None, " ", "a  b", " lead", "trail ", "x \n y", "\0 \0a b", "  ", "a,b. c. d,", "don't we'll I'M 'S", "1234 56", "日本語 テキスト。", "a\u2003b \u3000c", "é.", "naïve, über. ", "\ttab\t tab", "z" * 200, "z" * 5000, "日本" * 300, "🙂 🙃🙂", "a\x1cb \x1c c", "\x85 x\x85", "<|endoftext|>"]


def odd(spark):
    return spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], DOC)


# Tokens


def test_bpe_matches_the_library(spark):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = table(spark, DIR, "documents").select("doc_id", "text").limit(20).unionByName(odd(spark))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for stretch in (bpe.STRETCH, 50):  # all rows in one stretch, or nearly one each
        for r in bpe.encode(df, ranks, P.PATTERN, with_ids=True, stretch=stretch).collect():
            ids = library.encode_ordinary(texts[r.doc_id])
            assert r.ids == ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_query_on_all_documents(spark):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in table(spark, DIR, "documents").collect()}
    rows = bpe.op2_byte_bpe(spark, DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_rows_nobody_wants(spark):
    """Null and repeated ids, repeated rows, clashing columns, and a word of a hundred thousand letters."""
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    rows = [(None, "a b", 1, 2), (None, "a b", 1, 2), (5, "c", 1, 2), (5, "d", 1, 2), (6, "a" * 100_000, 1, 2)]
    df = spark.createDataFrame(rows, DOC + ", ids long, words long")
    out = bpe.encode(df, ranks, P.PATTERN, with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out)[:4] == [(0, 2), (0, 2), (5, 1), (5, 1)]
    long = next(r for r in out if r.doc_id == 6)
    bytes_of = {i: t for t, i in ranks.items()}
    assert b"".join(bytes_of[i] for i in long.ids) == b"a" * 100_000


def test_bpe_keeps_frequent_words_of_a_full_memory(spark):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    texts = [f"often also x{chr(97 + i)}q z{chr(97 + i)}y often also" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    words = [w for r in bpe.cut(df, P.PATTERN, stretch=1, most_words=8).select(F.size("words")).collect() for w in r]
    assert sum(words) <= 20 * 2 + 10  # two new words a row; " also" and the like are not folded again and again
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode(df, ranks, P.PATTERN, with_ids=True, stretch=1, most_words=8).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: lib.encode_ordinary(t) for i, t in enumerate(texts)}
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_merges_need_regular_ranks():
    single = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        bpe.merges(single | {b"abc": 256})
    assert bpe.merges(single | {b"ab": 256, b"abc": 257}) == {(97, 98): 256, (256, 99): 257}
    pairs = bpe.merges(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    row, cells = bpe.table_of(pairs, 50_257)
    assert all(cells[row[a] ^ b] == (a << bpe.LEFT) | (t << bpe.TOKEN) for (a, b), t in pairs.items())


def test_bpe_decode(spark):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    rows = spark.createDataFrame([([464, 3290],), ([],)], "ids array<int>").select(bpe.decode(F.col("ids"), ranks).alias("b"))
    of = {r: t for t, r in ranks.items()}
    assert [bytes(r.b) for r in rows.collect()] == [of[464] + of[3290], b""]


def test_bpe_empty_table(spark):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    assert bpe.encode(spark.createDataFrame([], DOC), ranks, P.PATTERN).count() == 0


def check_packing(rows, texts, capacity=1024):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {k: t.encode(v or "", add_special_tokens=False).ids + [2] for k, v in texts.items()}
    by_doc, by_bin = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for k, parts in by_doc.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for *_, n in parts) == len(ids[k])
        assert all(n == capacity for *_, n in parts[1:])
    for parts in by_bin.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_bin), -(-sum(map(len, ids.values())) // capacity)


def test_packing(spark):
    df = table(spark, DIR, "documents").select("doc_id", "text").unionByName(odd(spark)).unionByName(spark.createDataFrame([(10_000, "long word " * 30_000)], DOC))
    rows = packing.pack(df, P.path("byte_bpe_50k.json")).collect()
    bins, least = check_packing(rows, {r.doc_id: r.text for r in df.collect()})
    assert bins <= least + 2
    assert packing.pack(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_packing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], DOC)
    rows = packing.pack(df, P.path("byte_bpe_50k.json"), rows_per_salt=1).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_keeps_every_constraint(score):
    rng = random.Random(3)
    counts = Counter(rng.randint(1, 100) for _ in range(5000))
    steps = packing.plan(counts, 100, 4, 6000.0 + 4000, score=score)
    bins: dict = {}
    steps_of: dict = {}
    for s in steps:
        steps_of.setdefault(s.length, []).append(s)
    for length, own in steps_of.items():
        for s, to in zip(own, [*[x.rank for x in own[1:]], counts[length]]):
            for k in range(to - s.rank):
                bins.setdefault(s.bin + k, []).append((s.offset, length))
    assert sum(map(len, bins.values())) == 5000
    for parts in bins.values():
        assert len(parts) <= 4 and sum(n * n for _, n in parts) <= 10_000 and sum(n for _, n in parts) <= 100
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
    with pytest.raises(ValueError):
        packing.plan({200: 1}, 100, 4, 1e9)


# Graphs


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({i for e in links for i in e}, links)
    assert got == {i: c for i, c in want.items() if any(a != b and i in (a, b) for a, b in links)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_components(spark):
    df = table(spark, DIR, "documents").select("doc_id", "text").unionByName(odd(spark))
    rows = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = {r.doc_id: fingerprint(r.text) for r in df.collect()}
    assert {i: r.fp & (1 << 64) - 1 for i, r in rows.items()} == fps
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in rows.items()} == roots(ids, links)


def test_simhash_links_in_crowded_cells(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(120)} | {rng.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    want = roots(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    for block in (7, 2000):
        found = {r.id: r.component for r in common.components(simhash.links(df, block=block)).collect()}
        assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_nn_descent_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    rows = [(i, [float(v) for v in centres[i % 30] + rng.standard_normal(16) * rng.choice([0.0, 0.03, 0.08])], int(i % 3)) for i in range(400)]
    rows += [(1000 + i, [float(v) for v in centres[0] + rng.standard_normal(16) * 0.02], 0) for i in range(150)]  # more than any list holds
    bad = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] + [1.0] * 15, 0), (2003, rows[0][1], None), (2004, [], 0), (2005, [1.0, None], 0), (2006, [1e300, 1e300], 0), (2007, [2.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, label int, n string")
    got = {r.vec_id: r for r in nn_descent.near_duplicates(df, block=40).collect()}
    assert len(got) == len(rows) + len(bad)
    links = []
    good = rows + bad[-2:]
    for k, (a, x, l) in enumerate(good):
        for b, y, m in good[:k]:
            if l == m and len(x) == len(y):
                u, v = (np.array(t) / np.abs(t).max() for t in (x, y))
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                    links.append((b, a))
    degree = Counter(i for e in links for i in e)
    assert {i: r.component_id for i, r in got.items()} == roots(got, links)
    assert {i: r.n_links for i, r in got.items()} == {i: degree[i] for i in got}
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, DIR, "documents")
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = common.written(stage(spark, before, DIR))
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    assert 0 < before.count() < docs.count()
    rows = pipeline.STAGES[-1][1](spark, before, DIR).collect()
    bins, least = check_packing(rows, {r.doc_id: r.text for r in before.collect()})
    assert bins <= least + 2

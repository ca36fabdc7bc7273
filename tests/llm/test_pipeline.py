"""The pipeline's document stages against plain Python, one by one."""

import re
from collections import Counter

from keystrata.llm import common, quality, secrets
from keystrata.session import table

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rates(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    repeat = len({j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)})
    filled = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or "")
    part = lambda a, b: a / b if b else 0.0
    return {
        "n_words": len(w), "repeat": repeat, "mean_word": part(chars, len(w)), "symbol_rate": part(symbols, chars),
        "dup_line_rate": part(len(filled) - len(set(filled)), len(filled)), "repeat_rate": part(repeat, len(w)), "mean_line": part(len(w), len(filled)),
    }


def kept(text, rules):
    r = rates(text)
    if r["n_words"] < 10 or 100 * r["repeat"] > 20 * r["n_words"]:
        return False
    return not any(all(r[n] <= v if sign == "<=" else r[n] > v for n, sign, v in rule.conditions) for rule in rules)


def without_repeated_lines(texts):
    first, gone = {}, {}
    for doc in sorted(texts):
        filled = [(i, x.strip(" ")) for i, x in enumerate(texts[doc].split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", x)]
        for k in range(len(filled) - 2):
            window = tuple(x for _, x in filled[k : k + 3])
            if window not in first:
                first[window] = (doc, k)
                continue
            start = max(k, first[window][1] + 3) if first[window][0] == doc else k
            gone.setdefault(doc, set()).update(filled[j][0] for j in range(start, k + 3))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) if d in gone else t for d, t in texts.items()}


def fingerprint(text):
    import xxhash

    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def one_of_each_group(texts):
    fps = {d: fingerprint(t) for d, t in texts.items()}
    group = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and group[b] < group[a]:
                    group[a], changed = group[b], True
    return {d: t for d, t in texts.items() if group[d] == d}


def masked(text):
    out, to = [], 0
    for _, start, end in secrets.find(text):
        if start >= to:
            out += [text[to:start], "[SECRET]"]
        to = max(to, end)
    return "".join([*out, text[to:]])


def test_stages_match_plain_python(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, DIR, "documents")
    rules = quality.train(docs, table(spark, DIR, "labels"))
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    steps = (lambda t: {d: x for d, x in t.items() if kept(x, rules)}, without_repeated_lines, one_of_each_group, lambda t: {d: masked(x) for d, x in t.items()})
    now = docs
    for (name, stage), plain in zip(pipeline.STAGES, steps):
        now = common.written(stage(spark, now, DIR))
        want = plain(want)
        assert {r.doc_id: r.text for r in now.collect()} == want, name
        assert now.columns == docs.columns
        assert all(r.n_chars == len(r.text) for r in now.collect()), name


def test_stages_take_odd_tables(spark):
    import corpus_pipeline as pipeline

    rows = [(None, None, "x", None), (1, "", None, 3), (2, "word " * 40_000, "y", 4), (3, " ".join(f"w{i} token = abcdefgh" for i in range(40)), "z", 5)]
    rows += [rows[-1], (4, *rows[-1][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in pipeline.STAGES[:-1]:
            now = common.written(stage(spark, now, DIR))
            assert now.columns == docs.columns, name
        packed = pipeline.STAGES[-1][1](spark, now, DIR)
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in now.collect()}
    assert pipeline.ORACLE_SQL is None


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use inside, repeated ids with other texts, and null ids."""
    import corpus_pipeline

    line = "one two three four five six seven eight nine ten eleven twelve number"
    texts = [(1, f"{line} a{i}x b{i}y") for i in range(3)] + [(1, f"{line} a0x b0y"), (2, None), (None, "no id"), (None, "no id")]
    names = ("_ld_id", "_ld_text", "_nth", "_text", "_row", "nth", "id", "whole", "row", "spread", "stats", "group")
    df = spark.createDataFrame([(d, t, *range(len(names))) for d, t in texts], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for stage in (corpus_pipeline.line_stage, corpus_pipeline.near_duplicate_stage, corpus_pipeline.secret_stage):
        out = stage(spark, df, DIR)
        assert out.columns == df.columns
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect())
    kept = corpus_pipeline.near_duplicate_stage(spark, df, DIR).collect()
    assert sum(r.doc_id is None for r in kept) == 2 and {r.text for r in kept if r.doc_id == 2} == {None}
    assert all(fingerprint(x.text or "") != fingerprint(y.text or "") for i, x in enumerate(kept) for y in kept[:i] if x.doc_id and y.doc_id)


def test_equal_rows_without_ids_are_packed_apart(spark):
    import public_tokenizers

    from keystrata.llm import packing

    df = spark.createDataFrame([(None, "the same words")] * 300, "doc_id long, text string")
    rows = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), rows_per_salt=10).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(rows) == len(places) == 300


def test_packing_remembers_words_in_little_memory():
    """A task of the packing stage shares an executor's memory with another and with what the stages before left."""
    import random
    import tracemalloc

    import pyarrow as pa
    import public_tokenizers

    from keystrata.llm import packing

    rng = random.Random(5)
    words = list({"".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(40_000)})
    texts = [" ".join(["first", *words[i : i + 400]]) for i in range(0, len(words), 400)]
    encoder = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), most=60_000)
    expected = [x for ids in encoder.whole(texts) for x in ids]
    tracemalloc.start()
    try:
        allocated = pa.total_allocated_bytes()
        for _ in range(3):  # learned, moved on to the next generation, known
            ids, ends = encoder.encode(pa.array(texts))
            assert ids.tolist() == expected and len(ends) == len(texts)
            del ids, ends
        kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - allocated
    finally:
        tracemalloc.stop()
    assert kept < 80 * len(words)


def test_packing_forgets_long_words():
    import pyarrow as pa
    import public_tokenizers

    from keystrata.llm import packing

    encoder = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), most=100)
    for text in ("a " + "bc" * 1000, "a b", "d " + "bc" * 1000 + ","):
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == encoder.whole([text])[0]
        assert encoder.memo.words.nbytes + encoder.old.words.nbytes < 8 * encoder.most + 2 * 5_000

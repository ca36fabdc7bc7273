"""Query columns that SQL doesn't cover, against plain Python over whole tables."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keystrata.llm import nn_descent, quality, registry
from keystrata.session import table

DIR = "/root/testdata/sf0.001"


def base_spans(text):
    names = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [("assign", *m.span()) for m in names.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_scan_query(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = registry.queries()["op8_secret_scan"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    some = 0
    for r in rows:
        want = base_spans(texts[r.doc_id])
        n = Counter(k for k, *_ in want)
        some += len(want)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        written = [":".join(map(str, s)) for s in want]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert not Counter(written) - Counter(spans)  # base ones stay
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)
    assert some


def test_quality_query_and_its_plan(spark):
    docs = table(spark, DIR, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    df = registry.queries()["op5_quality_rules"](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Arrow|MapIn|MapPartitions", plan)
    rules = quality.train(docs, table(spark, DIR, "labels"))
    for r in df.collect():
        text = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(windows)
        repeated = len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)})
        filled = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars, symbols, again = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(filled) - len(set(filled))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), chars, symbols, again, repeated)
        failed = len(w) < 10 or 100 * repeated > 20 * len(w)
        part = lambda a, b: a / b if b else 0.0
        x = np.array([[len(w), part(chars, len(w)), part(symbols, chars), part(again, len(filled)), part(repeated, len(w)), part(len(w), len(filled))]])
        rejected = any(rule.holds(x, quality.STATISTICS)[0] for rule in rules)
        assert r.base_failed == failed and r.kept == (not failed and not rejected)


def test_conjunctions_are_learned_in_order():
    """Two kinds of bad rows, each needing two conditions, and many rows that meet one of them."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.uniform(10, 1000, 6000), rng.uniform(2, 9, 6000), *(rng.uniform(0, 1, 6000) for _ in range(4))])
    bad = ((x[:, 2] > 0.7) & (x[:, 3] > 0.6)) | ((x[:, 1] < 3.5) & (x[:, 4] > 0.8))
    rules = quality.learn(x, bad)
    assert len(rules) >= 2 and sum(len(r.conditions) >= 2 for r in rules) >= 2
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= r.holds(x, quality.STATISTICS)
    assert (hit & bad).sum() / bad.sum() > 0.9 and (hit & ~bad).sum() / (~bad).sum() < 0.03


def planted(n_groups, per_group, large, dim=24, seed=5):
    """Groups of near copies, one of them large, between single vectors; links by brute force."""
    rng = np.random.default_rng(seed)
    sizes = [large] + [per_group] * n_groups
    centres = rng.standard_normal((len(sizes), dim))
    rows = np.concatenate([c + 0.06 * rng.standard_normal((n, dim)) for c, n in zip(centres, sizes)] + [rng.standard_normal((200, dim))])
    labels = np.repeat(np.arange(len(sizes)) % 3, sizes).tolist() + [0] * 200
    return rows, labels


def test_embedding_links_of_planted_groups(spark):
    rows, labels = planted(60, 4, 400)
    ids = np.random.default_rng(1).permutation(len(rows))
    df = spark.createDataFrame([(int(i), [float(v) for v in r], lab) for i, r, lab in zip(ids, rows, labels)], "vec_id long, embedding array<double>, label int")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    meets = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(meets, False)
    assert meets.sum() > 10_000
    got = {r.vec_id: r for r in nn_descent.near_duplicates(df).collect()}
    degree = dict(zip(ids.tolist(), meets.sum(axis=1).tolist()))
    found = sum(got[i].n_links for i in degree)
    assert all(got[i].n_links <= n for i, n in degree.items()) and found >= 0.95 * sum(degree.values())
    group = {int(i): int(i) for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(meets)):
            least = min(group[int(ids[a])], group[int(ids[b])])
            for x in (int(ids[a]), int(ids[b])):
                if group[x] != least:
                    group[x], changed = least, True
    same = sum(got[i].component_id == c for i, c in group.items())
    assert same >= 0.98 * len(group)
    # Repeated and null ids, unusable vectors and clashing columns.
    odd = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [1.0, 0.0], None)], "vec_id long, embedding array<double>, label int")
    out = nn_descent.near_duplicates(odd.withColumn("n", F.lit(1)).withColumn("component", F.lit(1))).collect()
    assert len(out) == 7 and all(r.n_links == 0 and r.component_id == r.vec_id for r in out if r.vec_id not in (1, None))

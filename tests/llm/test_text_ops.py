"""Line dedup, quality rules, secrets, toxicity, URL filter and chat format on small and odd inputs."""

import base64
import dataclasses
import hashlib
import json
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import chat, line_dedup, quality, registry, secrets, toxicity, url_filter
from keystrata.session import table

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        p = f"{DIR}/{t}.parquet"
        duck.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    got = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda cols, rows: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert key(got.columns, got.collect()) == key(want.columns, want.fetchall())


# Line deduplication


def lines(spark, *texts):
    return [r.text for r in line_dedup.dedup_lines(docs(spark, *texts)).orderBy("doc_id").collect()]


def test_later_windows_go(spark):
    assert lines(spark, "a\nb\nc\nd", "x\na\nb\nc\ny") == ["a\nb\nc\nd", "x\ny"]


def test_overlapping_windows_are_merged(spark):
    assert lines(spark, "a\nb\nc\nd\ne", "a\nb\nc\nd\ne\nf") == ["a\nb\nc\nd\ne", "f"]


def test_two_equal_lines_stay(spark):
    assert lines(spark, "a\nb\nx", "a\nb\ny") == ["a\nb\nx", "a\nb\ny"]


def test_a_run_of_equal_lines_keeps_one_window(spark):
    assert lines(spark, "a\na\na\na\na") == ["a\na\na"]


def test_line_dedup_odd_rows(spark):
    rows = [(1, "a\nb\nc", "p"), (1, "a\nb\nc", "p"), (None, None, "q"), (2, "", "r"), (3, " a \n\nb\nc\n\nz", "s"), (None, "k\nl\nm", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")  # gone: a name the operator uses inside
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text, r.gone) for r in out.collect())
    assert got == Counter([(1, "a\nb\nc", "p")] * 2 + [(None, None, "q"), (2, "", "r"), (3, "\n\nz", "s"), (None, "k\nl\nm", "t")])
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_has_no_python(spark):
    plan = registry.queries()["op1_line_dedup"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    filled = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(filled) - len(set(filled)), len(covered)


def test_statistics_match_brute_force(spark):
    odd = ["", None, " \t\n", "a b c d e a b c d e", "x\nx\n\nx", "🙂 é\u00a0é #*$%&|<>", "a a a a a a a a", "one two three four five six " * 50, "w" * 50_000]
    df = table(spark, DIR, "documents").select("doc_id", "text").limit(60).unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], DOC))
    for r in quality.statistics(df).collect():
        s = r.stats
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == base(r.text), r.text


def test_learner_finds_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.STATISTICS)))
    bad = (x[:, 2] > 0.7) & (x[:, 5] <= 0.4)
    rules = quality.learn(x, bad)
    hit = np.any([r.holds(x, quality.STATISTICS) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.97 and (hit & ~bad).sum() < 0.1 * bad.sum()


def test_quality_without_labels_and_extra_columns(spark):
    good = "word " + " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, good, 5), (None, None, 6), (2, "few", 7)], "doc_id long, text string, stats long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rules = quality.train(df, none)
    assert rules == []
    kept = quality.keep(df, rules)
    assert kept.columns == df.columns and [(r.doc_id, r.stats) for r in kept.collect()] == [(1, 5)]
    assert quality.keep(df.limit(0), rules).count() == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    df, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rules = quality.train(df, labels.where("doc_id % 2 = 0"))
    kept = {r.doc_id for r in quality.keep(df, rules).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    right = sum((r.doc_id in kept) == (r.quality == 1) for r in rest)
    assert right / len(rest) > 0.9


# Secrets


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + content


KEY = der(0x30, der(2, b"\0") + der(0x30, der(6, bytes(range(1, 8)))) + der(4, bytes(range(100))))


def kinds(text):
    return [(k, text[a:b]) for k, a, b in secrets.find(text)]


def test_base_patterns():
    assert kinds('x api_key = "abcdef1"') == [("assign", 'api_key = "abcdef1')]
    assert kinds("TOKEN: abc") == [] and kinds("ſecret: abcdefg") == []
    assert kinds("é AKIA" + "A1" * 8) == [("access", "AKIA" + "A1" * 8)]
    assert kinds("AKIA" + "A" * 15) == []
    assert kinds("f" * 24 + " " + "f" * 23) == [("hex", "f" * 24)]


def test_structures_are_confirmed():
    encoded = base64.b64encode(KEY).decode()
    armour = f"-----BEGIN PRIVATE KEY-----\n{encoded}\n-----END PRIVATE KEY-----"
    assert ("armour", armour) in kinds(f"a {armour} b") and ("key", encoded) in kinds(f"a {encoded} b")
    broken = base64.b64encode(KEY[:-1] + b"xx").decode()
    assert kinds(f"a {broken} b") == []
    assert ("key", KEY.hex()) in kinds(KEY.hex())
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    assert kinds(f"{head}.e30.c2ln") == [("token", f"{head}.e30.c2ln")]
    other = base64.urlsafe_b64encode(b'{"type":"none"}').decode().rstrip("=")
    assert kinds(f"{other}.e30.c2ln") == []


def test_secret_scan_and_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdefgh z", 1), (None, None, 2), (2, "", 3), (1, "é token=abcdefgh z", 1)], "doc_id long, text string, spans long")
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.scan(df).collect())
    assert got == [("1", [("assign", 2, 16)]), ("1", [("assign", 2, 16)]), ("2", []), ("None", [])]
    assert sorted(str(r.text) for r in secrets.redact(df).collect()) == ["", "None", "é [SECRET] z", "é [SECRET] z"]
    assert secrets.scan(df.limit(0)).count() == 0


def test_scan_finds_nothing_twice():
    long = "word " * 100_000 + "secret: 1234567"
    assert [k for k, *_ in secrets.find(long)] == ["assign"]


# Toxicity


def test_grammar_contexts():
    g = toxicity.Grammar({"idiot": 5.0})
    plain, negated, quoted = g.score("what an idiot"), g.score("she is not an idiot"), g.score('he said that an "idiot" spoke')
    assert plain >= 0.7 > negated > g.score("nothing here") and plain > quoted
    assert g.score("you idiot") > plain and g.score("") == pytest.approx(g.base)
    assert g.score("I will kill you") > g.score("kill the process")


def test_transducers_compose():
    said, menace = toxicity.reported(), toxicity.threat()
    both = toxicity.compose(said, menace)
    state, written = both.start, []
    for symbol in ("report", "intent", "threat", "end", "intent", "other", "threat", "threat"):
        state, out, _ = both.step(state, symbol)
        written.append(out)
    assert written == ["report", "intent", "menace/said", "end", "intent", "other", "menace", "menace"]
    assert len(toxicity.grammar_of().states()) > max(len(make().states()) for make in toxicity.PARTS.values())
    # Composition is associative: the same path, written and weighed alike.
    one = toxicity.compose(toxicity.compose(said, toxicity.negated()), menace)
    two = toxicity.compose(said, toxicity.compose(toxicity.negated(), menace))
    s, t = one.start, two.start
    for symbol in ("quote", "negation", "insult", "intent", "threat", "quote", "threat", "end", "insult"):
        (s, *x), (t, *y) = one.step(s, symbol), two.step(t, symbol)
        assert x == y


def _sentences():
    """(sentence, toxic): insults that negation, reported speech and quotes take back, menaces that need an intent, and mild words that need a target."""
    insults, mild, out = ("scumbag", "vermin", "halfwit"), ("slowcoach", "layabout"), []
    for i in range(600):
        x, m = insults[i % 3], mild[i % 2]
        out += [(f"such a {x} here", 1), (f"never a {x} here", 0), (f"somebody said {x} here", 0)]
        out += [("we will strangle it", 1), ("how to kill processes", 0), (f"you {m} there", 1)]
        out += [(f"one {m} there", 0)] if i % 5 == 0 else []
        out += [("we will rest, such a thing is here and there with it", 0)] * 2
    letters = lambda k: "".join(chr(97 + k // 26**e % 26) for e in range(3))
    places = ("river", "mill", "harbour", "boat", "quay", "lamp")
    return [(f"{text}. " + " ".join(letters(k) + x for x in places), y) for k, (text, y) in enumerate(out)]


def test_each_transducer_changes_held_out_predictions(spark):
    rows = _sentences()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], DOC)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    held = [(t, y) for i, (t, y) in enumerate(rows) if zlib.crc32(str(i).encode()) % 3 == 1]
    train = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    grammar = toxicity.learn(docs, train)
    predict = lambda g: [g.score(t) >= 0.7 for t, _ in held]
    whole = predict(grammar)
    right = [p == (y == 1) for p, (_, y) in zip(whole, held)]
    assert sum(right) / len(right) > 0.9
    for part in toxicity.PARTS:
        less = dataclasses.replace(grammar, parts=tuple(p for p in toxicity.PARTS if p != part))
        changed = [p != q for p, q in zip(whole, predict(less))]
        assert any(changed), part
        assert sum(p == (y == 1) for p, (_, y) in zip(predict(less), held)) < sum(right), part


def test_toxicity_query_against_plain_python(spark):
    """The query's rows are the grammar's scores of whole texts, and the held-out rows those of the remainder."""
    d = "/root/testdata/sf0.001"
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = table(spark, d, "labels").where(~toxicity._held_out(F.col("doc_id")))
    grammar = toxicity.learn(table(spark, d, "documents"), labels)
    texts = {r.doc_id: r.text or "" for r in table(spark, d, "documents").collect()}
    rows = registry.queries()["op7_toxicity"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == held(r.doc_id) and r.score == pytest.approx(grammar.score(texts[r.doc_id])) and r.predicted == int(r.score >= 0.7)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in registry.queries()["op7_toxicity"](spark, d).collect()}
    held = [(r.toxic, rows[r.doc_id].predicted) for r in table(spark, d, "labels").collect() if rows[r.doc_id].held_out]
    found = sum(t and p for t, p in held) / sum(t for t, _ in held)
    wrong = sum(p and not t for t, p in held) / sum(not t for t, _ in held)
    assert found > 0.75 and wrong < 0.02


def test_toxicity_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, "x " * 20_000)], DOC)
    grammar = toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert grammar.insults == {} and toxicity.score(df, grammar).count() == 3
    assert toxicity.score(df.limit(0), grammar).count() == 0


# URL filter


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.com/en/71?x#y", "https://example.com/en/8", "ftp://x.net#f", None, "no scheme", "http://sub.example.net/de/8", "http://example.net/de/7", "http://badexample.com/en/7", "a://h?q/p", "://org/es/"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[1] == ("example.com", "/en/8", "com/en/", "block")
    assert got[2][:3] == ("x.net", "", None) and got[3][:3] == got[4][:3] == ("", "", None)
    assert got[5][2:] == ("example.net/de/8", "block") and got[6][2:] == ("net/de/", "allow")
    assert got[7][2:] == ("com/en/", "block") and got[8][:2] == ("h", "") and got[9][2:] == ("org/es/", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_templates_generalise(spark):
    urls = [f"http://h.com/en/{i}" for i in range(9)] + [f"http://h.com/fr/{i}/tail" for i in range(30)] + [f"http://h.com/user/n{i}x" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    shapes = {r.template for r in url_filter.judge(df).collect()}
    assert shapes == {"/en/{n}", "/fr/{n}/tail", "/user/{*}"}


def test_url_filter_has_no_python(spark):
    plan = registry.queries()["op10_url_filter"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Chat format


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "\\\\n</s>", "", "<s>", "a\n<", "[", "é🙂 x", "[\\INST]"]
    for a in tricky:
        for b in tricky:
            turns = [("user", a), (b, a), ("assistant", b)]
            text, spans = chat.render(turns)
            assert chat.read_back(text) == turns
            assert "".join(chat.unescape(text[i:j]) for i, j in spans) == b + (a if b == "assistant" else "")


def test_chat_masks(spark):
    import public_tokenizers

    rows = [(1, 1, "assistant", "é🙂 日本 x "), (1, 0, "user", "q"), (1, 2, "assistant", "</s>"), (None, None, None, None), (2, 0, "assistant", " lead"), (2, 0, "assistant", " lead")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].loss_sha256 == sha("é🙂 日本 x </s>") and got[1].turns_sha256 == sha("user\nq\nassistant\né🙂 日本 x \nassistant\n</s>\n")
    assert (got[None].n_turns, got[None].loss_chars, got[2].loss_sha256) == (1, 0, sha(" lead lead"))
    for r in chats.collect():
        assert len(r.ids) == len(r.loss_mask)
    assert chat.format_chats(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0

"""Parts of the operators' work that small or even inputs don't show."""

import base64
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import nn_descent, secrets


def test_missed_pairs_are_an_error(spark, monkeypatch):
    rng = np.random.default_rng(3)
    near = lambda v, n: [(v + 0.005 * rng.standard_normal(32)).tolist() for _ in range(n)]
    vectors = near(rng.standard_normal(32), 60) + [x for _ in range(10) for x in near(rng.standard_normal(32), 2)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: r.n_links for r in nn_descent.near_duplicates(df).collect()}
    assert got == {i: 59 if i < 60 else 1 for i in range(80)}
    # The pairs are 20 of 3,560 links, but 20 of 80 vectors.
    seeds = nn_descent.seeds
    monkeypatch.setattr(nn_descent, "seeds", lambda *a, **k: seeds(*a, **k).where(F.col("b") < 60))
    with pytest.raises(RuntimeError, match="all links of 60 of 80 vectors"):
        nn_descent.near_duplicates(df)


@pytest.mark.parametrize("reach", [1, 4])
def test_seeds_reach_over_the_edges_of_tasks(spark, reach):
    rng = np.random.default_rng(4)
    rows = [(i, 1, 8, (lambda v: v / np.linalg.norm(v))(rng.standard_normal(8)).tobytes(), 1) for i in range(203)]
    df = spark.createDataFrame(rows, "id long, label long, dim int, vec binary, n long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {(r.a, r.b) for r in nn_descent.seeds(df, orders=1, seed=1, reach=reach, least=-2.0).collect()}
        line = [r.id for r in nn_descent._signatures(df, 1, 1).orderBy("code", "id").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {tuple(sorted((line[i], line[i + k]))) for k in range(1, reach + 1) for i in range(len(line) - k)}
    assert want <= got


def test_rows_of_one_id_and_other_texts_stay(spark):
    import corpus_pipeline as pipeline

    text = lambda k: " ".join(f"{k}{i * i}" for i in range(60))
    rows = [(1, text("x")), (1, text("y")), (5, text("x")), (5, text("z")), (5, text("z")), (7, text("y")), (None, text("x"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in pipeline.near_duplicate_stage(spark, df, "").collect())
    assert got == sorted([("1", text("x")), ("1", text("y")), ("5", text("z")), ("None", text("x"))])


def der(tag, *parts):
    content = b"".join(parts)
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + content


NOISE = bytes(i * 37 % 251 for i in range(1, 401))
RSA = der(0x30, der(2, b"\0"), der(2, NOISE[:200]), der(2, b"\1\0\1"), der(2, NOISE[:150]))
EC = der(0x30, der(2, b"\1"), der(4, NOISE[:32]))
ENCRYPTED = der(0x30, der(0x30, der(6, NOISE[:9]), der(0x30, der(4, NOISE[:8]))), der(4, NOISE[:160]))
DIGEST = der(0x30, der(0x30, der(6, NOISE[:9]), der(5)), der(4, NOISE[:32]))

FULL = der(0x30, der(2, b"\0"), der(2, NOISE[:200]), der(2, NOISE[:75]))  # 288 bytes: whole lines of 48 and 64


def test_more_forms_of_keys_are_confirmed():
    assert secrets.is_key(EC) and secrets.is_key(ENCRYPTED) and secrets.is_key(RSA) and not secrets.is_key(DIGEST)
    body = base64.b64encode(ENCRYPTED).decode()
    block = f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{textwrap.fill(body, 64)}\n-----END ENCRYPTED PRIVATE KEY-----"
    assert ("armour", 2, 2 + len(block)) in secrets.find(f"a {block} b")
    cipher = textwrap.fill(base64.b64encode(NOISE[:320]).decode(), 64)
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{head}{cipher}\n-----END RSA PRIVATE KEY-----"
    assert ("armour", 2, 2 + len(block)) in secrets.find(f"a {block} b")
    assert not secrets.find(block.replace("DEK-Info", "Other"))


@pytest.mark.parametrize("width", [48, 64, 76])
@pytest.mark.parametrize("data", [RSA, ENCRYPTED, FULL, b"openssh-key-v1\0" + (b"\0\0\0\4none" * 2) + b"\0\0\0\0" + b"\0\0\0\1" + NOISE])
def test_wrapped_keys_without_armour(width, data):
    body = textwrap.fill(base64.b64encode(data).decode(), width)
    for before, after in (("", ""), ("key: ", "\nhello world"), ("Q" * width + "\n", "\n\nend")):
        text = before + body.replace("\n", "\r\n  " if after else "\n") + after
        spans = [(a, b) for k, a, b in secrets.find(text) if k == "key"]
        assert (len(before), len(text) - len(after)) in spans
    assert not [k for k, *_ in secrets.find(textwrap.fill(base64.b64encode(NOISE).decode(), width)) if k == "key"]

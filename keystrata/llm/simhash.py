"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint's 64 bits are 32 segments of two bits; its embedding is the vector of their bit
counts, kept as one long in thermometer code (01 for one bit, 11 for two), so that the Manhattan
distance of two embeddings is the bit count of an exclusive or. It never exceeds the Hamming
distance. The coordinates form five groups. At distance 3 or less at most three groups differ, so
two fingerprints that link share the cell of at least one pair of groups: ten cells for each
distinct fingerprint. In each cell the embedding filters and the fingerprints themselves decide.

A crowded cell is cut into blocks of rows, and each pair of its blocks is compared on its own, so
no task needs a whole cell and nothing is left out. A task sends on no pairs but a spanning star of
what it found linked. Equal fingerprints are one row before all that.

Null text counts as empty. Empty and blank texts have fingerprint zero and link like any other.
Rows with a null id get a fingerprint and the component of their equals; repeated ids and rows are
kept; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import components, written
from keystrata.session import table

LOW = 0x5555555555555555  # the lower bit of each segment
GROUPS = (7, 7, 6, 6, 6)  # segments in each group of coordinates
SEED = 42


def _masks() -> list[int]:
    at, masks = 0, []
    for n in GROUPS:
        masks.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a UTF-8 text: a bit is set if it is in over half of the shingles' hashes."""
    import xxhash

    parts = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        raw = np.array(hashes[lo : lo + (1 << 14)], ">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long; one Arrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py() or b"", words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _thermometer(fp: Column) -> Column:
    low, half = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(half).bitwiseAND(low)
    both = fp.bitwiseAND(half).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _stars(batches: Iterator[pa.RecordBatch], most_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: links inside blocks as (a, b), where b is the smallest of what is linked so."""

    def links(group: np.ndarray, fp: np.ndarray, near: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        i, step = np.arange(len(group)), 0
        while len(i):
            step += 1
            i = i[i < len(group) - step]
            i = i[group[i] == group[i + step]]
            found = i[np.bitwise_count(near[i] ^ near[i + step]) <= most_bits]
            found = found[np.bitwise_count(fp[found] ^ fp[found + step]) <= most_bits]
            left.append(rep[found])
            right.append(rep[found + step])
        return np.concatenate(left), np.concatenate(right)

    def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = where[: len(a)], where[len(a) :]
        root = np.arange(len(ids))
        while True:
            least = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, least)
            np.minimum.at(root, y, least)
            root = root[root]
            if (root == before).all():
                break
        leaf = np.flatnonzero(root != np.arange(len(ids)))
        return ids[leaf], ids[root[leaf]]

    rest: tuple | None = None

    def emit(now: tuple) -> pa.RecordBatch:
        a, b = stars(*links(*now))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("combo", "cell", "lo", "hi")], axis=1)
        # Unsigned, as numpy counts the bits of absolute values.
        fp, near = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "near"))
        now = (key, fp, near, batch.column("rep").to_numpy(zero_copy_only=False))
        if rest is not None:
            now = tuple(np.concatenate([x, y]) for x, y in zip(rest, now))
        key = now[0]
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
        last = int(np.searchsorted(group, group[-1]))  # the last block may go on in the next batch
        rest = tuple(x[last:] for x in now)
        if last:
            yield emit((group[:last], *(x[:last] for x in now[1:])))
    if rest is not None and len(rest[0]):
        yield emit((np.zeros(len(rest[0]), np.int64), *rest[1:]))


def links(distinct: DataFrame, *, most_bits: int = 3, block: int = 2000) -> DataFrame:
    """Edges (a, b) between reps of fingerprints at most `most_bits` apart, spanning each component.

    distinct: fp and rep, each fp once. most_bits may be 3 at most: the five groups stand for that.
    """
    if most_bits > len(GROUPS) - 2:
        raise ValueError("two groups of coordinates must stay equal")
    masks = _masks()
    pairs = list(itertools.combinations(range(len(masks)), 2))
    near = _thermometer(F.col("fp"))
    cells = F.array(*(F.col("near").bitwiseAND(F.lit(_signed(masks[i] | masks[j]))) for i, j in pairs))
    rows = distinct.where("rep is not null").withColumn("near", near).select("fp", "near", "rep", F.posexplode(cells).alias("combo", "cell"))
    crowded = rows.groupBy("combo", "cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
    crowded = crowded.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    hashed = lambda df: df.withColumn("h", F.xxhash64("combo", "cell"))  # noqa: E731  lets adaptive execution split a crowded cell
    rows = hashed(rows).join(hashed(crowded), ["h", "combo", "cell"], "left").drop("h")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("combo", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "near", "rep")
    rows = rows.repartition("combo", "cell", "lo", "hi").sortWithinPartitions("combo", "cell", "lo", "hi")
    return rows.mapInArrow(lambda batches: _stars(batches, most_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, words: int = 3, most_bits: int = 3, block: int = 2000) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: the smallest doc_id reachable over links."""
    own = written(fingerprints(docs, words))
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(distinct, most_bits=most_bits, block=block))
    of = distinct.join(found, distinct["rep"] == found["id"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    hashed = lambda df: df.withColumn("h", F.xxhash64("fp"))
    return hashed(own).join(hashed(of), ["h", "fp"]).select("doc_id", "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict:
    return {"op6_simhash_near_dedup": op6_simhash_near_dedup}


def oracle_sql() -> dict:
    return {}

"""Embedding near-duplicates by NN-descent, an audit of recall, and an exact count inside components.

Only vectors with equal labels (and dimensions) are compared, by cosine in double precision. Equal
vectors are one row with a count. Seeds: in several random hyperplane orders, each vector is compared
with its next neighbours. Each round of descent then pairs the members of every neighbour list with
one another and keeps the best of what is found; a list that is full of links (saturated) is allowed
twice as many entries in the next round. Rounds end when they find no more than a few new links.

Links give components. A vector's links all lie in its component, so an exact comparison inside each
component, in blocks, completes the link counts however long lists are; no pair of a group is sent
on, only counts. A bounded set of vectors is also compared with all rows; if less than `recall` of
their links are found, or of those of them with links less than `recall` have all, seeds from further
orders are added and the descent goes on. If that still holds after the last try, it is an error.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do
those with a null label; they are returned with no links and themselves as component. Null ids are
returned with a null component. Repeated ids count as vectors of their own, with one component. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm.common import components, durable, written
from keystrata.session import table

PAIRS = "a long, b long, cos double"


def _normal(vectors: DataFrame) -> DataFrame:
    """(id, label, dim, vec) of usable vectors; vec holds the normalised components as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, label, x in zip(*(c.to_pylist() for c in batch.columns)):
                if not x or None in x:
                    continue
                v = np.array(x, np.float64)
                norm = np.linalg.norm(v / max(1e-300, np.abs(v).max())) if np.isfinite(v).all() and v.any() else 0.0
                if norm > 0:
                    v = v / np.abs(v).max() / norm
                    for column, value in zip(out, (i, label, len(x), v.tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["id", "label", "dim", "vec"]
            )

    rows = vectors.where("label is not null and vec_id is not null")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "id long, label long, dim int, vec binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _signatures(distinct: DataFrame, orders: int, seed: int, bits: int = 30) -> DataFrame:
    """Each vector once for every order: the signs of random projections, first bit first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column("vec"), int(dim))
                planes = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), orders * bits))
                signs = (x @ planes > 0).reshape(len(x), orders, bits)
                codes = (signs * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)
                for k in range(orders):
                    columns = [part.column(c) for c in ("id", "label", "dim", "vec")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(x), k, np.int32)), pa.array(codes[:, k].astype(np.int64))], names=["id", "label", "dim", "vec", "way", "code"])

    return distinct.select("id", "label", "dim", "vec").mapInArrow(run, "id long, label long, dim int, vec binary, way int, code long")


def seeds(distinct: DataFrame, *, orders: int, seed: int, reach: int, least: float) -> DataFrame:
    """Pairs of vectors near each other in some order with a cosine of `least` at least.

    Each task also sends its first and last `reach` rows on, so that pairs over the edges of tasks are compared too.
    """
    keys = ["label", "dim", "way", "code", "id", "vec"]

    def near(now: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        group = np.stack([now.column(c).to_numpy() for c in ("label", "dim", "way")], axis=1)
        ids, dims = now.column("id").to_numpy(), now.column("dim").to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = _matrix(now.column("vec").take(pa.array(at)).combine_chunks(), int(dim))
            for step in range(1, reach + 1):
                same = np.flatnonzero((group[at[:-step]] == group[at[step:]]).all(axis=1)) if len(at) > step else np.empty(0, np.int64)
                cos = np.einsum("ij,ij->i", x[same], x[same + step])
                good = cos >= least
                a, b = ids[at[same[good]]], ids[at[same[good] + step]]
                yield np.minimum(a, b), np.maximum(a, b), cos[good]

    def passes(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
        head: pa.Table | None = None
        rest: pa.Table | None = None
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch]).select(keys)
            if head is None or head.num_rows < reach:
                more = own.slice(0, reach - (0 if head is None else head.num_rows))
                head = more if head is None else pa.concat_tables([head, more])
            total += own.num_rows
            now = own if rest is None else pa.concat_tables([rest, own])
            rest = now.slice(max(0, now.num_rows - reach))
            for a, b, cos in near(now):
                found = [pa.array(a), pa.array(b), pa.array(cos)]
                none = [pa.nulls(len(a), own.schema.field(c).type) for c in keys] if edges else []
                yield pa.RecordBatch.from_arrays([*found, *none], names=["a", "b", "cos", *keys[: len(none)]])
        if edges and head is not None:
            tail = rest.slice(max(0, rest.num_rows - (total - head.num_rows)))  # no row twice
            for t in (head, tail):
                none = [pa.nulls(t.num_rows, k) for k in (pa.int64(), pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*none, *(t.column(c).combine_chunks() for c in keys)], names=["a", "b", "cos", *keys])

    order = ["label", "dim", "way", "code", "id"]  # ids keep a range of equal codes from landing in one task
    rows = _signatures(distinct, orders, seed).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "label long, dim int, way int, code long, id long, vec binary"
    # Written once: ranges cut a second time need not have the same edges.
    both = written(rows.mapInArrow(lambda batches: passes(batches, True), f"{PAIRS}, {kinds}"))
    edge = both.where("way is not null").select(*keys).repartition("label", "dim", "way").sortWithinPartitions(*order)
    over = edge.mapInArrow(lambda batches: passes(batches, False), PAIRS)
    return both.where("way is null").select("a", "b", "cos").unionByName(over).where("a <> b").dropDuplicates(["a", "b"])


def _scored(pairs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """(a, b, cos) of candidate pairs of equal label and dimension, from `least` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                cos = np.einsum("ij,ij->i", _matrix(part.column("va"), int(dim)), _matrix(part.column("vb"), int(dim)))
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(cos)], names=["a", "b", "cos"])
                yield out.filter(pa.array(cos >= least))

    side = lambda k, *more: distinct.select(F.col("id").alias(k), F.col("vec").alias(f"v{k}"), *more)
    rows = pairs.join(side("a", "dim"), "a").join(side("b"), "b").select("a", "b", "dim", "va", "vb")
    return rows.mapInArrow(run, PAIRS)


def _lists(graph: DataFrame, sizes: DataFrame, start: int) -> DataFrame:
    """(m, x, cos, rank, k): the best k neighbours of each vector; k is `start` or what sizes holds."""
    both = graph.select(F.col("a").alias("m"), F.col("b").alias("x"), "cos").unionByName(graph.select(F.col("b").alias("m"), F.col("a").alias("x"), "cos"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("m").orderBy(F.col("cos").desc(), "x")))
    return ranked.join(sizes, "m", "left").withColumn("k", F.coalesce("k", F.lit(start))).where(F.col("rank") <= F.col("k"))


def descend(graph: DataFrame, distinct: DataFrame, *, threshold: float, least: float, start: int, rounds: int, few: float) -> DataFrame:
    """The graph after rounds of neighbours-of-neighbours joins.

    Rounds go on while they find more than a few links, or links of more than a few of the linked
    vectors: a large group has most links, but is only as many vectors as it is.
    """

    def linked(pairs: DataFrame) -> int:
        ends = pairs.where(F.col("cos") >= threshold).select(F.explode(F.array("a", "b")).alias("id"))
        return ends.distinct().count()

    sizes = graph.select(F.col("a").alias("m"), F.lit(start).alias("k")).limit(0)
    links = graph.where(F.col("cos") >= threshold).count()
    for _ in range(rounds):
        lists = durable(_lists(graph, sizes, start))
        one, two = lists.select("m", F.col("x").alias("a")), lists.select("m", F.col("x").alias("b"))
        found = one.join(two, "m").where("a < b").select("a", "b").distinct().join(graph.select("a", "b"), ["a", "b"], "left_anti")
        new = written(_scored(found, distinct, least))
        graph = graph.unionByName(new)
        # A list that is full down to its last entry with links gets twice the room.
        full = lists.where((F.col("rank") == F.col("k")) & (F.col("cos") >= threshold)).select("m", (2 * F.col("k")).alias("k"))
        sizes = durable(sizes.join(full.select("m"), "m", "left_anti").unionByName(full))
        now = graph.where(F.col("cos") >= threshold).count()
        if now - links <= few * links and linked(new) <= few * linked(graph):
            break
        links = now
    return graph


def _counts(members: DataFrame, *, threshold: float, block: int) -> DataFrame:
    """(id, links): vectors of the same component linked with each, copies counted, by blocks of rows.

    members: id, component, dim, vec, n. A component of more than `block` rows is cut into blocks, and
    each pair of its blocks is a group of its own.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    rows = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "dim", "vec", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(t: pa.Table) -> pa.RecordBatch:
            x, n = _matrix(t.column("vec").combine_chunks(), t.column("dim")[0].as_py()), t.column("n").to_numpy()
            own, lo, hi = t.column("own").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            meets = (x @ x.T >= threshold) & ((own[:, None] != own[None, :]) | (lo == hi))
            np.fill_diagonal(meets, False)
            return pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.array(meets @ n)], names=["id", "links"])

        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            keys = np.stack([now.column(c).to_numpy() for c in ("component", "lo", "hi")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            for lo, hi in zip(cuts, cuts[1:]):
                yield count(now.slice(lo, hi - lo))
            rest = now.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield count(rest)

    order = ["component", "lo", "hi"]
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audit(distinct: DataFrame, counts: DataFrame, *, threshold: float, most: int) -> tuple[int, int, int, int]:
    """(links found, links there, vectors with all links found, vectors with links) of at most `most` vectors, by comparing them with all rows."""
    asked = distinct.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "label", "dim", "vec").collect()  # bounded
    if not asked:
        return 0, 0, 0, 0
    groups: dict[tuple, tuple[list, list]] = {}
    for r in asked:
        ids, vecs = groups.setdefault((r["label"], r["dim"]), ([], []))
        ids.append(r["id"])
        vecs.append(np.frombuffer(bytes(r["vec"]), np.float64))
    stacked = {k: (np.array(i), np.stack(v)) for k, (i, v) in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dims, ids, n = (batch.column(c).to_numpy() for c in ("label", "dim", "id", "n"))
            for (q_label, dim), (q_ids, q) in stacked.items():
                at = np.flatnonzero((label == q_label) & (dims == dim))
                if len(at):
                    x = _matrix(batch.column("vec").take(pa.array(at)), dim)
                    meets = (q @ x.T >= threshold) & (q_ids[:, None] != ids[at][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(meets @ n[at])], names=["id", "there"])

    there = distinct.select("id", "label", "dim", "vec", "n").mapInArrow(run, "id long, there long").groupBy("id").agg(F.sum("there").alias("there"))
    got = there.where("there > 0").join(counts, "id", "left").select(F.coalesce("links", F.lit(0)).alias("found"), "there")
    whole = F.count(F.when(F.col("found") >= F.col("there"), 1))
    r = got.agg(F.sum("found").alias("found"), F.sum("there").alias("there"), whole.alias("whole"), F.count("*").alias("asked")).first()
    return r["found"] or 0, r["there"] or 0, r["whole"], r["asked"]


def near_duplicates(
    vectors: DataFrame,
    *,
    threshold: float = 0.98,
    orders: int = 8,
    reach: int = 4,
    start: int = 8,
    rounds: int = 4,
    few: float = 0.01,
    block: int = 2000,
    audited: int = 1000,
    recall: float = 0.95,
    tries: int = 3,
    seed: int = 17,
) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of vectors (vec_id, embedding, label).

    Two vectors linked with a third have a cosine of 2 threshold^2 - 1 at least, so neighbour lists
    hold nothing below that. `audited` bounds the vectors compared with all rows.
    """
    least = 2 * threshold * threshold - 1
    own = written(_normal(vectors))
    distinct = written(own.groupBy("label", "dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "label", "dim", "vec", "n"))
    graph = None
    for k in range(tries):
        more = seeds(distinct, orders=orders, seed=seed + k, reach=reach, least=least)
        graph = written(more if graph is None else graph.unionByName(more).dropDuplicates(["a", "b"]))
        graph = descend(graph, distinct, threshold=threshold, least=least, start=start, rounds=rounds, few=few)
        found = durable(components(graph.where(F.col("cos") >= threshold).select("a", "b")))
        members = distinct.join(found, "id").select("id", "component", "dim", "vec", "n")
        counts = durable(_counts(members, threshold=threshold, block=block))
        hit, there, whole, asked = audit(distinct, counts, threshold=threshold, most=audited)
        if hit >= recall * there and whole >= recall * asked:
            break
    else:
        raise RuntimeError(f"recall below {recall} after {tries} tries: {hit} of {there} links, all links of {whole} of {asked} vectors")
    known = distinct.join(found, "id", "left").join(counts, "id", "left").select(
        "label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    # Ids take their representative's row; the vector itself is the key, so equal ids stay apart.
    named = own.join(known, ["label", "dim", "vec"]).select("id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    by_id = named.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rest.join(by_id, rest["vec_id"] == by_id["id"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def queries() -> dict:
    return {"op3_embedding_near_dedup": op3_embedding_near_dedup}


def oracle_sql() -> dict:
    return {}

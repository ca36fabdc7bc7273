"""Vector best-fit packing of tokenised documents into training sequences.

Tokenising is one Arrow pass over the documents (no shuffle) that keeps only piece descriptions.
The packing itself is planned on the histogram of piece lengths: items of one length are alike, so
the driver sees at most `capacity` counts however large the corpus is. Bins with equal residuals
(tokens, documents, attention cost) form one state with a multiplicity; each length, longest first,
goes to the fitting state with the best score, until none of that length is left. A plan row sends a
range of ranks within a length to a range of bins, so pieces find their place by their rank.

Ranks come from row numbers within (length, salt) and running sums of the salts' counts, so a
length that holds a third of all pieces is spread over many tasks.

Null text counts as empty, and every document has at least its end token. Repeated rows are packed
each for itself; a null id is kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm.common import worker_cache, written
from keystrata.session import table

END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words:
    """Numbered words, and their ids one after another, in arrays: as Python strings they would take most of a worker's memory."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])

    def numbers(self, words: pa.Array, since: int = 0) -> np.ndarray:
        """The words' numbers, -1 for those that aren't among the words from number `since` on."""
        found = pc.index_in(words, value_set=self.words.slice(since)).fill_null(-1).to_numpy()
        return np.where(found < 0, -1, found + since)

    def stretches(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where these words' ids start, and how many they are."""
        starts = self.ends[numbers]
        return starts, self.ends[numbers + 1] - starts

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers one after another, and how many each has."""
        starts, lens = self.stretches(numbers)
        return self.ids[_places(starts, lens)], lens


def _places(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of stretches of an array, one stretch after another."""
    ends = np.cumsum(lens)
    places = np.repeat(starts - (ends - lens), lens)
    places += np.arange(len(places))
    return places


class WordEncoder:
    """Ids of whole texts, by a bounded memo of space-led words.

    The byte-level split starts a token at every space before a visible character, so the words
    between such spaces encode independently. Arrow cuts a batch of texts into words and finds the
    distinct ones, which are looked up once each, and the batch's ids are taken from the memo's in one
    go. New words are encoded together in one text and cut apart at the tokens that begin with a
    space; a comma or full stop after a Latin letter is a token of its own, so those words share their
    stem's ids. Texts with a space before a space or an end are encoded as they are. The memo has two
    generations of at most `most` / 2 words (of 16 bytes on average) and one batch each; words in use move on.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.led = np.zeros(max(vocab.values()) + 2, bool)
        for token, i in vocab.items():
            self.led[i] = token.startswith("Ġ")
        self.most, self.memo, self.old = most, Words(), Words()
        self.stops = {c: x[0] for c, x in zip(",.", self.whole([",", "."]))}

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        ids, lens = [], []
        for lo in range(0, len(words), 200):  # longer texts take more time for each word
            some = words[lo : lo + 200]
            part = np.array(self.whole([" " + " ".join(some)])[0], np.uint32)
            starts = np.flatnonzero(self.led[part])
            if len(starts) != len(some):  # cannot be: each word holds one space, at its start
                raise AssertionError("words and tokens disagree")
            ids.append(part)
            lens.append(np.diff(starts, append=len(part)))
        if words:
            self.memo.add(pa.array(words, pa.large_string()), np.concatenate(ids), np.concatenate(lens))

    def _need(self, new: pa.Array) -> None:
        """Put words that aren't in the memo there, but none that is empty or begins with another space."""
        if len(self.old.words):
            numbers = self.old.numbers(new)
            again = numbers >= 0
            self.memo.add(new.filter(pa.array(again)), *self.old.of(numbers[again]))
            new = new.filter(pa.array(~again))
        words = [w for w in new.to_pylist() if w and not w[0].isspace()]
        stopped = [w for w in words if w[-1] in ",." and "A" <= w[-2:-1] < "\u0250" and w[-2].isalpha()]
        rest = set(words).difference(stopped)
        stems = pa.array([w[:-1] for w in stopped], pa.large_string())
        numbers, before = self.memo.numbers(stems), len(self.memo.words)
        unknown = stems.filter(pa.array(numbers < 0))
        self._learn([*rest, *(set(unknown.to_pylist()) - rest)])
        if stopped:
            numbers[numbers < 0] = self.memo.numbers(unknown, before)
            ids, lens = self.memo.of(numbers)
            self.memo.add(pa.array(stopped, pa.large_string()), np.insert(ids, np.cumsum(lens), [self.stops[w[-1]] for w in stopped]), lens + 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null) one after another, and where each text's ids end."""
        if len(self.memo.words) > self.most // 2 or self.memo.words.nbytes > 8 * self.most:
            self.memo, self.old = Words(), self.memo
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy()
        first, offsets = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        coded = split.flatten().dictionary_encode()
        del split
        codes, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_string())
        # Words that follow a space: all but the first of each text.
        follows = np.ones(len(codes), bool)
        follows[first] = False
        used = np.zeros(len(words), bool)
        used[codes[follows]] = True
        numbers, before = self.memo.numbers(words), len(self.memo.words)
        missing = np.flatnonzero(used & (numbers < 0))
        new = words.take(pa.array(missing))
        self._need(new)
        numbers[missing] = self.memo.numbers(new, before)
        numbers = numbers[codes]
        starts, lens = self.memo.stretches(numbers)
        strange = np.add.reduceat(follows & (numbers < 0), first) > 0 if len(first) else np.zeros(0, bool)
        # The first words, and strange texts as a whole, are encoded as they are.
        heads = self.whole([texts[i].as_py() if x else words[int(codes[k])].as_py() for i, (k, x) in enumerate(zip(first.tolist(), strange.tolist()))])
        lens[np.repeat(strange, offsets - first)] = 0
        sizes = np.array([len(h) for h in heads], np.int64)
        starts[first], lens[first] = len(self.memo.ids) + np.cumsum(sizes) - sizes, sizes
        pool = np.concatenate([self.memo.ids, np.fromiter((i for h in heads for i in h), np.uint32, sizes.sum())])
        return pool[_places(starts, lens)], np.cumsum(lens)[offsets - 1]


def _batches(texts: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together stay near most_bytes."""
    at, ends = 0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
        yield at, to
        at = to


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row for each piece of at most `capacity` tokens; only the first piece of a cut document is shorter."""
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        encoder = cache.get(tokenizer_path) or cache.setdefault(tokenizer_path, WordEncoder(tokenizer_path))
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in _batches(texts):
                ids, ends = encoder.encode(texts.slice(lo, hi - lo))
                ids = np.insert(ids, ends, END_ID).astype("<u4", copy=False)
                sizes = np.diff(ends, prepend=0) + 1
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = sizes - (n - 1) * capacity
                length = np.where(piece == 0, head[row], capacity)
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                to = np.cumsum(length)
                cuts, data = list(zip(((to - length) * 4).tolist(), (to * 4).tolist())), memoryview(ids.tobytes())
                columns = [
                    batch.column(0).slice(lo, hi - lo).take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(data[a:b]) for a, b in cuts], pa.int64()),
                    *([pa.array([bytes(data[a:b]) for a, b in cuts], pa.binary())] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class Step(NamedTuple):
    length: int
    rank: int  # of the first piece of this length that the step places
    bin: int  # where that piece goes; the next ones go to the next bins
    offset: int


def plan(
    counts: dict[int, int],
    capacity: int,
    most_docs: int,
    most_cost: float,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    score: str = "norm",
) -> list[Step]:
    """Place all counted lengths into as few bins as best-fit finds, longest first.

    A bin has room for `capacity` tokens, `most_docs` pieces and an attention cost (sum of squared
    lengths) of `most_cost`. Of the states that fit under all three, the one with the smallest
    weighted norm of what would be left ("norm") or the largest weighted product of item and
    residual ("dot") gets the items. Every single item must fit an empty bin.
    """
    w, full = np.array(weights), np.array([capacity, most_docs, most_cost], float)
    left = np.zeros((0, 3))  # residuals of each open state
    ranges: list[list[tuple[int, int]]] = []  # its bins
    at: dict[tuple, int] = {}
    steps, bins = [], 0

    def add(residual: np.ndarray, lo: int, hi: int) -> None:
        nonlocal left
        key = tuple(residual)
        if key not in at:
            at[key] = len(ranges)
            ranges.append([])
            left = np.vstack([left, residual])
        ranges[at[key]].append((lo, hi))

    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, float(length) ** 2])
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        rank, n = 0, counts[length]
        while rank < n:
            fits = (left >= item).all(axis=1)
            if fits.any():
                after = (left - item) / full
                value = (w * after**2).sum(axis=1) if score == "norm" else -(w * item / full * left / full).sum(axis=1)
                k = int(np.where(fits, value, np.inf).argmin())
                lo, hi = ranges[k].pop()
                residual = left[k].copy()
                if not ranges[k]:
                    del at[tuple(residual)]
                    last = len(ranges) - 1
                    if k != last:
                        at[tuple(left[last])] = k
                        ranges[k], left[k] = ranges[last], left[last]
                    ranges.pop()
                    left = left[:last]
            else:
                residual, lo = full.copy(), bins
                bins = hi = bins + n - rank
            m = min(hi - lo, n - rank)
            steps.append(Step(length, rank, lo, int(capacity - residual[0])))
            if m < hi - lo:
                add(residual, lo + m, hi)
            if residual[0] > length:
                add(residual - item, lo, lo + m)
            rank += m
    return steps


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 1024,
    most_docs: int | None = None,
    most_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    score: str = "norm",
    with_ids: bool = False,
    rows_per_salt: int = 20_000,
) -> DataFrame:
    """Pieces of all documents with sequence_id and offset (gapless from 0 in each sequence).

    most_docs and most_cost default to what `capacity` tokens can hold at most, so they only bind where
    they are given; their residuals count in the score in any case. The pieces are
    written once to the shared folder, as they are needed for the histogram and for the result.
    """
    spark = docs.sparkSession
    found = pieces(docs, tokenizer_path, capacity=capacity, with_ids=with_ids)
    # A number of its own for each row, stored with it, spreads rows that are equal in all else.
    own = written(found.withColumn("nth", F.monotonically_increasing_id()))
    lengths = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    steps = plan(lengths, capacity, most_docs or capacity, most_cost or float(capacity) ** 2, weights, score)
    salts = max(64, sum(lengths.values()) // rows_per_salt)
    salted = own.withColumn("salt", F.pmod(F.xxhash64("nth"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("number", number).join(base, ["length", "salt"])
    ranked = ranked.select(*found.columns, (F.col("base") + F.col("number") - 1).alias("rank"))
    sent = spark.sparkContext.broadcast(_by_length(steps))  # bounded by lengths times states, not by rows
    kept = found.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                where = np.flatnonzero(length == x)
                starts, first, offset = plans[int(x)]
                k = np.searchsorted(starts, rank[where], "right") - 1
                bins[where], offsets[where] = first[k] + rank[where] - starts[k], offset[k]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bins), pa.array(offsets)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def _by_length(steps: list[Step]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out: dict[int, list[Step]] = {}
    for s in steps:
        out.setdefault(s.length, []).append(s)
    return {k: tuple(np.array([x[i] for x in v], np.int64) for i in (1, 2, 3)) for k, v in out.items()}


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {"op9_best_fit_packing": op9_best_fit_packing}


def oracle_sql() -> dict:
    return {}

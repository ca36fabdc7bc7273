"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are cut into the matches of the tokenizer's pattern where they are read. A stretch of rows with
some megabytes of text becomes one row: its distinct words, once each, and the order in which its
documents hold them. Spark folds the ranked merges over the bytes of each distinct word and joins the
binary pieces of its ids again; a last pass puts ids and bytes of the words in each document's order.
All of it is one stage: nothing is shuffled, broadcast, collected or written, so hot rows, frequent
words and lost executors cost what any other row or task costs, and work grows with the text.

Each round of the fold merges the adjacent pair of lowest rank, in all places of the word, from its
left: that equals one merge at a time, because in ranks whose tokens all encode to themselves no merge
makes a pair of lower rank than its own, and a token arises from one pair of parts only. `merges`
checks that of the ranks and derives the pair of each token. So a run of one letter takes rounds by
the logarithm of its length. A long word without such runs, as a text in letters without any space or
mark, takes a round for each merge and so time in the square of its length.

The rank map is a literal of two arrays, the sparse table of pairs with its rows laid into one
another: a pair is looked up by two places, where Spark would search a map's keys one after another.

Null text counts as empty and gives no ids; texts and words of any length are encoded whole.
Repeated rows and null ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.session import table

#: Stands before and behind the bytes of a word.
MARK = 256
#: A round of a word with at least so many parts merges its pair in all places; of a shorter one, in the leftmost.
SHORT = 64
#: Characters of text in a stretch of rows, about: its distinct words are folded once. A longer document is a stretch of its own.
STRETCH = 1_500_000
#: Words that a task remembers at most, and those of one stretch more; then it keeps up to half of them, those met most
#: often (twice at least), and a word that it let go and meets again is folded again.
MOST_WORDS = 350_000
#: A part's number in the fold: its id, from bit TOKEN on the token of its pair, from bit LEFT on what must be zero.
TOKEN, LEFT = 20, 40
ID_MASK = (1 << TOKEN) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _characters(text: Column) -> Column:
    """A split at the empty pattern would search each character from the text's start."""
    return F.regexp_extract_all(text, F.lit("."), F.lit(0))


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(id, id) of the two parts that each token of several bytes arises from, and its own id."""
    if any(bytes([b]) not in ranks for b in range(256)) or max(ranks.values()) >= ID_MASK:
        raise ValueError("each byte must be a token, and ids must be below a million")
    out: dict[tuple[int, int], int] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            least, at = min((out.get(p, rank), i) for i, p in enumerate(zip(parts, parts[1:])))
            if least >= rank:
                break
            parts[at : at + 2] = [least]
        if len(parts) > 2 or (len(parts) == 2 and max(parts) >= rank and len(token) > 2):
            raise ValueError(f"{token!r} doesn't arise from tokens of lower rank")
        if len(parts) == 2:
            out[parts[0], parts[1]] = rank
    return out


def table_of(pairs: dict[tuple[int, int], int], size: int) -> tuple[list[int], list[int]]:
    """(row of each left id, cells): the cell at row[left] ^ right holds left and the token, others no left id there is.

    Lefts with the most pairs are placed first, each at the next row number where its cells are free.
    """
    rows: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (a, b), token in pairs.items():
        rows[a].append((b, token))
    width = 1 << (2 * max(size, len(pairs))).bit_length()
    free, cells = np.ones(width, bool), np.full(width, 1 << 62, np.int64)
    row, first, before = [0] * size, 0, 0
    for a, some in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        at = np.array([b for b, _ in some])
        if len(some) != before:  # fewer cells may fit between those before
            first, before = 0, len(some)
        found = np.empty(0, np.int64)
        while not len(found):
            if first >= width:
                raise ValueError("no room for the table of pairs")
            tries = np.arange(first, min(width, first + max(64, 8192 // len(some))))
            found = tries[free[tries[:, None] ^ at].all(axis=1)]
            first = int(found[0]) if len(found) else int(tries[-1]) + 1
        row[a] = first
        free[first ^ at] = False
        cells[first ^ at] = (a << LEFT) | (np.array([t for _, t in some]) << TOKEN)
    return row, cells.tolist()


def _literal(values: list, kind: str) -> Column:
    """A constant array; the optimiser folds it once, where an array of literals would be as many expressions."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once (and, if it is a literal, stands in the plan once).

    A fold over no elements: unlike a transform's elements, its state is handed on without a copy.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda state, _: state, body)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal that fold() reads: the numbers of pairs of bytes, and the table of pairs of ids."""
    size = max(ranks.values()) + 2
    pairs = merges(ranks)
    row, cells = table_of(pairs, size)
    single = [*(ranks[bytes([b])] for b in range(256)), size - 1]  # the last is MARK
    first = [(pairs[a, b] << TOKEN) | a if (a, b) in pairs else (1 << 62) | a for a in single for b in single]
    fields = {"first": first, "row": row, "cells": cells}
    return F.struct(*(_literal(v, "bigint").alias(k) for k, v in fields.items()))


def _with(maps: Column, body) -> Column:
    """body of the function that folds a word; the arrays of the map are taken out of it once."""
    arrays = lambda m: _let(m["row"], lambda row: _let(m["cells"], lambda cells: _let(m["first"], lambda first: body(lambda w: _fold(w, first, row, cells)))))
    return _let(maps, arrays)


def fold(byte_pairs: Column, maps: Column) -> Column:
    """Ids of one word, as byte_pairs() gives its bytes; maps is what rank_map() returns."""
    return _with(maps, lambda fold_one: fold_one(byte_pairs))


def _fold(byte_pairs: Column, first: Column, row: Column, cells: Column) -> Column:
    """By ranked merges over the bytes; an empty word has no ids.

    The state is one number for each part: above its id stands the token that it and the next part
    merge to, and above that a remainder unless there is such a token. So the least number of all is
    a pair of the lowest rank, and its first place the leftmost of them.
    """
    mask, rest = F.lit(ID_MASK).cast("bigint"), F.lit(1 << 30)

    def link(a: Column, b: Column) -> Column:
        """The number of part a before part b; null if b is."""
        cell = F.get(cells, F.get(row, a).bitwiseXOR(b))
        return cell.bitwiseXOR(a * F.lit((1 << LEFT) + 1))

    def linked(ids: Column) -> Column:
        """Numbers of all ids but the last."""
        return F.array_compact(F.transform(ids, lambda x, i: link(x, F.get(ids, i + 1))))

    def once(s: Column, at: Column, token: Column) -> Column:
        """The pair at a place (from 1) merged; two numbers change."""
        before, after = (F.get(s, at + k).bitwiseAND(mask) for k in (-2, 1))
        new = F.array(link(before, token), link(token, after))
        return F.flatten(F.array(F.slice(s, F.lit(1), at - 2), new, F.slice(s, at + 2, rest)))

    def everywhere(s: Column, token: Column) -> Column:
        """All pairs that merge to the token merged; where they overlap (aaa), every other one of a run."""
        hits = F.array_join(F.transform(s, lambda x: F.when(F.shiftright(x, TOKEN) == token, "1").otherwise("0")), "")

        def parts(at: Column) -> Column:
            here = lambda x, i: F.when(F.get(at, i) == "1", token).when(F.coalesce(F.get(at, i - 1), F.lit("0")) == "0", x.bitwiseAND(mask))
            return F.concat(F.array_compact(F.transform(s, here)), F.array(F.get(s, F.lit(0)).bitwiseAND(mask)))  # a mark again

        return _let(_let(_characters(F.replace(hits, F.lit("11"), F.lit("10"))), parts), linked)

    def step(s: Column, _: Column) -> Column:
        done = F.flatten(F.array(F.array(F.lit(-1).cast("bigint")), F.slice(s, F.lit(2), rest)))  # rounds after the last look at one number only
        one = lambda least: _let(F.array_position(s, least).cast("int"), lambda at: once(s, at, F.shiftright(least, TOKEN)))
        merged = lambda least: F.when(F.size(s) < F.lit(SHORT), one(least)).otherwise(everywhere(s, F.shiftright(least, TOKEN)))
        more = _let(F.array_min(s), lambda least: F.when(least >= F.lit(1 << LEFT), done).otherwise(merged(least)))
        return F.when(F.get(s, F.lit(0)) < 0, s).otherwise(more)

    rounds = F.sequence(F.lit(4), F.greatest(F.size(byte_pairs), F.lit(4)))
    inner = lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(mask).cast("int"))
    return F.aggregate(rounds, F.transform(byte_pairs, lambda p: F.get(first, p)), step, inner)


def pieces(ranks: dict[bytes, int]) -> Column:
    """A literal array of each id's bytes, as hexadecimal digits."""
    hexed = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        hexed[rank] = token.hex()
    return _literal(hexed, "string")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: its binary pieces, one after another."""
    return _let(pieces(ranks), lambda p: _decoded(ids, p))


def _decoded(ids: Column, pieces: Column) -> Column:
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def _stretches(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of stretches of rows; one stretch is unpacked at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def byte_pairs(words: list[str]) -> pa.ListArray:
    """The adjacent bytes of each word's UTF-8 as numbers a * 257 + b, MARK before them and two MARKs behind."""
    column = pa.array(words, pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(words) + 1)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8, int(ends[-1]))
    marked = np.full(len(data) + 3 * len(words) + 1, MARK, np.int32)
    marked[np.arange(len(data)) + 1 + 3 * np.repeat(np.arange(len(words)), np.diff(ends))] = data
    pairs = marked[:-1] * (MARK + 1) + marked[1:]
    last = ends[1:] + 3 * np.arange(1, len(words) + 1) - 1  # the second MARK and the next word's first
    offsets = (ends + 2 * np.arange(len(words) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.delete(pairs, last)))


def cut(docs: DataFrame, pattern: str, stretch: int = STRETCH, most_words: int = MOST_WORDS) -> DataFrame:
    """Stretches of rows: their doc ids, where each text's words end in `order`, the numbers of the words, and the words that
    are new. Numbers count the task's distinct words. Once there are most_words of them, `kept` has the numbers of those that
    stay and are numbered anew in this order (else it is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words_of, seen, known = regex.compile(pattern).findall, defaultdict(), 0
        seen.default_factory = seen.__len__
        times = np.zeros(0, np.int64)  # that each word was met
        for batch in batches:
            for at, texts in _stretches(batch.column(1), stretch):
                kept = None
                if len(seen) >= most_words:
                    kept = np.argsort(-times, kind="stable")[: min(most_words // 2, int((times > 1).sum()))]
                    words = list(seen)
                    seen.clear()
                    for i in kept.tolist():
                        seen[words[i]]
                    del words
                    times, known = times[kept], len(seen)
                order, ends = array("i"), array("q")
                for text in texts:
                    order.extend(map(seen.__getitem__, words_of(text)))
                    ends.append(len(order))
                one = (
                    batch.column(0).slice(at, len(texts)),
                    pa.array(np.frombuffer(ends, np.int64)),
                    pa.array(np.frombuffer(order, np.int32)),
                    byte_pairs(list(islice(seen, known, None))),
                )
                known = len(seen)
                met = np.bincount(one[2].to_numpy(), minlength=known)
                met[: len(times)] += times
                times = met
                del texts
                columns = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in one]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([kept], pa.list_(pa.int32()))], names=["docs", "ends", "order", "words", "kept"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "docs array<long>, ends array<long>, order array<int>, words array<array<int>>, kept array<int>")


class Words:
    """What finish() knows of a task's words, by their numbers."""

    def __init__(self):
        self.sizes = np.empty(0, np.int32)  # ids of each word
        self.ids = pa.chunked_array([], pa.list_(pa.int32()))
        self.texts = pa.chunked_array([], pa.large_string())  # the ids, a space behind each
        self.bytes = pa.chunked_array([], pa.large_binary())

    def add(self, ids: pa.ListArray, data: pa.Array) -> None:
        ids = ids.cast(pa.list_(pa.int32()))
        text = pc.binary_join_element_wise(pc.binary_join(ids.cast(pa.list_(pa.string())), " "), "", " ")
        self.sizes = np.concatenate([self.sizes, pc.list_value_length(ids).to_numpy(zero_copy_only=False)])
        for name, more in (("ids", ids), ("texts", text.cast(pa.large_string())), ("bytes", data.cast(pa.large_binary()))):
            setattr(self, name, pa.chunked_array([pa.concat_arrays([*getattr(self, name).chunks, more])]))

    def keep(self, numbers: pa.Array) -> None:
        self.sizes = self.sizes[numbers.to_numpy()]
        for name in ("ids", "texts", "bytes"):
            setattr(self, name, getattr(self, name).take(numbers))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, with_ids: bool = False, stretch: int = STRETCH, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, and with_ids their ids as an array."""

    def words(fold_one, pieces: Column) -> Column:
        both = lambda ids: F.struct(ids.alias("ids"), _decoded(ids, pieces).alias("bytes"))
        return F.transform("words", lambda w: _let(fold_one(w), both))

    folded = _let(pieces(ranks), lambda p: _with(rank_map(ranks), lambda fold_one: words(fold_one, p)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests(column: pa.ChunkedArray, order: pa.Array, cuts: np.ndarray, less: int) -> list[str]:
            """Of each document's words one after another, without the last `less` bytes."""
            taken = column.take(order).combine_chunks()
            taken = taken if isinstance(taken, pa.Array) else pa.concat_arrays(taken.chunks or [pa.array([], column.type)])
            at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][cuts].tolist()
            data = memoryview(taken.buffers()[2] or b"")
            return [hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(at, at[1:])]

        spelt = Words()
        for batch in batches:
            for row in range(batch.num_rows):
                doc, ends, order, new = (batch.column(c)[row].values for c in ("docs", "ends", "order", "words"))
                if (kept := batch.column("kept")[row]).is_valid:
                    spelt.keep(kept.values)
                spelt.add(pc.struct_field(new, "ids"), pc.struct_field(new, "bytes"))
                cuts = np.concatenate([[0], ends.to_numpy()])
                tokens = np.concatenate([[0], np.cumsum(spelt.sizes[order.to_numpy()], dtype=np.int64)])[cuts]
                columns = [
                    doc,
                    pa.array(np.diff(tokens)),
                    pa.array(digests(spelt.texts, order, cuts, 1), pa.string()),
                    pa.array(digests(spelt.bytes, order, cuts, 0), pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), spelt.ids.take(order).combine_chunks().flatten()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                pa.default_memory_pool().release_unused()

    rows = cut(docs, pattern, stretch, most_words).withColumn("words", folded)
    return rows.mapInArrow(finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def queries() -> dict:
    return {"op2_byte_bpe": op2_byte_bpe}


def oracle_sql() -> dict:
    return {}

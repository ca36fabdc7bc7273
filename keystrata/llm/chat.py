"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole: `[INST] role [/INST]text</s>` for each turn, where control strings
in roles and texts are escaped by a backslash that reading back takes out again. The rendering is
encoded once, with offsets; the assistant's turns, as sorted spans, are intersected with the token
spans by binary search, which gives the token mask and the masked characters.

Turns are ordered by (turn, role, text), nulls first; null roles and texts count as empty, rows that
repeat are turns of their own, and rows without a conversation id form one conversation with a null
id. A conversation is one unit by nature and is gathered in one row. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import worker_cache
from keystrata.session import table

BEGIN, MIDDLE, END = "[INST] ", " [/INST]", "</s>"
CONTROL = re.compile(r"\\|[<\[](?=/?s>|/?INST\])")
TURNS = "array<struct<turn:long,role:string,text:string>>"
SCHEMA = "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    # A backslash was doubled, or put behind the first character of a control string.
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts that the loss covers."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role)}{MIDDLE}", escape(text)
        out += [head, body, END]
        if role == loss_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        middle = formatted.index(MIDDLE, at + len(BEGIN))
        end = formatted.index(END, middle + len(MIDDLE))
        turns.append((unescape(formatted[at + len(BEGIN) : middle]), unescape(formatted[middle + len(MIDDLE) : end])))
        at = end + len(END)
    return turns


def mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens meet a span, and the stretches of characters that such tokens cover inside the spans.

    starts and ends must be sorted; tokens that share a character (parts of one) may have equal spans.
    """
    hit, covered = np.zeros(len(starts), bool), []
    for start, end in spans:
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(starts, end, "left"))
        hit[lo:hi] = True
        for a, b in zip(np.maximum(starts[lo:hi], start).tolist(), np.minimum(ends[lo:hi], end).tolist()):
            if covered and a <= covered[-1][1]:
                covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
            elif a < b:
                covered.append((a, b))
    return hit, covered


def _tokenizer(path: str):
    cache = worker_cache()
    if ("chat", path) not in cache:
        from tokenizers import Tokenizer, processors

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        cache["chat", path] = tokenizer
    return cache["chat", path]


def format_chats(rows: DataFrame, tokenizer_path: str, *, loss_role: str = "assistant", batch: int = 64) -> DataFrame:
    """One row for each conversation: formatted text, token ids, token mask and masked character spans."""
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")))
    whole = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns.alias("turns"))
    types = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("formatted", pa.string()),
            ("ids", pa.list_(pa.int32())),
            ("loss_mask", pa.list_(pa.bool_())),
            ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, batch):
                part = whole_batch.slice(lo, batch)
                drawn = [render([(t["role"] or "", t["text"] or "") for t in x.as_py()], loss_role) for x in part.column(1)]
                out: list[list] = [[], [], [], []]
                for (text, spans), code in zip(drawn, tokenizer.encode_batch([d[0] for d in drawn], add_special_tokens=False)):
                    offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
                    hit, covered = mask(spans, offsets[:, 0], offsets[:, 1])
                    for column, value in zip(out, (text, code.ids, hit, [{"start": a, "end": b} for a, b in covered])):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t.type) for c, t in zip(out, list(types)[1:]))], schema=types)

    return whole.mapInArrow(run, SCHEMA)


def digests(chats: DataFrame) -> DataFrame:
    """What a reader gets back from formatted conversations: turns and masked text, as digests."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in range(3))):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                row = (conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return chats.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)


CONTROL_CHAT = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_CHAT), (-1, 1, "assistant", CONTROL_CHAT)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


SQL = rf"""
with r as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, 0, 'user', '{CONTROL_CHAT}' union all select -1, 1, 'assistant', '{CONTROL_CHAT}'),
e as (select *, length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g'))
  + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g')) + {len(BEGIN + MIDDLE + END)} n from r)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(n) as bigint) formatted_chars from e group by conv_id"""


def queries() -> dict:
    return {"op4_chat_format": op4_chat_format}


def oracle_sql() -> dict:
    return {"op4_chat_format": SQL}

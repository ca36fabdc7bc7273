"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols by a lexicon; transducers rewrite the symbols of a clause and weigh their arcs.
`reported` moves what is said to be said, or stands in quotes, to symbols of its own; `negated` does
so for what stands just behind a negation; `threat` needs an intent before a threatening verb, and
`target` sees whether the clause names somebody. They are composed into one machine, whose arcs hold
the arcs of all of them; a text's score is the logistic sum of its path's weights over all matched
clauses, those that hold an insult or a threat. Unmatched clauses weigh nothing.

The lexicon is learned: words, and beginnings of words, that stand in toxic training documents
significantly more often than chance, weighted by the logarithm of their smoothed odds. The weights of
the arcs' kinds are learned after it, by logistic regression over labelled documents that stays near
preset weights where the documents say nothing. Words of the other symbols are fixed lists. Copies of a document say nothing
new, so of labelled documents with an equal sketch one counts. Counting is combined in each batch
before it is shuffled; scoring is one Arrow pass over whole texts.

Null text counts as empty and scores the base rate. Labels with a null id or class are not used; if a
document has several, the largest counts. Without labels only threats score. Repeated rows and null
ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.session import table

#: Labelled documents that train lexicon and weights, at most; taken by the hash of their id.
MOST_LABELLED = 40_000
# The words of the symbols that aren't learned.
TARGETS = frozenset("you your yours u they them she he him her his these those toi vous tu te ton votre ihr euch dich du dein eure tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never isn aren wasn weren don doesn neither nor without pas jamais ni sans nicht kein keine nie ohne jamás nunca sin tampoco".split())
REPORTS = frozenset("said says say wrote writes claimed claims called reported reports quoted quote alleged according dit écrit selon sagte sagt schrieb laut dijo dice escribió según".split())
THREATS = frozenset("kill killing murder strangle stab shoot slaughter tuer tuerai assassiner töten umbringen ermorden matar mataré asesinar".split())
INTENTS = frozenset("will ll shall gonna going must vais allons werde werden voy vamos".split())
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”«»]")
ENDS, QUOTES = frozenset(".!?;\n"), frozenset("\"“”«»")
SYMBOL_OF = {
    w: symbol
    for symbol, words in (("end", ENDS), ("quote", QUOTES), ("target", TARGETS), ("intent", INTENTS), ("report", REPORTS), ("negation", NEGATIONS), ("threat", THREATS))
    for w in words
}
SYMBOLS = ("insult", "threat", "menace", "target", "negation", "report", "intent", "quote", "end", "other", "insult/said", "menace/said", "insult/not", "menace/not", "threat/said", "threat/not")
#: Shortest and longest beginning of a word that the lexicon may hold.
STEMS = (5, 10)
REACH = 3  # words that a negation or an intent reaches
#: Weights of the kinds of arcs before labels are seen. Those of SCALED kinds multiply the word's own weight.
SCALED = frozenset({"insult", "negated", "reported"})
PRESET = {"insult": 1.0, "negated": -0.8, "reported": -0.7, "targeted": 1.0, "menace": 5.0, "verb": 0.5, "negated menace": -4.0, "reported menace": -3.0}


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) to (next state, symbol written, kinds of the arc); any other symbol is copied and leads to `other` of the state."""

    start: object
    arcs: dict
    other: dict = field(default_factory=dict)

    def step(self, state, symbol: str) -> tuple[object, str, tuple[str, ...]]:
        return self.arcs.get((state, symbol)) or (self.other.get(state, state), symbol, ())

    def states(self) -> set:
        return {self.start, *(x[0] for x in self.arcs.values()), *self.other.values()}


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that reads what `a` reads and writes what `b` writes of a's output; only states that can be reached."""
    start, arcs = (a.start, b.start), {}
    todo, seen = [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            one, between, kinds = a.step(state[0], symbol)
            two, out, more = b.step(state[1], between)
            arcs[state, symbol] = (one, two), out, kinds + more
            if (one, two) not in seen:
                seen.add((one, two))
                todo.append((one, two))
    return Transducer(start, arcs)


def reported() -> Transducer:
    """After a word of saying, until the clause ends, and between quotes, insults and menaces are somebody else's."""
    arcs = {}
    for said in (False, True):
        for quoted in (False, True):
            state = (said, quoted)
            arcs[state, "report"] = (True, quoted), "report", ()
            arcs[state, "quote"] = (said, not quoted), "quote", ()
            arcs[state, "end"] = (False, quoted), "end", ()
            if said or quoted:
                for x in ("insult", "threat"):
                    arcs[state, x] = state, f"{x}/said", ()
    return Transducer((False, False), arcs)


def negated() -> Transducer:
    """The words that a negation reaches."""
    arcs, other = {}, {}
    for left in range(REACH + 1):
        arcs[left, "negation"] = REACH, "negation", ()
        arcs[left, "end"] = 0, "end", ()
        other[left] = max(0, left - 1)
        if left:
            for x in ("insult", "threat"):
                arcs[left, x] = left - 1, f"{x}/not", ()
    return Transducer(0, arcs, other)


def threat() -> Transducer:
    """A threatening verb within an intent's reach is a menace."""
    arcs, other = {}, {}
    for left in range(REACH + 1):
        arcs[left, "intent"] = REACH, "intent", ()
        arcs[left, "end"] = 0, "end", ()
        other[left] = max(0, left - 1)
        for mark in ("", "/said", "/not"):
            arcs[left, "threat" + mark] = max(0, left - 1), ("menace" if left else "other") + mark * bool(left), () if left or mark else ("verb",)
    return Transducer(0, arcs, other)


def insult() -> Transducer:
    """Weights of insults and menaces by how they are meant; all are written as matches."""
    marks = {"": (), "/said": ("reported",), "/not": ("negated",)}
    arcs = {(0, "insult" + m): (0, "insult", ("insult", *k)) for m, k in marks.items()}
    arcs |= {(0, "menace" + m): (0, "insult", ("menace", *(f"{x} menace" for x in k))) for m, k in marks.items()}
    return Transducer(0, arcs)


def target() -> Transducer:
    """Once in a clause that holds a match and names somebody, in either order."""
    arcs = {("none", "target"): ("named", "target", ()), ("none", "insult"): ("hit", "insult", ())}
    arcs |= {("named", "insult"): ("both", "insult", ("targeted",)), ("hit", "target"): ("both", "target", ("targeted",))}
    arcs |= {(s, "end"): ("none", "end", ()) for s in ("none", "named", "hit", "both")}
    return Transducer("none", arcs)


PARTS = {"reported": reported, "negated": negated, "threat": threat, "insult": insult, "target": target}


@lru_cache
def grammar_of(parts: tuple[str, ...] = tuple(PARTS)) -> Transducer:
    """The parts composed, in their order."""
    return reduce(compose, (PARTS[p]() for p in parts))


@dataclass
class Grammar:
    """A learned lexicon, weights of the kinds of arcs, and the parts that are composed."""

    insults: dict[str, float] = field(default_factory=dict)  # words, and beginnings of words with a hyphen behind
    bias: float = -3.9
    weights: dict[str, float] = field(default_factory=lambda: dict(PRESET))
    parts: tuple[str, ...] = tuple(PARTS)

    @property
    def base(self) -> float:
        """The score of texts without any match."""
        return 1 / (1 + math.exp(-self.bias))

    def weight(self, word: str) -> float:
        """Of a word, or of its longest beginning that the lexicon holds."""
        for k in (0, *range(min(len(word), STEMS[1]), STEMS[0] - 1, -1)):
            if (w := self.insults.get(f"{word[:k]}-" if k else word)) is not None:
                return w
        return 0.0

    def kinds(self, text: str) -> Counter:
        """How often the text's path takes each kind of arc; SCALED kinds by the words' own weights."""
        machine = grammar_of(self.parts)
        state, arcs, out, known = machine.start, machine.arcs, Counter(), {}
        for token in TOKEN.findall(text.lower()):
            if (found := known.get(token)) is None:
                found = known[token] = self._symbol(token)
            state, _, kinds = arcs[state, found[0]]
            for kind in kinds:
                out[kind] += found[1] if kind in SCALED else 1.0
        return out

    def _symbol(self, token: str) -> tuple[str, float]:
        if token not in SYMBOL_OF and (w := self.weight(token)):
            return "insult", w
        return SYMBOL_OF.get(token, "other"), 1.0

    def logit(self, kinds: Counter) -> float:
        """Targets and context never outweigh the lack of any match."""
        return self.bias + max(0.0, sum(self.weights[k] * n for k, n in kinds.items()))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-min(500.0, self.logit(self.kinds(text)))))


def _entries(text: str) -> set[str]:
    """Words of a text and their beginnings, as the lexicon would hold them; not where they are negated or reported."""
    words, machine = set(), grammar_of(("reported", "negated"))
    state, arcs = machine.start, machine.arcs
    for token in TOKEN.findall(text.lower()):
        symbol = SYMBOL_OF.get(token, "insult")
        state, out, _ = arcs[state, symbol]
        if out == "insult" and len(token) > 1:
            words.add(token)
    return words | {f"{w[:k]}-" for w in words for k in range(STEMS[0], min(len(w), STEMS[1]) + 1)}


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most `most` labelled documents; of those with the same least hash of three words, one."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # `most` rows bound it
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, F.lit(3))))
    rows = rows.withColumn("words", words).withColumn("sketch", F.array_min(shingles))
    one = F.min_by(F.struct("text", "toxic"), F.struct("doc_id", F.xxhash64("text"))).alias("one")
    return rows.groupBy("sketch").agg(one).select("one.text", F.col("one.toxic").cast("int").alias("toxic"))


def _lexicon(rows: DataFrame, *, least_evidence: float, least_precision: float, smoothing: float) -> tuple[dict[str, float], float]:
    """Entries with their weights, and the rate of toxic documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both[toxic == 1].update(_entries(text or ""))
                both[toxic == 1][""] += 1  # the documents
            words = list(both[0].keys() | both[1].keys())
            columns = [pa.array(words), *(pa.array([c[w] for w in words], pa.int64()) for c in both)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "clean", "toxic"])

    counts = rows.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # An entry needs some toxic documents, and more toxic than clean ones, to weigh anything: what is collected is a bounded sample's few.
    found = {r["word"]: (r["c"], r["t"]) for r in counts.where("word = '' or (t >= 4 and t > c)").collect()}
    clean, toxic = found.pop("", (0, 0))
    rate = min(0.99, max(0.01, toxic / max(1, clean + toxic)))
    kept: dict[str, float] = {}
    # Shortest beginnings first: a longer one is only kept if none of it is.
    for word, (c, t) in sorted(found.items(), key=lambda x: (len(x[0]), x[0])):
        n, p = c + t, t / (c + t)
        divergence = p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0.0)
        covered = any(f"{word[:k]}-" in kept for k in range(STEMS[0], len(word.rstrip("-"))))
        if p >= max(rate, least_precision) and n * divergence >= least_evidence and not covered:
            kept[word] = math.log((t + smoothing * rate) / (c + smoothing * (1 - rate)) * (1 - rate) / rate)
    return kept, rate


def _fit(x: np.ndarray, y: np.ndarray, preset: np.ndarray, tightness: float, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last column is the bias, and weights are drawn to their preset."""
    w = preset.copy()
    pull = np.append(np.full(len(w) - 1, tightness), tightness)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - preset))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    most: int = MOST_LABELLED,
    least_evidence: float = 14.0,
    least_precision: float = 0.8,
    smoothing: float = 1.0,
    tightness: float = 8.0,
    parts: tuple[str, ...] = tuple(PARTS),
) -> Grammar:
    """Lexicon and weights from labelled rows (doc_id, toxic).

    least_evidence: number of documents with the entry times the divergence (in nats) of its toxic
    share from the overall share; 14 is a chance of about one in a million.
    """
    rows = _sample(docs, labels, most)
    insults, rate = _lexicon(rows, least_evidence=least_evidence, least_precision=least_precision, smoothing=smoothing)
    grammar = Grammar(insults, parts=parts)
    names = list(PRESET)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [(*(k[n] for n in names), float(y == 1)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in [grammar.kinds(t or "")]]
            columns = [pa.array([r[i] for r in some], pa.float64()) for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(len(names))), "y"])

    fields = ", ".join(f"k{i} double" for i in range(len(names)))
    # Equal paths are one row with a count: texts without a match are all alike.
    same = rows.mapInArrow(paths, f"{fields}, y double").groupBy(*(f"k{i}" for i in range(len(names))), "y").agg(F.count("*").alias("n"))
    got = np.array(sorted(tuple(map(float, r)) for r in same.collect()), float)  # `most` rows at most
    if not len(got) or not insults:
        return grammar
    n = got[:, -1]
    x = np.column_stack([got[:, : len(names)], np.ones(len(got))])
    preset = np.array([*PRESET.values(), math.log(rate / (1 - rate)) - 1.5])
    w = _fit(np.repeat(x, n.astype(int), axis=0), np.repeat(got[:, -2], n.astype(int)), preset, tightness)
    # Contexts may weaken or strengthen as preset, never turn about: a negated insult is no praise.
    grammar.weights = {k: float(max(v, 0) if PRESET[k] > 0 else min(v, 0)) for k, v in zip(names, w)}
    grammar.bias = float(w[-1])
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score) for each row of docs; the grammar is as large as its bounded sample's lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [grammar.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def _held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = learn(docs, table(spark, sf_dir, "labels").where(~_held_out(F.col("doc_id"))))
    out = score(docs, grammar).withColumn("held_out", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict:
    return {"op7_toxicity": op7_toxicity}


def oracle_sql() -> dict:
    return {}

"""Quality rules: a decision list learned from labelled text statistics, applied as Spark conditions.

Statistics are built-in expressions over whole texts. A bounded sample of labelled documents trains
the list by sequential covering: a rule grows threshold by threshold on two thirds of the sample
while that raises its gain, is pruned from its end on the other third, and what it covers is taken
out before the next rule grows. Rules that are not precise enough on the pruning part end the
search. The list becomes one ordered conditional expression, so applying it is a projection.

Null and empty texts have no words and fail the base rule. Documents with a null or repeated id are
judged row by row; labels with a null id or class are not used, and if a document has several labels
the largest counts. Without labels the list is empty and only the base rule rejects. Any further
columns pass through keep() untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.session import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Labelled documents that train the list, at most; taken by the hash of their id.
MOST_LABELLED = 20_000
STATISTICS = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "mean_line")


def _repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""
    n = F.size(words)
    windows = F.when(n < 5, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, F.lit(5))))
    )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(z: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(z, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(z, k + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.array_compact(F.transform(z, lambda x, k: F.when(same(x, k), x["i"]))))

        steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5))))
        at = lambda p: F.aggregate(steps(p), F.lit(0), lambda a, b: a + b)
        return _let(_let(ordered, marked), at)

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the struct `stats`: base counts and the rates that rules use."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    split = F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    prepared = _once(docs, "_split", split)
    words, lines = F.col("_split.words"), F.col("_split.lines")
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated(words).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    s = F.col("_counts")
    rate = lambda a, b: F.coalesce(F.try_divide(s[a].cast("double"), s[b].cast("double")), F.lit(0.0))
    full = F.struct(
        *(s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        rate("word_chars", "n_words").alias("mean_word"),
        rate("n_symbols", "word_chars").alias("symbol_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("n_words", "n_lines").alias("mean_line"),
    )
    return _once(_once(prepared, "_counts", counts), "stats", full).drop("_split", "_counts")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """value as a column that later expressions read instead of repeating: projections don't merge over a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (stats["n_repeat_words"] * 100 > stats["n_words"] * 20)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, `<=` or `>`, threshold) that rejects a document."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, sign, value in self.conditions:
            column = x[:, names.index(name)]
            out &= column <= value if sign == "<=" else column > value
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, sign, value in self.conditions:
            out = out & (stats[name] <= value if sign == "<=" else stats[name] > value)
        return out


def learn(
    x: np.ndarray,
    bad: np.ndarray,
    names: tuple[str, ...] = STATISTICS,
    *,
    most_rules: int = 12,
    most_conditions: int = 4,
    least_precision: float = 0.75,
    least_cover: int = 8,
    cuts: int = 40,
) -> list[Rule]:
    """Ordered rules that reject rows like those of `bad`; every third row prunes."""
    part = np.arange(len(x)) % 3 == 2
    todo = np.ones(len(x), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules and (todo & bad).any():
        rule = _grow(x[todo & ~part], bad[todo & ~part], names, most_conditions, cuts)
        held, truth = x[todo & part], bad[todo & part]
        rule = max(
            (Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)),
            key=lambda r: _worth(r.holds(held, names), truth),
            default=rule,
        )
        hit = rule.holds(held, names)
        seen = rule.holds(x, names) & todo
        if not rule.conditions or hit.sum() < least_cover // 2 or seen.sum() < least_cover or truth[hit].mean() < least_precision or bad[seen].mean() < least_precision:
            break
        rules.append(rule)
        todo &= ~seen
    return rules


def _worth(hit: np.ndarray, truth: np.ndarray) -> float:
    p = int((hit & truth).sum())
    n = int(hit.sum()) - p
    return (p - n) / (p + n + 1)


def _grow(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...], most: int, cuts: int) -> Rule:
    """Add the threshold of the largest gain (positives kept times bits won) until none is left."""
    rule, inside = Rule(()), np.ones(len(x), bool)
    while len(rule.conditions) < most:
        p0, all0 = (inside & bad).sum(), inside.sum()
        if not p0 or p0 == all0:
            break
        best, gain = None, 1e-9
        for j, name in enumerate(names):
            values = x[inside, j]
            hits = bad[inside]
            for cut in np.unique(np.quantile(values, np.linspace(0.005, 0.995, cuts))):
                for sign, mask in (("<=", values <= cut), (">", values > cut)):
                    n = mask.sum()
                    p = (mask & hits).sum()
                    won = p * (np.log2(p / n) - np.log2(p0 / all0)) if p else -1.0
                    if won > gain:
                        best, gain = (name, sign, float(cut)), won
        if best is None:
            break
        # Halfway to the next value, so that a boundary isn't drawn along one side's values.
        values = x[inside, names.index(best[0])]
        best = (*best[:2], float(values[values <= best[2]].max() + values[values > best[2]].min()) / 2)
        rule = Rule((*rule.conditions, best))
        inside &= Rule((best,)).holds(x, names)
    return rule


def train(docs: DataFrame, labels: DataFrame, *, most: int = MOST_LABELLED, **options) -> list[Rule]:
    """The decision list from `quality` labels (0 rejects) of at most `most` documents."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))  # `most` rows, so the bound is known
    got = rows.where(~base_failed(F.col("stats"))).select("doc_id", "quality", *(F.col(f"stats.{n}") for n in STATISTICS))
    # Repeated ids could exceed `most`: which rows count must not depend on scheduling.
    data = sorted(got.orderBy(F.xxhash64(*got.columns), *got.columns).limit(most).collect(), key=lambda r: tuple(r))
    if not data:
        return []
    x = np.array([[float(v) for v in r[2:]] for r in data])
    return learn(x, np.array([r["quality"] == 0 for r in data]), **options)


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """True where the document stays: no base failure and no rule of the list holds."""
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(stats), F.lit(False))
    return out.otherwise(F.lit(True))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the list keeps, with their own columns, whatever their names."""
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    return statistics(whole, "row.text").where(verdict(F.col("stats"), rules)).select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, table(spark, sf_dir, "labels"))
    s = F.col("stats")
    base = [s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return statistics(docs).select("doc_id", *base, base_failed(s).alias("base_failed"), verdict(s, rules).alias("kept"))


def queries() -> dict:
    return {"op5_quality_rules": op5_quality_rules}


def oracle_sql() -> dict:
    return {}

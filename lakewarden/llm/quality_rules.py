"""Quality rules whose thresholds are chosen on labelled holdouts with a bounded risk.

Measures of a text: word_chars, n_symbols, n_dup_lines, n_repeat_words and n_words, and from them
four rates (symbols per word, repeated lines per line with a word, repeated words per word, letters
per word), each with a grid of cutoffs.

For every stratum and rule a false rejection is a document labelled good that a cutoff turns down.
The cutoffs of a rule are tested from the laxest on; a cutoff is safe if the exact (Clopper-
Pearson) upper bound of its false rejection rate is at most `risk`. Tests of a rule stop at the
first cutoff that fails, and rates only grow along a grid, so at most one test of a rule can go
wrong: the one of the first cutoff that exceeds the risk. The error allowed, `alpha`, is therefore
divided by strata x rules, not by cutoffs, and with probability 1 - alpha no chosen cutoff of any
stratum exceeds the risk. Of the safe cutoffs the strictest is taken that turns down
at least as many documents labelled bad as good ones, so no rule costs more than it brings; a rule
without one is not used in that stratum. `risk` is the bound per rule; a stratum's rules together
reject at most RULES times it.

Strata are the values of a column. A value has its own cutoffs if its labelled good documents are
enough to pass the bound at all, that is with no false rejection; how many this takes follows from
risk, alpha and the number of strata (297 for four strata, 228 at least), of which there may be any
number. Smaller values share pooled cutoffs, tested on their labels together or, where
these are too few as well, on those of all strata; the latter are not used for values without a
good label, of which nothing is known. Null is a value like others. Counts come from all labelled rows:
they are histograms over the grids, and cutoffs are rows of a table that is joined to the documents.

Defined results: a null text has no words and fails the base rule. Rows that share a doc_id are
each judged; their labels count once per row. Labels without a document, or null, are ignored; with
no labels at all only the base rule works. Extra columns are passed through by `judge`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.text import rows_of, texts_of
from lakewarden.operators.keyed import lookup_join
from lakewarden.sources.store import staged

RISK = 0.02
ALPHA = 0.05
_NULL = "\0"  # stands for null

_SYMBOL = re.compile(rb"[#*$%&|<>]")
_LATER = re.compile(rb"[\x80-\xBF]")  # every byte of a character but its first
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rate that is bad when high (sign 1) or low (sign -1), and its grid, laxest first."""

    name: str
    part: str
    whole: str
    sign: int
    grid: tuple[float, ...]


RULES = (
    Rule("symbols_per_word", "n_symbols", "n_words", 1, tuple(np.arange(40, 0, -1) / 20)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 1, tuple(np.arange(19, 0, -1) / 20)),
    Rule("repeated_words", "n_repeat_words", "n_words", 1, tuple(np.arange(20, 0, -1) / 40)),
    Rule("long_words", "word_chars", "n_words", 1, tuple(np.arange(30, 5, -1) / 1.0)),
    Rule("short_words", "word_chars", "n_words", -1, tuple(np.arange(2, 13) / 4)),
)


def measure(text: bytes) -> tuple[int, ...]:
    """The measures of one text, exact."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - (0 if text.isascii() else len(_LATER.findall(text)))
    symbols = len(_SYMBOL.findall(text))
    lines = duplicates = 0
    seen = set()
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        counts = Counter(triples)
        upto = 0
        for i, triple in enumerate(triples):
            if counts[triple] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return n, chars, symbols, lines, duplicates, repeated


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the measures, and columns to keep."""
    kept = docs.select(*keep).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for _, texts in rows_of([batch]) for t in texts]
            columns = {"doc_id": batch.column("doc_id")}
            for i, name in enumerate(MEASURES):
                columns[name] = pa.array([row[i] for row in found], pa.int64())
            columns.update({c: batch.column(c) for c in keep})
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)
    for field in kept.fields:
        schema += f", `{field.name}` {field.dataType.simpleString()}"
    return texts_of(docs, *keep).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _value(stratum: str) -> Column:
    return F.coalesce(F.col(stratum).cast("string"), F.lit(_NULL))


def _rate(rule: Rule) -> Column:
    return F.when(F.col(rule.whole) > 0, F.col(rule.part) / F.col(rule.whole))


def _strictness(rule: Rule) -> Column:
    """How many cutoffs of the grid turn the document down from the strict end: 0 is none."""
    hits = [F.when(_rate(rule) * rule.sign > cut * rule.sign, 1).otherwise(0) for cut in rule.grid]
    return sum(hits[1:], hits[0])


def _log_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) of a binomial, summed downwards until terms no longer count."""
    first = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
             + k * math.log(p) + (n - k) * math.log1p(-p))
    term = total = 1.0
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-18 * total:
            break
    return first + math.log(total)


def bounded(k: int, n: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound of a rate seen k times in n is at most `risk`.

    That is so if seeing at most k would have a probability of at most `error` at that rate.
    """
    if n == 0 or k >= risk * n:
        return False
    return _log_tail(k, n, risk) <= math.log(error)


def least_size(tests: int, risk: float, alpha: float) -> int:
    """The fewest good documents with which a cutoff without a false rejection is bounded."""
    n = max(1, math.ceil(math.log(alpha / tests) / math.log1p(-risk)) - 1)
    while not bounded(0, n, risk, alpha / tests):
        n += 1
    return n


def _own_from(histogram: dict[int, int], tests_of_one: int, risk: float, alpha: float) -> int | None:
    """The size from which a value is a stratum of its own, given how many values have which size.

    The more strata, the more good labels each of them takes; the smallest size counts for which this
    works out. None: there is no such size.
    """
    sizes = sorted(n for n in histogram if n > 0)
    for at, size in enumerate(sizes):
        strata = sum(histogram[n] for n in sizes[at:]) + (at > 0)
        if size >= least_size(strata * tests_of_one, risk, alpha):
            return size
    return None


def _chosen(hits: dict[int, int], junk: dict[int, int], rule: Rule, risk: float,
            error: float) -> float | None:
    """The cutoff of one rule in one stratum, from how many documents have which strictness."""
    n, found = sum(hits.values()), None
    for i, cut in enumerate(rule.grid):  # cutoff i turns down all with len(grid) - i hits
        rejected, caught = (sum(c for h, c in of.items() if h >= len(rule.grid) - i)
                            for of in (hits, junk))
        if not bounded(rejected, n, risk, error):
            break
        if caught and caught >= rejected:
            found = float(cut)
    return found


def cutoffs(labelled: DataFrame, stratum: str, risk: float = RISK, alpha: float = ALPHA,
            rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, dict[str, float]]:
    """Cutoffs by value from the measures of documents with a label `good`, and those for other values.

    The rows are (stratum, one column per rule, null where the rule is not used), one for each value that
    has cutoffs other than the rest. Strata stay rows: each is worked out by itself from its counts. Only a
    histogram of sizes and the pooled counts, both of bounded length, come to the driver.
    """
    # A long format of (stratum, rule, strictness) with counts of either label, made map-side.
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), _strictness(r).alias("hits"))
                               for r in rules]))
    counts = (labelled.where(~base_failed())
              .select(_value(stratum).alias("stratum"), "good", each.alias("x"))
              .groupBy("stratum", "x.rule", "x.hits")
              .agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("bad")))
    counts = staged(counts, "label-counts")
    sizes = counts.where(F.col("rule") == rules[0].name).groupBy(F.col("stratum").alias("of")).agg(
        F.sum("n").alias("size"))
    # More good labels than this are enough for 10**12 strata.
    ample = least_size(10**12 * len(rules), risk, alpha)
    histogram = {r["s"]: r["n"] for r in sizes.groupBy(F.least("size", F.lit(ample)).alias("s"))
                 .agg(F.count("*").alias("n")).collect()}
    own_from = _own_from(histogram, len(rules), risk, alpha)
    own = F.lit(False) if own_from is None else F.col("size") >= own_from
    sized = counts.join(sizes, F.col("stratum") == F.col("of")).drop("of").withColumn("own", own)
    strata = sum(n for s, n in histogram.items() if own_from is not None and s >= own_from)
    small = sized.where("NOT own").groupBy("rule", "hits").agg(F.sum("n").alias("n"),
                                                               F.sum("bad").alias("bad")).collect()
    rest = sum(r["n"] for r in small if r["rule"] == rules[0].name)
    error = alpha / max(1, (strata + (rest > 0)) * len(rules))
    of_all = 0 < rest < least_size((strata + 1) * len(rules), risk, alpha)
    if of_all:
        small = counts.groupBy("rule", "hits").agg(F.sum("n").alias("n"),
                                                   F.sum("bad").alias("bad")).collect()
    pooled = {}
    for rule in rules:
        mine = [r for r in small if r["rule"] == rule.name]
        cut = _chosen({r["hits"]: r["n"] for r in mine}, {r["hits"]: r["bad"] for r in mine}, rule,
                      risk, error)
        if cut is not None:
            pooled[rule.name] = cut

    def of_stratum(table: pa.Table) -> pa.Table:
        columns: dict[str, list] = {"stratum": [table["stratum"][0].as_py()]}
        rows = table.to_pylist()
        for rule in rules:
            mine = [r for r in rows if r["rule"] == rule.name]
            columns[rule.name] = [_chosen({r["hits"]: r["n"] for r in mine},
                                          {r["hits"]: r["bad"] for r in mine}, rule, risk, error)]
        return pa.table({c: pa.array(v, pa.string() if c == "stratum" else pa.float64())
                         for c, v in columns.items()})

    schema = "stratum string, " + ", ".join(f"{r.name} double" for r in rules)
    # A group is as long as the grids of all rules together at most.
    table = sized.where("own").select("stratum", "rule", "hits", "n", "bad").groupBy(
        "stratum").applyInArrow(of_stratum, schema)
    if of_all:  # these are for the few values that have a good label
        shared = [F.lit(pooled.get(r.name)).cast("double").alias(r.name) for r in rules]
        table = table.unionByName(sizes.join(sized.where("own").select("stratum").distinct(),
                                             F.col("of") == F.col("stratum"), "left_anti")
                                  .where("size > 0").select(F.col("of").alias("stratum"), *shared))
        pooled = {}
    return table, pooled


def with_verdict(found: DataFrame, stratum: str, table: DataFrame, pooled: dict[str, float],
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `passed`: false for documents that a cutoff turns down. A value may hold most rows."""
    sides = table.select(F.col("stratum").alias("__of"),
                         *[F.col(r.name).alias(f"__cut_{r.name}") for r in rules])
    joined = lookup_join(found.withColumn("__value", _value(stratum)), sides, "__value", "__of", "left")
    bad = F.lit(False)
    for rule in rules:
        cut = F.when(F.col("__of").isNull(), F.lit(pooled.get(rule.name)).cast("double")).otherwise(
            F.col(f"__cut_{rule.name}"))
        bad = bad | F.coalesce(_rate(rule) * rule.sign > cut * rule.sign, F.lit(False))
    return joined.withColumn("passed", ~bad).drop("__value", *sides.columns)


def judge(docs: DataFrame, labels: DataFrame, work: str, *, stratum: str = "lang",
          risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """doc_id, the measures, base_failed and kept. `work` is a fresh shared folder."""
    measured(docs.withColumn("__stratum", F.col(stratum).cast("string")), "__stratum") \
        .write.parquet(f"{work}/measures")
    found = docs.sparkSession.read.parquet(f"{work}/measures")
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good")
    ).distinct()
    table, pooled = cutoffs(found.join(marks, "doc_id"), "__stratum", risk, alpha)
    table.write.parquet(f"{work}/cutoffs")
    table = docs.sparkSession.read.parquet(f"{work}/cutoffs")
    failed = base_failed()
    return with_verdict(found, "__stratum", table, pooled).withColumn("base_failed", failed).withColumn(
        "kept", ~failed & F.col("passed")).drop("__stratum", "passed")

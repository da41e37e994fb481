"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on a bounded sample of labelled rows, every path in them becomes a conjunctive rule, a lasso
logistic regression keeps the few rules that matter, and what is left is compiled into Spark column expressions,
so scoring is a projection over the documents and nothing more."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.llm.common import cut, words

FIT_ROWS = 20_000  # labelled rows that the classifier is fitted on, at most
TREES, DEPTH = 24, 4
LASSO = 0.001

#: Statistics that are shares of the characters, by the characters they count.
SHARES = {
    "symbols": r"[#$%&*+/<=>@\\^_`{|}~\[\]]",
    "capitals": r"\p{Lu}",
    "digits": r"[0-9]",
    "exclaims": r"[!?]",
    "stops": r"[.,;:]",
    "lines": r"\n",
}
NAMES = [*SHARES, "log_chars", "log_words", "word_length", "repeats", "distinct", "longest_word"]


def _word_facts(text: Column) -> Column:
    """(many, repeats, distinct, longest) of the words of a text. The words are bound once, as the one element of an
    array: named inside a lambda, their expression would be worked out again for every word."""
    facts = lambda ws: F.struct(
        F.size(ws).alias("many"),
        F.size(F.filter(ws, lambda w, i: (i > 0) & (w == F.get(ws, i - 1)))).alias("repeats"),
        F.size(F.array_distinct(ws)).alias("distinct"),
        F.coalesce(F.array_max(F.transform(ws, F.char_length)), F.lit(0)).alias("longest"),
    )
    return F.transform(F.array(words(text)), facts)[0]


def statistics(df: DataFrame, text: Column) -> DataFrame:
    """df with one double column st_<name> for each of NAMES. A null text counts as empty; of an empty text all are 0."""
    n, w = F.char_length("_t"), F.col("_w")
    over = lambda count, total: F.when(total > 0, count / total).otherwise(0.0)
    out = df.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_w", _word_facts(F.col("_t")))
    made = {k: over(F.regexp_count("_t", F.lit(p)), n) for k, p in SHARES.items()} | {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(w["many"].cast("double")),
        "word_length": over(n - w["many"], w["many"]),
        "repeats": over(w["repeats"], w["many"]),
        "distinct": over(w["distinct"], w["many"]),
        "longest_word": w["longest"],
    }
    return out.withColumns({f"st_{k}": made[k].cast("double") for k in NAMES}).drop("_t", "_w")


@dataclass(frozen=True)
class Rule:
    """A conjunction: (feature, low, high) with low < statistic <= high."""

    parts: tuple[tuple[int, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for f, low, high in self.parts:
            at = F.col(f"st_{NAMES[f]}")
            if low > -math.inf:
                out = out & (at > F.lit(low))
            if high < math.inf:
                out = out & (at <= F.lit(high))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{low:.4g} < {NAMES[f]} <= {high:.4g}" for f, low, high in self.parts)


def tree_rules(debug: str) -> list[Rule]:
    """The rule of every node below the roots in a printed forest."""
    out: dict[Rule, None] = {}
    path: list[tuple[int, dict]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth, f, at = len(m[1]), int(m[2]), float(m[4])
        while path and path[-1][0] >= depth:
            path.pop()
        box = dict(path[-1][1]) if path else {}
        low, high = box.get(f, (-math.inf, math.inf))
        box[f] = (low, min(high, at)) if m[3] == "<=" else (max(low, at), high)
        path.append((depth, box))
        out[Rule(tuple((k, *box[k]) for k in sorted(box)))] = None
    return list(out)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Of columns st_*: the probability of label 1."""
        margin = F.lit(self.intercept)
        for rule, weight in self.weights:
            margin = margin + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def held_out(id_: Column) -> Column:
    """Rows that are never learned from; a null id is learned from neither, having no label."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, seed: int = 7) -> Ensemble:
    """Learn from at most fit_rows labelled rows outside the held-out third, chosen by a hash of the id.

    Labels other than 0 and 1 are passed over. With fewer than two classes or ten rows the score is the smoothed
    share of label 1 (one half without labels)."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
    chosen = chosen.filter(F.col("_id").isNotNull() & F.col("_label").isin(0.0, 1.0) & ~held_out(F.col("_id")))
    chosen = chosen.orderBy(F.xxhash64("_id", F.lit(seed)), "_id", "_label").limit(fit_rows)
    # bounded by fit_rows, so broadcast: the documents need not be shuffled
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = cut(statistics(rows, F.col("_text")).select("_label", *[f"st_{k}" for k in NAMES]), "quality-fit")
    count = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    n, ones = sum(count.values()), count.get(1.0, 0)
    if n < 10 or len(count) < 2:
        share = (ones + 0.5) / (n + 1)
        return Ensemble(math.log(share / (1 - share)), ())
    table = VectorAssembler(inputCols=[f"st_{k}" for k in NAMES], outputCol="_x").transform(rows)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=max(2, n // 500), subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=seed).fit(table)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        share = (ones + 0.5) / (n + 1)
        return Ensemble(math.log(share / (1 - share)), ())
    held = rows.select("_label", F.array(*[r.column().cast("double") for r in rules]).alias("_r"))
    from pyspark.ml.functions import array_to_vector

    held = cut(held, "quality-rules").select("_label", array_to_vector("_r").alias("_x"))
    lasso = LogisticRegression(featuresCol="_x", labelCol="_label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60, aggregationDepth=2).fit(held)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if abs(w) > 1e-6]
    return Ensemble(float(lasso.intercept), tuple(weights))


def score(df: DataFrame, model: Ensemble, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with score_col, 0 to 1. A null text counts as empty and gets a score too; rows that repeat are scored
    alike; an empty table stays empty. A column of df with that name is replaced, and columns of the names that
    are used within (_t, _w, st_*) are kept as they were."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text_col).alias("_text"))
    scored = statistics(packed, F.col("_text")).withColumn("_score", model.score())
    return scored.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c != score_col], F.col("_score").alias(score_col))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of df: id_col, held_out, score, predicted."""
    model = fit(df, labels, id_col, text_col)
    out = score(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

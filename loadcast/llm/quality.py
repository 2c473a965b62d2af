"""Quality rules: a learned decision list over interpretable text measures.

Every document gets base measures (words, symbols, repeated lines, repeated
three-word windows) and shares made from them.  From labelled documents a
decision list is learned by sequential covering: a rule grows one threshold
condition at a time by information gain on the growing part of the labels, is
pruned on the other part, and takes the rows it covers away.  The list becomes
one ordered CASE expression.  Only counts by (measure, bin, label) leave the
executors: measures x bins x 2 numbers per step, whatever the corpus holds.

Defined results: a null text has no words, so it fails the base test and is not
kept; documents without a label take part in everything but the learning;
several labels of one document all count; without labels of both classes the
list is empty and the base test alone decides; empty tables give empty tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.llm.text import BLANK, words
from loadcast.sources.scratch import materialize

# Fixed values of the base test.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MEASURES = ("symbol_share", "dup_line_share", "repeat_share", "mean_word_chars", "upper_share", "punct_share", "digit_share", "n_words")
BINS = 32
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.8
MIN_COVER = 5


def repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted as numbers whose high bits are a hash and whose low bits
    are the position; neighbours that share a hash are compared by their words.
    """
    n = F.size(w)
    bits = F.greatest(F.length(F.bin(n.cast("long"))), F.lit(1))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    tagged = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(-low).bitwiseOR(i.cast("long")),
    )

    def same(p: Column, q: Column) -> Column:
        alike = lambda d: F.get(w, p + d) == F.get(w, q + d)
        return alike(0) & alike(1) & alike(2)

    def repeated(s: Column) -> Column:
        place = lambda x: x.bitwiseAND(low - 1).cast("int")
        meets = lambda x, y: (x.bitwiseAND(-low) == y.bitwiseAND(-low)) & same(place(x), place(y))
        hit = F.filter(s, lambda x, i: meets(x, F.get(s, i - 1)) | meets(x, F.get(s, i + 1)))
        return F.array_sort(F.transform(hit, place))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, i: F.coalesce(F.least(F.get(at, i + 1) - p, F.lit(3)), F.lit(3))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    return _let(F.sort_array(tagged), lambda s: _let(repeated(s), covered))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, the base measures and what the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    count = lambda chars: F.length("_dense") - F.length(F.translate("_dense", chars, ""))
    base = (
        docs.select(*keep, text.alias("_text"), words(text).alias("_words"), lines.alias("_lines"))
        .withColumn("_dense", F.array_join("_words", ""))
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length("_dense").cast("long"),
                "n_symbols": count(SYMBOLS).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": F.when(F.size("_words") < 4, F.lit(0)).otherwise(repeat_words(F.col("_words"))).cast("long"),
                "n_upper": F.length("_dense") - F.length(F.regexp_replace("_dense", "[A-Z]+", "")),
                "n_digit": F.length("_dense") - F.length(F.regexp_replace("_dense", "[0-9]+", "")),
                "n_punct": F.length("_dense") - F.length(F.regexp_replace("_dense", r"[!?.,;:]+", "")),
                "n_lines": F.size("_lines"),
            }
        )
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    measures = F.struct(
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_punct", "word_chars").alias("punct_share"),
        share("n_digit", "word_chars").alias("digit_share"),
    )
    # A generator, so that a filter on the measures is not pushed below and computes them again for each condition.
    return base.select(*keep, F.inline(F.array(measures)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


@dataclass(frozen=True)
class Condition:
    """measure > cut (above) or measure <= cut."""

    measure: str
    above: bool
    cut: float

    def expression(self) -> Column:
        value = F.col(self.measure)
        return value > self.cut if self.above else value <= self.cut


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def expression(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.expression()
        return out


def covered_by(rules: list[Rule]) -> Column:
    """True where an ordered list of rejecting rules takes a row."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        out = out.when(rule.expression(), F.lit(True))
    return out.otherwise(F.lit(False))


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: approximate quantiles over all labelled rows, so bins hold similar counts."""
    steps = F.array(*[F.lit(i / BINS) for i in range(BINS + 1)])
    found = rows.agg(*[F.percentile_approx(F.col(m).cast("double"), steps, 1000).alias(m) for m in MEASURES]).first()
    cuts = {m: sorted(set(found[m] or ())) for m in MEASURES}
    return {m: [(x + y) / 2 for x, y in zip(v, v[1:])] for m, v in cuts.items()}


def _counts(rows: DataFrame, cuts: dict[str, list[float]], where: Column) -> dict[str, dict[int, list[int]]]:
    """Per measure and bin: rows with a bad and with a good label."""
    def at(m: str) -> Column:
        over = F.filter(F.array(*[F.lit(c) for c in cuts[m]]), lambda c: F.col(m) > c)
        return F.struct(F.lit(m).alias("measure"), F.size(over).alias("bin"))

    bins = [at(m) for m in MEASURES if cuts[m]]
    if not bins:
        return {}
    counted = rows.filter(where).select("bad", F.explode(F.array(*bins)).alias("at")).groupBy("at.measure", "at.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("all"))
    out: dict[str, dict[int, list[int]]] = {}
    for r in counted.collect():  # measures x bins rows at most
        out.setdefault(r["measure"], {})[r["bin"]] = [r["bad"], r["all"] - r["bad"]]
    return out


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    if not bad:
        return -1.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _best(stats: dict[str, dict[int, list[int]]], cuts: dict[str, list[float]]) -> tuple[float, Condition] | None:
    best = None
    for m in MEASURES:
        if m not in stats:
            continue
        bad0, good0 = (sum(v[i] for v in stats[m].values()) for i in (0, 1))
        if not bad0 or not good0:
            return None
        for k, cut in enumerate(cuts[m]):
            over = [sum(v[i] for b, v in stats[m].items() if b > k) for i in (0, 1)]
            for above, (bad, good) in ((True, over), (False, [bad0 - over[0], good0 - over[1]])):
                if bad >= MIN_COVER and (best is None or _gain(bad, good, bad0, good0) > best[0]):
                    best = (_gain(bad, good, bad0, good0), Condition(m, above, cut))
    return best if best and best[0] > 0 else None


def learn(labelled: DataFrame) -> list[Rule]:
    """Rejecting rules, in order.  ``labelled``: MEASURES, bad (0 or 1), part (0 prunes, others grow)."""
    cuts = _cuts(labelled)
    rules: list[Rule] = []
    grows = F.col("part") != 0
    while len(rules) < MAX_RULES:
        left = ~covered_by(rules) if rules else F.lit(True)
        conditions: tuple[Condition, ...] = ()
        while len(conditions) < MAX_CONDITIONS:
            found = _best(_counts(labelled, cuts, left & grows & Rule(conditions).expression()), cuts)
            if not found:
                break
            conditions += (found[1],)
        if not conditions:
            break
        lengths = range(1, len(conditions) + 1)
        hit = [Rule(conditions[:k]).expression() for k in lengths]
        sums = [F.sum(F.when(h, F.col("bad"))).alias(f"bad{k}") for k, h in zip(lengths, hit)]
        sums += [F.count(F.when(h, 1)).alias(f"all{k}") for k, h in zip(lengths, hit)]
        seen = labelled.filter(left & ~grows).agg(*sums).first()
        scores = [((seen[f"bad{k}"] or 0) + 1, seen[f"all{k}"] + 2) for k in lengths]
        length = max(lengths, key=lambda k: (scores[k - 1][0] / scores[k - 1][1], -k))
        bad, every = scores[length - 1]
        if bad / every < MIN_PRECISION:
            break
        rules.append(Rule(conditions[:length]))
    return rules


def labelled_rows(measures: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.filter("quality is not null").select(F.col("doc_id").alias("_id"), (1 - F.col("quality")).alias("bad"))
    part = (F.crc32(F.col("_id").cast("string").cast("binary")) % 3).alias("part")
    return measures.filter(~base_failed()).join(marks, F.col("doc_id") == F.col("_id")).select(*MEASURES, "bad", part)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept."""
    measures = materialize(measured(docs, "doc_id"), "quality")
    rules = learn(materialize(labelled_rows(measures, labels), "labelled"))
    return measures.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~covered_by(rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base test and the learned list, with all their columns.

    Labelled documents are measured first, to learn; then one pass filters all.
    """
    known = docs.join(labels.filter("quality is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    rules = learn(materialize(labelled_rows(measured(known, "doc_id"), labels), "labelled"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    kept = measured(whole, "_doc").filter(~base_failed() & ~covered_by(rules))
    return kept.select("_doc.*")

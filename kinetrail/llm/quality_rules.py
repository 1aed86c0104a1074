"""Quality rules as a short-circuit cascade of native expressions.

Every rule is a Catalyst predicate on the whole text. Each rule's cost, with the features that it needs, and selectivity
are measured on one bounded sample, and the rules are ordered by rejections per second, so that most bad texts meet one
cheap test. The order changes the time only: a text is kept when no rule rejects it, whatever comes first. keep_good
computes a feature only where its rule is reached; quality_rules returns the features and so computes them all.

Defined cases: a null text has no words and fails the base rule; an empty text likewise; a null doc_id is carried
through; repeated rows are judged one by one; an empty table gives an empty result. Columns of the input other than the
id and the text are read by no rule, so names that clash with the features are harmless; one named `__quality` is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def blanked(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def covered(windows: Column, width: int) -> Column:
    """Words under windows (strings by position) that occur twice or more."""
    keyed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeats(a: Column) -> Column:
        n = F.size(a)
        at = lambda k: F.get(a, k)["x"]  # noqa: E731  null outside of the array
        same = lambda k: F.coalesce(at(k - 1) == at(k), F.lit(False)) | F.coalesce(at(k + 1) == at(k), F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), same), lambda k: F.get(a, k)["i"]))

    return F.aggregate(
        let(keyed, repeats),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + width - F.greatest(i, acc["end"])).alias("n"), (i + width).alias("end")),
        lambda acc: acc["n"],
    )


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words in windows of width words that the text has twice or more. Distinct hashes settle most texts; the rest compares the strings themselves."""

    def count(w: Column) -> Column:
        n = F.size(w) - (width - 1)
        at = F.sequence(F.lit(0), n - 1)
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        exact = covered(F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)])), width)
        return F.when(n < 2, 0).when(F.size(F.array_distinct(hashes)) == n, 0).otherwise(exact)

    return let(words, count)


def parts(text: Column, words: Column, blank: Column) -> dict[str, Column]:
    """The features of a text as expressions, of which only those that are used are computed."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" " + SPACES))) > 0)
    return {
        "words": words,
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(without(blank, " ")).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


def with_parts(text: Column, body) -> Column:
    """body(parts of the text). Everything is bound inside one expression, so that no optimiser rule copies the splitting of a text into several places."""
    t = F.coalesce(text, F.lit(""))
    return let(let(blanked(t), lambda b: F.struct(b.alias("b"), F.array_remove(F.split(b, " "), "").alias("w"))), lambda s: body(parts(t, s["w"], s["b"])))


def features(text: Column) -> Column:
    """The features of a text as one struct."""
    return with_parts(text, lambda f: F.struct(*[x.alias(name) for name, x in f.items()]))


def base_failed(f) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


@dataclass(frozen=True)
class Rule:
    """rejects: from the features of a text, by name, to a predicate, true for a bad text."""

    name: str
    rejects: Callable


def default_rules() -> list[Rule]:
    return [
        Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 14 * f["n_words"])),
        Rule("symbols", lambda f: 10 * f["n_symbols"] > f["n_words"]),
        Rule("repeated_lines", lambda f: let(f["lines"], lambda x: 10 * x["dup"] > 3 * x["n"])),
        Rule("capitals", lambda f: 2 * F.size(F.filter(f["words"], lambda x: (F.upper(x) == x) & (F.lower(x) != x))) > f["n_words"]),
        Rule("no_letters", lambda f: 10 * F.size(F.filter(f["words"], lambda x: F.lower(x) != F.upper(x))) < 7 * f["n_words"]),
    ]


def base_rules() -> list[Rule]:
    return [Rule("few_words", lambda f: f["n_words"] < 50), Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"])]


def sampled(docs: DataFrame, text: str, sample_rows: int, seed: int) -> DataFrame:
    n = docs.count()
    return docs.select(F.col(text).alias("t")).sample(fraction=min(1.0, 2 * sample_rows / max(1, n)), seed=seed).limit(sample_rows)


def order_rules(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """rules by rejections per second on the texts (column `t`) of sample, best first; ties keep the given order. What a rule
    costs beyond the splitting into words, which all share, includes its features."""

    def run(body):
        began = time.perf_counter()
        row = sample.agg(F.count(F.lit(1)), F.sum(with_parts(F.col("t"), body).cast("long"))).first()
        return time.perf_counter() - began, row

    run(lambda f: f["n_words"] < 0)
    idle = min(run(lambda f: f["n_words"] < 0)[0] for _ in range(2))
    rates = []
    for rule in rules:
        took, row = run(rule.rejects)
        rates.append(((row[1] or 0) / max(1, row[0])) / max(1e-3, took - idle))
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -rates[i])]


def ordered(docs: DataFrame, text: str, rules: Sequence[Rule], sample_rows: int, seed: int) -> list[Rule]:
    if len(rules) < 2:
        return list(rules)
    sample = sampled(docs, text, sample_rows, seed).persist()
    rules = order_rules(sample, rules)
    sample.unpersist()
    return rules


def quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = 1000, seed: int = 17) -> DataFrame:
    """docs' own columns, with the features and verdict as one struct column `__quality`:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    sample_rows bounds the sample that the rules' order is estimated on; it has no influence on any row's verdict.
    """
    rules = ordered(docs, text, default_rules() if rules is None else rules, sample_rows, seed)

    def judge(f: Column) -> Column:
        verdict = F.when(base_failed(f), False)
        for rule in rules:
            verdict = verdict.when(rule.rejects(f), False)
        columns = [f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")] + [f["lines"]["dup"].alias("n_dup_lines"), f["n_repeat_words"].alias("n_repeat_words")]
        return F.struct(*columns, base_failed(f).alias("base_failed"), verdict.otherwise(True).alias("kept"))

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "__quality"], let(features(F.col(text)), judge).alias("__quality"))


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = 1000, seed: int = 17) -> DataFrame:
    """docs without the rejected rows, same columns. The base rule's two halves are rules of the cascade like the others."""
    cascade = ordered(docs, text, [*base_rules(), *(default_rules() if rules is None else rules)], sample_rows, seed)

    def kept(f) -> Column:
        verdict = F.when(cascade[0].rejects(f), False)
        for rule in cascade[1:]:
            verdict = verdict.when(rule.rejects(f), False)
        return verdict.otherwise(True)

    return docs.where(with_parts(F.col(text), kept))

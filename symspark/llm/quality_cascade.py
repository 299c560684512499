"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a boolean expression that is true where a text fails. On a bounded sample the rules' costs
(time to evaluate) and selectivities (share of texts that fail) are estimated; the cascade asks them in
the order of most rejections per cost and stops at the first that rejects. The order changes the work,
never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import save

SPACES = " \t\n\x0b\x0c\r"
#: Rows of the sample that costs and selectivities are measured on.
SAMPLE = 2000
#: Times that a measuring pass evaluates a rule on each sampled row.
REPEATS = 20
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named test over the columns `text`, `words` and those of with_counts(); true where the text fails."""

    name: str
    fails: Callable[[], Column]


def with_counts(docs: DataFrame) -> DataFrame:
    """The documents with words, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    words: runs without ASCII whitespace; a null or blank text has none. n_repeat_words: words inside
    windows of WINDOW words that occur twice or more in the text, compared by 64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    docs = docs.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    docs = docs.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("_w", F.transform(starts, lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(WINDOW)))))
    # only texts with a repeated window sort theirs: (hash, place), so that equal windows stand together
    placed = F.sort_array(F.transform("_w", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    docs = docs.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), placed))
    twice = F.filter("_s", lambda x, i: x["v"].eqNullSafe(F.get("_s", i - 1)["v"]) | x["v"].eqNullSafe(F.get("_s", i + 1)["v"]))
    docs = docs.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_p", none, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_h", "_w", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _letters(pattern: str) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), pattern, "")).cast("long")


#: Thresholds leave ordinary prose a wide margin.
RULES = (
    Rule("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 25 * F.col("n_words"))),
    Rule("repeated_lines", lambda: 10 * F.col("n_dup_lines") > 5 * F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))),
    Rule("capitals", lambda: 2 * _letters("[^A-Z]+") > _letters("[^A-Za-z]+")),
    Rule("distinct_words", lambda: F.pow(F.size(F.array_distinct("words")), F.lit(2)) < F.size("words")),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """Each rule with its cost in seconds a row and the share of texts it rejects, on the `sample` rows with the least id hash.

    A cost is what evaluating the rule adds to a pass over the saved sample, each row REPEATS times over so that starting
    the job doesn't drown it; the better of two passes counts. Rows without a doc_id aren't in the sample; repeated ones are.
    """
    ids = docs.select("doc_id", F.xxhash64("doc_id").alias("o")).orderBy("o", "doc_id").limit(sample).select("doc_id").distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(save(ids, "quality-ids")), "doc_id", "left_semi")
    rows = save(with_counts(rows), "quality-sample")
    total = rows.count()
    shares = rows.agg(*(F.count_if(r.fails()).alias(r.name) for r in rules)).first()
    many = rows.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def passes(*tests: Column) -> float:
        took = []
        for _ in range(2):
            start = time.perf_counter()
            many.agg(F.max("_again"), *(F.count_if(t) for t in tests)).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    bare = passes()
    return [(r, max(passes(r.fails()) - bare, 1e-3) / max(total * REPEATS, 1), shares[r.name] / max(total, 1)) for r in rules]


def cascade_order(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by rejection per cost, the best first; equals keep their order."""
    return [rule for rule, _, _ in sorted(measured, key=lambda m: -m[2] / m[1])]


def apply_cascade(docs: DataFrame, ordered: list[Rule]) -> DataFrame:
    """with_counts(docs) and base_failed, kept and rejected_by (the first rule of the order that rejects, else null)."""
    counted = with_counts(docs).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in ordered:
        verdict = verdict.when(rule.fails(), F.lit(rule.name))
    return counted.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of each document.

    Null and empty texts have no words and fail the base rule; rows with a null or repeated doc_id are judged each; an empty
    table gives an empty one; other columns are ignored. One pass without a shuffle, after the sample.
    """
    done = apply_cascade(docs.select("doc_id", "text"), cascade_order(measure(docs, rules, sample)))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

"""Quality rules on single documents: a table of thresholds compiled into one projection.

Every measure is an expression of built-in functions, linear in the text's length but for one
sort, and no row leaves its task: there is no shuffle and no user function. Repeated five-word
windows are found by hash within the document; positions are sorted only in documents where
some window comes twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import SPACE_RUN, SPACES, as_text

WINDOW = 5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "als auch auf das dem den der des die ein eine es für im ist mit nicht sich und von zu "
    "au avec dans de du elle en est et la le les par pas pour que qui sur un une "
    "al con del el las lo los no para por se su y").split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` lies below ``low`` or above ``high``; measures over nothing are null and pass."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are SQL over the columns of ``measure_texts``.
RULES = (
    Rule("word_count", "n_words", low=10),
    Rule("word_length", "try_divide(word_chars, n_words)", low=2.5, high=12),
    Rule("symbols_to_words", "try_divide(n_symbols, n_words)", high=0.1),
    # a clean text of a dozen words may hold no function word
    Rule("stop_words", "if(n_words >= 20, n_stop_words / n_words, null)", low=0.05),
    Rule("repeated_lines", "try_divide(n_dup_lines, n_lines)", high=0.4),
    Rule("repeated_words", "try_divide(n_repeat_words, n_words)", high=0.2),
)


def measure_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all input columns) with the counts that rules use.

    ``n_words``; ``word_chars`` (code points in words); ``n_symbols`` (of ``#*$%&|<>``);
    ``n_lines`` (with a word); ``n_dup_lines`` (equal to an earlier line); ``n_stop_words``;
    ``n_repeat_words`` (words in a five-word window found twice or more, the first included).
    A null or empty text counts nothing. Rows are measured one by one, so ties, repeated rows and
    empty tables need no care, and input names cannot clash with the counts.
    """
    body = F.col("body")
    df = df.select(F.struct("*").alias("row")).withColumn("body", as_text(F.col("row").getField(text)))
    trimmed = F.trim(body, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    df = df.select("row", "body", words.alias("words"), lines.alias("lines"))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    last = F.size("words") - WINDOW
    hashes = F.expr(f"transform(sequence(0, n_words - {WINDOW}), i -> xxhash64({', '.join(f'words[i + {k}]' for k in range(WINDOW))}))")
    df = df.withColumn("hashes", F.when(last >= 1, hashes))
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.withColumn("sorted", F.when(twice, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    repeated = F.expr("""array_sort(transform(filter(sequence(0, size(sorted) - 1),
        j -> (j > 0 AND sorted[j].h = sorted[greatest(j - 1, 0)].h) OR (j < size(sorted) - 1 AND sorted[j].h = sorted[least(j + 1, size(sorted) - 1)].h)),
        j -> sorted[j].at))""")
    df = df.withColumn("starts", F.when(F.col("sorted").isNotNull(), repeated))
    covered = F.expr(f"aggregate(sequence(1, size(starts)), 0, (n, k) -> n + if(k < size(starts), least({WINDOW}, starts[least(k, size(starts) - 1)] - starts[k - 1]), {WINDOW}))")
    stop = F.size(F.filter("words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:")).isin(STOP_WORDS)))
    measured = F.struct(
        "row", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        stop.cast("long").alias("n_stop_words"),
        F.when(F.col("starts").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))
    # a filter on the counts would otherwise be pushed below the steps they are made in, and repeat them per array element
    return df.select(F.inline(F.array(measured)))


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a measured row fails, as one array expression."""

    def fails(r: Rule) -> Column:
        value = F.expr(r.measure)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | F.coalesce(value < r.low, F.lit(False))
        if r.high is not None:
            bad = bad | F.coalesce(value > r.high, F.lit(False))
        return F.when(bad, F.lit(r.name))

    return F.array_compact(F.array(*[fails(r) for r in rules]))


def judge_texts(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measure_texts`` with ``base_failed`` (too few words, or too many repeated), ``failed`` and ``kept``."""
    df = measure_texts(df, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.withColumns({"base_failed": base, "failed": failed_rules(rules)})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))

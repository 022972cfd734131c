"""Operator 4, quality rules: a table of thresholds compiled into one projection.

Measures and verdicts are built-in expressions over the row alone: no user
function, no shuffle. A null text counts as empty; an empty text has no words
and fails the base rule. Other columns pass untouched where they are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import free_name, let, table, words

SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "it", "that", "for", "was", "on", "are", "as", "with", "be", "this", "have", "from", "or", "had", "by", "not", "but", "a"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "dans", "en", "du", "pour", "au", "sur", "par", "est", "ce", "il", "elle", "ne", "pas", "avec"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "ser", "se", "no", "por", "con", "su", "para", "es", "al", "lo", "como", "del", "o", "a"],
}

#: (rule, measure, lowest, highest): a document is kept if every measure lies within its bounds.
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("length", "n_words", 10, None),
    ("word_length", "mean_word_length", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.10),
    ("exclaimed", "exclaim_ratio", None, 0.25),
    ("stop_words", "stop_word_ratio", 0.02, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.30),
]


def _repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 5)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))

    def covered(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])
            return F.sort_array(F.transform(F.filter(s, lambda e, j: F.coalesce(twin(e, j), F.get(s, j + 1)["h"] == e["h"], F.get(s, j - 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"]))

        step = lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda s, x: s + x
        )
        return let(tagged, lambda s: let(starts(s), step))

    count = let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < 6, F.lit(0)).otherwise(count).cast("long")


def measures(text: Column, stop_words: list[str] | None = None) -> dict[str, Column]:
    """Every measure of the threshold table, as expressions over ``text``."""
    stops = stop_words or sorted({w for ws in STOP_WORDS.values() for w in ws})
    text = F.coalesce(text, F.lit(""))
    blank = F.lit(" \t\n\x0b\x0c\r")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, blank)) > 0)
    m = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stop_words"),
        ),
    )
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    less = lambda chars: reduce(lambda x, y: x + y, (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars)).cast("long")
    return {"m": m, "d": dup, "n_symbols": less(SYMBOLS), "n_exclaims": less("!")}


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts and ratios of each row beside ``docs``' columns (clashing ones are replaced)."""
    m = measures(F.col(text))
    a, b, x = (free_name(docs, c) for c in ("word_measures", "line_measures", "exclaims"))
    out = docs.withColumns({a: m["m"], b: m["d"], "n_symbols": m["n_symbols"], x: m["n_exclaims"]})
    n, lines = F.greatest(F.col(a)["n_words"], F.lit(1)), F.greatest(F.col(b)["n_lines"], F.lit(1))
    chars = F.greatest(F.col(a)["word_chars"], F.lit(1))
    return out.withColumns(
        {c: F.col(a)[c] for c in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")}
        | {c: F.col(b)[c] for c in ("n_lines", "n_dup_lines")}
        | {
            "mean_word_length": F.col(a)["word_chars"] / n,
            "symbol_ratio": F.col("n_symbols") / chars,
            "exclaim_ratio": F.col(x) / n,
            "stop_word_ratio": F.col(a)["n_stop_words"] / n,
            "dup_line_ratio": F.col(b)["n_dup_lines"] / lines,
            "repeat_word_ratio": F.col(a)["n_repeat_words"] / n,
        }
    ).drop(a, b, x)


def compiled(thresholds=None) -> Column:
    """The threshold table as one boolean expression."""
    terms = []
    for _, measure, low, high in thresholds or THRESHOLDS:
        terms += [F.col(measure) >= low] * (low is not None) + [F.col(measure) <= high] * (high is not None)
    return reduce(lambda x, y: x & y, terms, F.lit(True))


def judge(docs: DataFrame, thresholds=None, text: str = "text") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return with_measures(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(thresholds))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))

OP4_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT *, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) AS gs FROM w),
r AS (SELECT *, CASE WHEN len(list_distinct(gs)) = len(gs) THEN []::VARCHAR[] ELSE map_keys(map_from_entries(list_filter(map_entries(list_histogram(gs)), lambda e: e.value > 1))) END AS ds FROM g),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
             (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(text) - len(replace(text, '!', '')))::BIGINT AS n_exclaims,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             CASE WHEN len(ds) = 0 THEN 0 ELSE len(list_filter(range(1, len(ws) + 1), lambda i:
                 len(list_filter(range(greatest(1, i - 4), least(i, len(gs)) + 1), lambda j: list_contains(ds, gs[j]))) > 0)) END::BIGINT AS n_repeat_words FROM r),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_words >= 10 AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 14.0
        AND n_symbols / greatest(word_chars, 1) <= 0.10 AND n_exclaims / greatest(n_words, 1) <= 0.25
        AND n_stop / greatest(n_words, 1) >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.30) AS kept
FROM b
"""

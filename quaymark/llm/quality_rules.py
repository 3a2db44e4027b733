"""Quality rules: a table of thresholds compiled into one Spark projection.

Counts of a text (words, characters, symbols, repeated lines and words, stop words, line endings)
are built-in expressions over the text's words; ratios of counts are compared with the bounds of a
table. No Python runs on the executors and nothing is shuffled: repeated three-word windows are
found by sorting a text's own windows.

Defined cases: a null text has no words, so the base rules reject it; ratios over nothing are 0;
equal rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
#: Frequent function words of the languages that are kept.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on this are or from",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus",
    "es": "de la que el en y los del se las por un para con no una su al es lo",
}


@dataclass(frozen=True)
class Rule:
    """Share ``part / whole`` must lie in [least, most]; a missing ``whole`` means 1."""

    name: str
    part: str
    whole: str | None
    least: float | None
    most: float | None


RULES = (
    Rule("words", "n_words", None, 50, 1_000_000),
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.01, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("upper_letter_share", "n_upper", "word_chars", None, 0.5),
)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, n: Column) -> Column:
    """How many words lie in three-word windows that a text has twice or more."""
    m = F.greatest(n - 2, F.lit(1))
    windows = F.arrays_zip(F.slice(words, 1, m).alias("a"), F.slice(words, 2, m).alias("b"), F.slice(words, 3, m).alias("c"), F.sequence(F.lit(1), m).alias("at"))

    def positions(x: Column, y: Column) -> Column:
        same = (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return F.when(same, F.array(*[z["at"] + k for z in (x, y) for k in range(3)])).otherwise(F.array().cast("array<int>"))

    pairs = bound(F.sort_array(windows), lambda s: F.zip_with(F.slice(s, 1, m - 1), F.slice(s, 2, m - 1), positions))
    return F.when(n > 3, F.size(F.array_distinct(F.flatten(pairs)))).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules are about."""
    stop = sorted({v for ws in STOP_WORDS.values() for w in ws.split() for v in (w, w.capitalize())})
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = texts.select("doc_id", "text", F.array_remove(F.split("text", SPACE + "+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")).alias("lines"))
    n = F.size("words")
    return words.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words"), n).cast("bigint").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: w.isin(stop))).cast("bigint").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("bigint").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]\s"))).cast("bigint").alias("n_bullet_lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every ratio of the table is within its bounds."""
    found = F.lit(True)
    for r in rules:
        share = F.col(r.part).cast("double") if r.whole is None else F.when(F.col(r.whole) > 0, F.col(r.part) / F.col(r.whole)).otherwise(0.0)
        if r.least is not None:
            found = found & (share >= float(r.least))
        if r.most is not None:
            found = found & (share <= float(r.most))
    return found


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts with ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def rules_digest(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for ``rules_digest`` over a table ``documents``."""
    stop = ", ".join(f"'{v}'" for v in sorted({v for ws in STOP_WORDS.values() for w in ws.split() for v in (w, w.capitalize())}))
    tests = []
    for r in rules:
        share = f"{r.part}::DOUBLE" if r.whole is None else f"(CASE WHEN {r.whole} > 0 THEN {r.part}::DOUBLE / {r.whole} ELSE 0.0 END)"
        tests += [f"{share} {sign} {float(x)}" for sign, x in ((">=", r.least), ("<=", r.most)) if x is not None]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
             len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…'))::BIGINT AS n_ellipsis_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\\t\\n\\x0B\\f\\r ]*[-*•][\\t\\n\\x0B\\f\\r ]')))::BIGINT AS n_bullet_lines,
             length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper
      FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {' AND '.join(tests)}) AS kept
FROM b"""

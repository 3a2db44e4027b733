"""Path rules as tables: any number of prefixes and globs, met by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions.paths import path_shape

#: The longest literal beginning of a glob that is looked up; more is left to the pattern.
MOST_PREFIX = 64


def ancestors(path: Column) -> Column:
    """A path and all paths above it."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def clean_rule(rule: Column) -> Column:
    """A rule with forward slashes only, without outer ones and a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.translate(rule, "\\", "/"), "^/+|/+$", ""), r"^\./", "")


def below_rules(rows: DataFrame, path: str, rules: DataFrame, rule: str) -> DataFrame:
    """The distinct paths of rows that are a rule or lie below one: each path asks for itself and those above it."""
    wanted = rules.where(F.col(rule).isNotNull()).select(clean_rule(F.col(rule)).alias("_a")).distinct()
    asked = rows.select(path).where(F.col(path).isNotNull()).distinct().withColumn("_a", F.explode(ancestors(F.col(path))))
    return asked.join(wanted, "_a", "left_semi").select(path).distinct()


def not_excluded(rows: DataFrame, path: str, rules: DataFrame, rule: str) -> DataFrame:
    """Rows whose path is no rule and below none; a null path is kept."""
    return rows.join(below_rules(rows, path, rules, rule), path, "left_anti")


def glob_pattern(glob: Column) -> Column:
    """A glob (``*``, ``?``, ``[abc]``, ``[!abc]``) as a regular expression over the whole value."""
    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)\[!?\]?[^\]]*\]|."), F.lit(0))
    of_class = lambda t: F.regexp_replace(F.regexp_replace(t, r"^\[!?", ""), r"([\\\[\^&])", r"\\$1")
    one = lambda t: (
        F.when(t == "*", ".*").when(t == "?", ".")
        .when(F.length(t) > 2, F.concat(F.when(t.startswith("[!"), "[^").otherwise("["), of_class(t)))
        .otherwise(F.when(t.rlike(r"^[\w/ \-]$"), t).otherwise(F.concat(F.lit("\\"), t)))
    )
    return F.concat(F.lit(r"(?s)\A(?:"), F.array_join(F.transform(tokens, one), ""), F.lit(r")\z"))


def matching_globs(values: DataFrame, key: str, value: str, globs: DataFrame, glob: str) -> DataFrame:
    """The distinct (key, glob) with a value of the key that a glob matches in whole.

    A glob stands under its beginning before the first wildcard, cut at ``MOST_PREFIX``; a value asks for its own
    beginnings of the lengths that occur, and only what it finds is matched by pattern.
    """
    literal = F.regexp_extract(F.col(glob), rf"^[^*?\[]{{0,{MOST_PREFIX}}}", 0)
    filed = globs.where(F.col(glob).isNotNull()).select(F.col(glob).alias("_glob")).distinct().select("_glob", F.regexp_extract("_glob", rf"^[^*?\[]{{0,{MOST_PREFIX}}}", 0).alias("_start"), glob_pattern(F.col("_glob")).alias("_p"))
    lengths = [r.n for r in globs.where(F.col(glob).isNotNull()).select(F.length(literal).alias("n")).distinct().collect()]  # at most MOST_PREFIX + 1
    if not lengths:
        return values.select(key, F.lit("").alias("glob")).limit(0)
    starts = F.array(*[F.when(F.length(value) >= n, F.left(F.col(value), F.lit(n))) for n in sorted(lengths)])
    asked = values.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), F.explode(F.array_compact(starts)).alias("_start"))
    return asked.join(filed, "_start").where(F.regexp_like(F.col("_v"), F.col("_p"))).select(key, F.col("_glob").alias("glob")).distinct()


def scopes(endpoints: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, scope) of endpoints (key, method, path) by rules (kind ``include`` or ``exclude``, glob).

    An endpoint is required if an include rule matches it, or there is none, and no exclude rule does. Rules are met by
    the id, the path, its shape, and method and path or shape. Keys are unique.
    """
    shape = path_shape(F.col("path"))
    named = F.array(F.col(key).cast("string"), F.col("path"), shape, F.concat_ws(" ", "method", "path"), F.concat_ws(" ", F.col("method"), shape))
    values = endpoints.select(key, F.explode(F.array_distinct(named)).alias("value"))
    met = matching_globs(values, key, "value", rules, "glob").join(rules.select("kind", "glob").distinct(), "glob")
    by = met.groupBy(key).agg(F.bool_or(F.col("kind") == "include").alias("_in"), F.bool_or(F.col("kind") == "exclude").alias("_out"))
    every = rules.where("kind = 'include'").isEmpty()
    inside = F.lit(True) if every else F.coalesce("_in", F.lit(False))
    return endpoints.select(key).join(by, key, "left").select(key, F.when(inside & ~F.coalesce("_out", F.lit(False)), "required").otherwise("excluded").alias("scope"))

"""Digests of JSON documents as trees, made by Spark from their leaves up.

What enters a parent's sum is a hash of a child's key (in an object), place (in an array) or of nothing but itself (in an array
whose order has no meaning), and its digest; so no level has to be gathered in order. Digests have 128 bits, two 64-bit hashes:
enough to tell artifacts apart, not to withstand forgery. Texts never leave the JVM.

A document of up to ``SHALLOW`` levels is summed within its row. A deeper one is broken into its leaves, each with the objects and arrays
above it; then the deepest level is summed into its parents, and so on to the root. Both give the same digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions.frames import dealt

#: Objects and arrays in one another that are summed within a row.
SHALLOW = 8
#: Characters of documents in one task.
TEXT_OF_TASK = 8 << 20
#: Keys of an artifact that change from run to run, and arrays whose order has no meaning.
VOLATILE = ("generated_at", "audit_timestamp", "audit_id", "dirty")
SET_LIKE = ("fields", "required_fields", "optional_fields", "schemes", "status_codes", "notes", "required")
NODE = "struct<kind:string,label:string,at:bigint>"


def depth_of(value: Column) -> Column:
    """How many objects and arrays stand in one another."""
    brackets = F.regexp_replace(F.to_json(value), r'"(?:[^"\\]|\\.)*"|[^\[\]{}]', "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    marks = F.filter(F.split(brackets, ""), lambda c: c != "")
    return F.coalesce(F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"]), F.lit(0))


def leaves(rows: DataFrame, key: str, depth: int, volatile: tuple[str, ...], set_like: tuple[str, ...]) -> DataFrame:
    """key, the nodes above, label, place and both hashes of each leaf; an empty object or array is one."""
    kind = F.regexp_extract(F.coalesce(F.schema_of_variant("v"), F.lit("VOID")), "^[A-Z]+", 0)
    at = rows.select(key, F.array().cast(f"array<{NODE}>").alias("above"), F.lit("").alias("label"), F.lit("").alias("name"), F.lit(0).cast("bigint").alias("at"), "v")
    child = lambda label, name, at, v: F.struct(label.alias("label"), name.alias("name"), at.cast("bigint").alias("at"), v.alias("v"))
    for _ in range(depth):
        open_ = at.withColumn("kind", F.when(F.col("v").isNotNull(), kind))
        entries = F.filter(F.map_entries(F.col("v").try_cast("map<string,variant>")), lambda e: ~e["key"].isin(*volatile) if volatile else F.lit(True))
        by_key = F.transform(entries, lambda e, k: child(F.concat(F.lit("k:"), e["key"]), e["key"], k, e["value"]))
        free = F.col("name").isin(*set_like) if set_like else F.lit(False)
        by_place = F.transform(F.col("v").try_cast("array<variant>"), lambda x, k: child(F.when(free, "s").otherwise(F.concat(F.lit("i:"), k.cast("string"))), F.lit(""), k, x))
        self_ = F.array(child(F.col("label"), F.col("name"), F.col("at"), F.col("v")))
        found = open_.withColumn("parts", F.when(F.col("kind") == "OBJECT", by_key).when(F.col("kind") == "ARRAY", by_place))
        goes = F.coalesce(F.size("parts") > 0, F.lit(False))
        inside = F.concat("above", F.array(F.struct(F.col("kind"), F.col("label"), F.col("at"))))
        spread = found.select(key, F.when(goes, inside).otherwise(F.col("above")).alias("above"), F.explode(F.when(goes, F.col("parts")).otherwise(self_)).alias("c"))
        at = spread.select(key, "above", "c.label", "c.name", "c.at", "c.v")
    # Of what is empty but for volatile keys nothing is left to tell.
    empty = F.when(kind == "OBJECT", "{}").when(kind == "ARRAY", "[]")
    text = at.select(key, "above", "label", "at", F.coalesce(empty, F.to_json("v"), F.lit("null")).alias("text"))
    return text.select(key, "above", "label", "at", F.xxhash64("text", F.lit(0)).alias("h0"), F.xxhash64("text", F.lit(1)).alias("h1"))


def folded(rows: DataFrame, key: str, level: int) -> DataFrame:
    """The nodes of one level summed into their parents; what stands higher is a group of its own."""
    here = F.size("above") == level
    own = F.struct(F.lit("-").alias("kind"), F.col("label"), F.col("at"))
    group = F.when(here, F.col("above")).otherwise(F.concat("above", F.array(own)))
    # Sums and minima of numbers are kept in hash tables; decimals hold the sum of any number of children.
    entry = [F.sum(F.xxhash64("label", "h0", "h1", F.lit(k)).cast("decimal(38,0)")).alias(f"sum{k}") for k in (0, 1)]
    sums = rows.groupBy(key, group.alias("group")).agg(*entry, F.min("h0").alias("h0"), F.min("h1").alias("h1"))
    last = F.element_at("group", -1)
    up = [F.when(last["kind"] == "-", F.col(f"h{k}")).otherwise(F.xxhash64(last["kind"], "sum0", "sum1", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    return sums.select(key, F.slice("group", 1, F.size("group") - 1).alias("above"), last["label"].alias("label"), last["at"].alias("at"), *up)


def row_digest(value: Column, name: Column, levels: int, volatile: tuple[str, ...], set_like: tuple[str, ...]) -> Column:
    """Both hashes of a value with at most so many objects and arrays in one another, as ``leaves`` and ``folded`` make them."""
    text = F.coalesce(F.to_json(value), F.lit("null"))
    hashed = lambda t: F.struct(*[F.xxhash64(t, F.lit(k)).alias(f"h{k}") for k in (0, 1)])
    if levels == 0:
        return hashed(text)
    child = lambda label, name_, v: F.struct(label.alias("label"), name_.alias("name"), v.alias("v"))
    entries = F.filter(F.map_entries(value.try_cast("map<string,variant>")), lambda e: ~e["key"].isin(*volatile) if volatile else F.lit(True))
    free = name.isin(*set_like) if set_like else F.lit(False)
    by_key = F.transform(entries, lambda e: child(F.concat(F.lit("k:"), e["key"]), e["key"], e["value"]))
    by_place = F.transform(value.try_cast("array<variant>"), lambda x, k: child(F.when(free, "s").otherwise(F.concat(F.lit("i:"), k.cast("string"))), F.lit(""), x))

    def of(parts: Column) -> Column:
        kind = F.when(parts[0]["label"].startswith("k:"), "OBJECT").otherwise("ARRAY")
        told = F.transform(parts, lambda c: F.struct(c["label"].alias("label"), row_digest(c["v"], c["name"], levels - 1, volatile, set_like).alias("d")))
        none = F.lit(0).cast("decimal(38,0)")
        more = lambda s, c, k: (s[f"sum{k}"] + F.xxhash64(c["label"], c["d"]["h0"], c["d"]["h1"], F.lit(k))).cast("decimal(38,0)").alias(f"sum{k}")
        sums = F.aggregate(told, F.struct(none.alias("sum0"), none.alias("sum1")), lambda s, c: F.struct(more(s, c, 0), more(s, c, 1)), lambda s: F.struct(*[F.xxhash64(kind, s["sum0"], s["sum1"], F.lit(k)).alias(f"h{k}") for k in (0, 1)]))
        # Of what is empty but for volatile keys nothing is left to tell.
        empty = F.when(parts.isNotNull(), F.when(F.left(text, F.lit(1)) == "{", "{}").otherwise("[]"))
        return F.when(F.size(parts) > 0, sums).otherwise(hashed(F.coalesce(empty, text)))

    # An array of one has the parts made once.
    return F.transform(F.array(F.coalesce(by_key, by_place)), of)[0]


def document_digests(rows: DataFrame, key: str, document: str, volatile: tuple[str, ...] = VOLATILE, set_like: tuple[str, ...] = SET_LIKE) -> DataFrame:
    """(key, digest) of JSON documents: equal ones differ at most in key order, blanks, volatile keys and the order of set-like arrays.

    Text that is no JSON has a null digest, and so has a null. Keys must be unique: rows of one key would be one document.
    """
    opened = F.length(document) - F.length(F.translate(F.col(document), "[{", ""))
    deep = lambda v: F.when(opened > SHALLOW, depth_of(v)) > SHALLOW
    v = F.try_parse_json(F.col(document))
    told = rows.agg(F.sum(F.length(document)).alias("n"), F.max(opened).alias("most"), F.max(F.when(opened > SHALLOW, depth_of(v))).alias("d")).first()
    text = lambda h: F.concat(*[F.lpad(F.hex(h[f"h{k}"]), 16, "0") for k in (0, 1)])
    # A document is in one task as a row already; dealt by key once, no level is shuffled.
    parsed = dealt(rows.select(key, document), told.n, TEXT_OF_TASK, F.col(key)).select(key, document, v.alias("v"))
    whole = lambda x: F.when(x.isNotNull(), row_digest(x, F.lit(""), min(SHALLOW, told.most or 0), volatile, set_like))
    in_row = lambda r: r.select(key, text(F.transform(F.array("v"), whole)[0]).alias("digest"))
    if (told.d or 0) <= SHALLOW:
        return in_row(parsed)
    is_deep = F.coalesce(deep(F.col("v")), F.lit(False))
    found = leaves(parsed.where(is_deep).select(key, "v"), key, told.d, volatile, set_like)
    for level in range(told.d, 0, -1):
        found = folded(found, key, level)
    return in_row(parsed.where(~is_deep)).unionByName(found.select(key, text(found).alias("digest")))

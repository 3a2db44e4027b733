"""What a repository is made of: languages, technologies and dependencies, with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions.frames import cut, dealt

EVIDENCE_ROWS = 20
#: Languages by extension.
LANGUAGES = {
    "php": "PHP", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "vue": "Vue",
    "py": "Python", "dart": "Dart", "java": "Java", "kt": "Kotlin", "cs": "C#", "go": "Go", "rb": "Ruby", "rs": "Rust",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension(path))


def first_items(rows: DataFrame, kinds: list[str], item: str, first: int) -> DataFrame:
    """The first items of each kind in order, as a list; the limit reaches the scan's side of the shuffle."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*kinds).orderBy(item))).where(F.col("_n") <= first)
    return ranked.groupBy(*kinds).agg(F.array_sort(F.collect_list(item)).alias("first"))


def histogram(rows: DataFrame, kind: str, item: str, first: int = EVIDENCE_ROWS) -> DataFrame:
    """Number of rows of each kind and its first items in order; the list's limit is the report's."""
    lists = first_items(rows, [kind], item, first).withColumnRenamed(kind, "_kind")
    counted = rows.groupBy(kind).agg(F.count("*").alias("n"))
    return counted.join(lists, F.col(kind).eqNullSafe(F.col("_kind")), "left").select(kind, "n", F.coalesce("first", F.array().cast(lists.schema["first"].dataType)).alias("first"))


def detect(files: DataFrame, signatures: DataFrame, key: str, text: str, extension_of: str | None = None, most: int = 1000) -> DataFrame:
    """(key, name, kind) of each signature that a file's text shows.

    ``signatures`` (name, kind, pattern, extensions or null) is a fixed catalogue of a few dozen rows,
    collected once; each becomes a pattern in the scan's own projection, so texts are not multiplied.
    Beyond ``most`` signatures is an error.
    """
    catalogue = signatures.limit(most + 1).collect()
    if len(catalogue) > most:
        raise ValueError("too many signatures for one scan")
    tests = []
    for s in catalogue:
        hit = F.col(text).rlike(s.pattern)
        if extension_of and s.extensions:
            hit = F.col(extension_of).isin(*s.extensions) & hit
        tests.append(F.when(hit, F.struct(F.lit(s.name).alias("name"), F.lit(s.kind).alias("kind"))))
    found = files.select(key, F.explode(F.array_compact(F.array(*tests))).alias("hit")) if tests else files.limit(0).select(key, F.struct(F.lit("").alias("name"), F.lit("").alias("kind")).alias("hit"))
    return found.select(key, "hit.name", "hit.kind")


def merge_detections(found: DataFrame, key: str, confidence: str = "confidence", first: int = EVIDENCE_ROWS) -> DataFrame:
    """Each technology once: number of distinct pieces of evidence, the first of them, confirmed if any row is.

    The list's limit is the report's; all evidence stays in ``found``, a row each.
    """
    kinds = ["kind", "name"]
    once = found.groupBy(*kinds, key).agg(F.bool_or(F.col(confidence) == "confirmed").alias("_sure"))
    merged = once.groupBy(*kinds).agg(F.count("*").alias("n"), F.bool_or("_sure").alias("_sure"))
    return merged.join(first_items(once, kinds, key, first), kinds).select(*kinds, "n", F.col("first").alias("evidence"), F.when(F.col("_sure"), "confirmed").otherwise("probable").alias(confidence))


#: Characters of a gram.
GRAM = 3
#: Texts of one task.
TEXTS = 50_000
#: Up to so many grams are sent to all tasks, which drop the others before they shuffle; beyond, none is dropped before.
MOST_GRAMS = 100_000


def grams(text: Column, size: Column | int) -> Column:
    """The distinct substrings of a size."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: text.substr(k, size)))


def contained(texts: DataFrame, names: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """The distinct (key, text, name) with the name somewhere in the text; nulls hold and are held by nothing.

    An inverted index: each name stands under one of its grams, the one that the fewest texts of its key have, and names
    shorter than ``GRAM`` under themselves. Texts ask for each of their grams, and only what they
    find there is compared. The empty name is in every text of its key.

    Files of such columns are far smaller than their rows, so joins are by sorting, whatever size the engine expects.
    """
    n = texts.count()
    asked = dealt(texts.select(key, text).where(F.col(text).isNotNull()), n, TEXTS, key, text).distinct()
    wanted = names.select(key, name).where(F.col(name).isNotNull()).distinct()
    sizes = [r.s for r in wanted.where(F.length(name) > 0).select(F.least(F.length(name), F.lit(GRAM)).alias("s")).distinct().collect()]
    every = asked.join(F.broadcast(wanted.where(F.length(name) == 0)), key).select(key, text, name)  # a row for each key at most
    if not sizes:
        return every
    held = asked.select(key, text, F.explode(F.concat(*[grams(F.col(text), s) for s in sorted(sizes)])).alias("_g"))
    often = held.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_n"))
    own = wanted.where(F.length(name) > 0).select(key, name, F.explode(grams(F.col(name), F.least(F.length(name), F.lit(GRAM)))).alias("_g"))
    # A gram that no text has rules its name out: such a name must not be filed under another gram.
    rare = own.join(often.hint("merge"), [key, "_g"], "left").groupBy(key, name).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("r"))
    filed = cut(rare.where("r.n > 0").select(key, name, F.col("r._g").alias("_g")))
    places = filed.select(key, "_g").distinct()
    if places.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS:
        held = held.join(F.broadcast(places), [key, "_g"], "left_semi")
    found = dealt(held, n, TEXTS, key, "_g").join(filed.hint("merge"), [key, "_g"])
    return found.where(F.col(text).contains(F.col(name))).select(key, text, name).unionByName(every)


def match_dependencies(declared: DataFrame, known: DataFrame) -> DataFrame:
    """Declared (ecosystem, dependency) against known (ecosystem, name, mode): exact, contains or prefix.

    A prefix is the whole name or ends before a dot. Names to be contained are looked up by their rarest gram (``contained``).
    """
    k = known.select(F.col("ecosystem").alias("e"), "name", "mode")
    same, columns = F.col("ecosystem") == F.col("e"), [*declared.columns, "name", "mode"]
    exact = declared.join(k.where("mode = 'exact'").hint("merge"), same & (F.col("dependency") == F.col("name")))
    held = contained(declared.select("ecosystem", "dependency"), k.where("mode = 'contains'").select(F.col("e").alias("ecosystem"), "name"), "ecosystem", "dependency", "name")
    held = held.select(F.col("ecosystem").alias("e"), F.col("dependency").alias("_d"), "name", F.lit("contains").alias("mode"))
    contains = declared.join(held.hint("merge"), same & (F.col("dependency") == F.col("_d")))
    parts = F.split("dependency", r"\.", -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    prefix = declared.where("dependency IS NOT NULL").withColumn("_start", F.explode(starts)).join(k.where("mode IS NULL OR mode NOT IN ('exact', 'contains')").hint("merge"), same & (F.col("_start") == F.col("name")))
    return exact.select(*columns).unionByName(contains.select(*columns)).unionByName(prefix.select(*columns))


#: Technologies by a pattern of their own in code (name, kind, pattern, extensions).
_SCRIPT = ["js", "jsx", "mjs", "cjs", "ts", "tsx", "vue"]
TECHNOLOGIES = (
    ("slim", "framework", r"\bSlim\\(App|Factory)|AppFactory::create|\$app\s*->\s*(get|post|put|patch|delete)\s*\(", ["php"]), ("laravel", "framework", r"\bRoute::(get|post|put|patch|delete|match|any|group|prefix)\b|Illuminate\\", ["php"]),
    ("express", "framework", r"require\(\s*['\"]express['\"]|from\s+['\"]express['\"]", _SCRIPT), ("django", "framework", r"\bfrom django\b|\bimport django\b", ["py"]), ("flask", "framework", r"\bfrom flask\b|\bimport flask\b", ["py"]),
    ("fastapi", "framework", r"\bfrom fastapi\b|\bimport fastapi\b", ["py"]), ("spring", "framework", r"org\.springframework", ["java", "kt"]), ("aspnet", "framework", r"Microsoft\.AspNetCore", ["cs"]),
    ("guzzle", "http_client", r"GuzzleHttp\\|new\s+Client\(", ["php"]), ("laravel-http", "http_client", r"\bHttp::(get|post|put|patch|delete|with)", ["php"]), ("php-curl", "http_client", r"\bcurl_init\s*\(", ["php"]),
    ("axios", "http_client", r"\baxios\b", _SCRIPT), ("fetch", "http_client", r"\bfetch\s*\(", _SCRIPT), ("angular-http", "http_client", r"\bHttpClient\b", ["ts"]), ("dart-http", "http_client", r"package:http/", ["dart"]), ("dio", "http_client", r"package:dio/|\bDio\s*\(", ["dart"]),
    ("requests", "http_client", r"\bimport requests\b|\brequests\.(get|post|put|patch|delete)\s*\(", ["py"]), ("okhttp", "http_client", r"\bOkHttpClient\b", ["java", "kt"]),
    ("soap", "integration", r"\bSoapClient\b|<(?:\w+:)?definitions\b", None), ("graphql", "integration", r"\bgql`|\bGraphQLClient\b|graphql-tag", _SCRIPT), ("grpc", "integration", r"\bimport grpc\b|io\.grpc\.", None), ("amqp", "integration", r"\bAMQPStreamConnection\b|amqplib", None),
    ("openapi", "existing_spec", r"(?m)^\s*[\"']?(openapi|swagger)[\"']?\s*:\s*[\"']?[23]\.", ["json", "yaml", "yml"]),
)
#: Technologies that have a detector; of integration surfaces only SOAP.
SUPPORTED = ("slim", "laravel", "guzzle", "laravel-http", "php-curl", "axios", "fetch", "angular-http", "dart-http", "dio", "soap")
SERVER_FRAMEWORKS = ("slim", "laravel", "express", "django", "flask", "fastapi", "spring", "aspnet")
#: Categories of a detector plan, in their order.
PLAN = ("inventory", "framework", "configuration", "existing_spec", "exposed", "consumed", "integration")


def technologies(files: DataFrame) -> DataFrame:
    """(repository_id, path, name, kind) of known technologies that files (repository_id, path, text) show."""
    signatures = files.sparkSession.createDataFrame(list(TECHNOLOGIES), "name string, kind string, pattern string, extensions array<string>")
    rows = files.where("text IS NOT NULL").select(F.struct("repository_id", "path").alias("file"), "text", extension(F.col("path")).alias("extension"))
    return detect(rows, signatures, "file", "text", "extension").select("file.repository_id", "file.path", "name", "kind")


def detector_plan(detected: DataFrame, by: str = "repository_id") -> DataFrame:
    """(repository, categories in the plan's order, hints in order) from detected (repository, name, kind)."""
    served = F.col("name").isin(*SERVER_FRAMEWORKS) & (F.col("kind") == "framework")
    kinds = F.when(F.col("kind") == "http_client", F.array(F.lit("consumed"))).when(served, F.array(F.lit("framework"), F.lit("exposed"))).otherwise(F.array("kind"))
    hints = (
        F.when(F.col("kind") == "http_client", F.array(F.concat(F.lit("consumed:"), "name")))
        .when(F.col("kind") == "framework", F.array_compact(F.array(F.concat(F.lit("framework:"), "name"), F.when(served, F.concat(F.lit("exposed:"), "name")))))
        .when(F.col("kind") == "existing_spec", F.array(F.lit("existing_spec:openapi-or-swagger")))
        .otherwise(F.array(F.concat(F.lit("integration:"), "name")))
    )
    rows = detected.select(by, "name", "kind").distinct().select(by, kinds.alias("k"), hints.alias("h"))
    sets = rows.groupBy(by).agg(F.array_distinct(F.flatten(F.collect_set("k"))).alias("k"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("h")))).alias("hints"))
    order = F.array(*[F.lit(x) for x in PLAN])
    return sets.select(by, F.filter(order, lambda c: c.isin("inventory", "configuration") | F.array_contains("k", c)).alias("categories"), "hints")


def unsupported(detected: DataFrame, supported: DataFrame, name: str) -> DataFrame:
    """Detected technologies that no detector covers."""
    return detected.join(supported, name, "left_anti")

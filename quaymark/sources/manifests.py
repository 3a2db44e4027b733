"""Dependencies declared in manifests, one row each.

JSON, XML and line formats are read by column expressions; only TOML, for which the engine has no reader, goes through Python in Arrow batches.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions.frames import dealt

#: Characters of files in one task.
TEXT_OF_TASK = 8 << 20
#: Ecosystems by a manifest's file name.
MANIFESTS = {
    "composer.json": "composer", "package.json": "npm", "pyproject.toml": "python", "requirements.txt": "python", "pom.xml": "maven", "build.gradle": "gradle",
    "build.gradle.kts": "gradle", "Gemfile": "ruby", "go.mod": "go", "pubspec.yaml": "dart", "Cargo.toml": "rust",
}
#: Sections of dependencies, by file name.
SECTIONS = {
    "composer.json": ("require", "require-dev"), "package.json": ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"),
    "pubspec.yaml": ("dependencies", "dev_dependencies", "dependency_overrides"), "poetry": ("dependencies", "dev-dependencies"),
}
ROWS = "repository_id string, path string, ecosystem string, dependency string, error string"
#: Errors of unreadable manifests, by format.
JSON_ERROR, XML_ERROR, TOML_ERROR = "JSONDecodeError", "ParseError", "TOMLDecodeError"

_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"


def python_name(requirement: Column) -> Column:
    """The package of a requirement: lower case, dashes; empty where it does not begin with a name."""
    return F.translate(F.lower(F.regexp_extract(requirement, rf"^\s*({_NAME})", 1)), "_", "-")


def json_keys(text: Column, sections: tuple[str, ...]) -> Column:
    """Keys of the given top-level objects; null where the text is no JSON object. A section that is no object has none."""
    keys = [F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{s}")), F.array().cast("array<string>")) for s in sections]
    return F.when(F.json_object_keys(text).isNotNull(), F.concat(*keys))


def _of_xml(text: Column, fields: str, names: Callable[[Column], Column]) -> Column:
    """Names in a document of the given fields; null where the text is no XML. An array of one document has it parsed once, however many fields are read."""
    # The engine fills the column of what it could not read only where that comes last.
    options = {"columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true", "mode": "PERMISSIVE"}
    # A mark of byte order is no part of the document.
    document = F.from_xml(F.ltrim(text, F.lit("\ufeff \t\r\n")), f"struct<{fields}, _corrupt: string>", options)
    return F.element_at(F.transform(F.array(document), lambda d: F.when((F.trim(text) != "") & d.isNotNull() & d["_corrupt"].isNull(), names(d))), 1)


def pom_names(text: Column) -> Column:
    """group:artifact of each dependency, wherever Maven's model has them; null where the text is no XML."""
    listed = "dependency: array<struct<groupId: string, artifactId: string>>"
    own = f"dependencies: struct<{listed}>, dependencyManagement: struct<dependencies: struct<{listed}>>"
    plugins = f"plugins: struct<plugin: array<struct<dependencies: struct<{listed}>>>>"
    build = f"build: struct<{plugins}, pluginManagement: struct<{plugins}>>"
    fields = f"{listed}, {own}, {build}, profiles: struct<profile: array<struct<{own}, {build}>>>"
    some = lambda c: F.coalesce(c, F.array().cast("array<struct<groupId: string, artifactId: string>>"))

    def below(model: Column) -> list[Column]:
        out = [some(model["dependencies"]["dependency"]), some(model["dependencyManagement"]["dependencies"]["dependency"])]
        for listed_in in (model["build"]["plugins"], model["build"]["pluginManagement"]["plugins"]):
            out.append(some(F.flatten(F.transform(listed_in["plugin"], lambda p: some(p["dependencies"]["dependency"])))))
        return out

    part = lambda d, key: F.coalesce(F.trim(d[key]), F.lit(""))

    def names(document: Column) -> Column:
        profiles = F.flatten(F.transform(document["profiles"]["profile"], lambda p: F.concat(*below(p))))
        found = F.concat(some(document["dependency"]), *below(document), some(profiles))
        return F.transform(found, lambda d: F.concat(part(d, "groupId"), F.lit(":"), part(d, "artifactId")))

    return _of_xml(text, fields, names)


def project_names(text: Column) -> Column:
    """Packages that a .NET project includes or updates, in groups of the project, its targets and its choices; null where the text is no XML."""
    named = "PackageReference: array<struct<_Include: string, _Update: string>>"
    groups = f"ItemGroup: array<struct<{named}>>"
    fields = f"{named}, {groups}, Target: array<struct<{groups}>>, Choose: array<struct<`When`: array<struct<{groups}>>, Otherwise: array<struct<{groups}>>>>"
    kind = "array<struct<_Include: string, _Update: string>>"
    some = lambda c: F.coalesce(c, F.array().cast(kind))
    of_groups = lambda c: some(F.flatten(F.transform(c, lambda g: some(g["PackageReference"]))))
    of_parts = lambda c: some(F.flatten(F.transform(c, lambda p: of_groups(p["ItemGroup"]))))

    def names(document: Column) -> Column:
        choices = F.flatten(F.transform(document["Choose"], lambda c: F.concat(of_parts(c["When"]), of_parts(c["Otherwise"]))))
        found = F.concat(some(document["PackageReference"]), of_groups(document["ItemGroup"]), of_parts(document["Target"]), some(choices))
        return F.filter(F.transform(found, lambda p: F.coalesce(F.nullif(F.trim(p["_Include"]), F.lit("")), F.trim(p["_Update"]))), lambda n: n != "")

    return _of_xml(text, fields, names)


def line_names(name: Column, text: Column) -> Column:
    """Names in formats whose lines can be read one by one; null for other files."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    requirement = F.transform(every(rf"(?m)^[ \t]*({_NAME})"), python_name)
    # Coordinates in any configuration, and plugins by id.
    gradle = F.concat(every(r"""['"]([A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+)(?::[^'"\n]*)?['"]"""), every(r"""\bid\s*\(?\s*['"]([^'"\n]+)"""))
    go = every(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v\d")
    return (
        F.when(name == "requirements.txt", requirement).when(name.startswith("build.gradle"), gradle)
        .when(name == "Gemfile", every(r"""(?m)^\s*gem[\s(]+['"]([^'"\n]+)""")).when(name == "go.mod", go)
    )


def pubspec_names(files: DataFrame) -> DataFrame:
    """(repository_id, path, dependency) of keys one level below the sections of dependencies.

    A file's lines are rows; each takes the last section that began above it, and the depth of that section's first key.
    Whole files are dealt by their characters, so that lines are made where they are sorted.
    """
    files = dealt(files, files.agg(F.sum(F.length("text"))).first()[0], TEXT_OF_TASK, "repository_id", "path")
    lines = files.select("repository_id", "path", F.posexplode(F.split("text", r"\r\n|\r|\n", -1)).alias("n", "line"))
    lines = lines.withColumn("line", F.rtrim(F.regexp_replace("line", "#.*$", ""))).where("trim(line) <> ''")
    lines = lines.withColumn("depth", F.length("line") - F.length(F.regexp_replace("line", r"^\s+", ""))).withColumn("key", F.regexp_extract("line", r"""^\s*["']?([A-Za-z0-9_.-]+)["']?\s*:""", 1))
    above = Window.partitionBy("repository_id", "path").orderBy("n")
    top = F.col("depth") == 0
    lines = lines.withColumn("section", F.last_value(F.when(top, F.col("key")), F.lit(True)).over(above)).withColumn("begun", F.last_value(F.when(top, F.col("n")), F.lit(True)).over(above))
    inside = lines.where(~top & F.col("section").isin(*SECTIONS["pubspec.yaml"]) & (F.col("key") != ""))
    first = Window.partitionBy("repository_id", "path", "begun").orderBy("n")
    return inside.withColumn("level", F.first_value("depth").over(first)).where("depth = level").select("repository_id", "path", F.col("key").alias("dependency")).distinct()


def toml_names(name: str, text: str) -> list[str]:
    """Requirements or names that a TOML manifest declares."""
    data = tomllib.loads(text)
    table = lambda d, key: d.get(key) if isinstance(d.get(key), dict) else {}
    if name == "Cargo.toml":
        return list(table(data, "dependencies"))
    project, poetry = table(data, "project"), table(table(data, "tool"), "poetry")
    groups = [project.get("dependencies"), *table(project, "optional-dependencies").values()]
    return [str(d) for g in groups if isinstance(g, list) for d in g] + [k for s in SECTIONS["poetry"] for k in table(poetry, s) if k.lower() != "python"]


def toml_rows(files: DataFrame) -> DataFrame:
    """Rows of TOML manifests (repository_id, path, name, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for repository, path, name, text in zip(frame["repository_id"], frame["path"], frame["name"], frame["text"], strict=True):
                try:
                    out += [(repository, path, name, d, None) for d in toml_names(name, text)]
                except tomllib.TOMLDecodeError:
                    out.append((repository, path, name, None, TOML_ERROR))
            yield pd.DataFrame(out, columns=["repository_id", "path", "name", "dependency", "error"])

    rows = files.mapInPandas(run, "repository_id string, path string, name string, dependency string, error string")
    cargo = F.col("name") == "Cargo.toml"
    dependency = F.when(cargo, F.col("dependency")).otherwise(python_name(F.col("dependency")))
    rows = rows.select("repository_id", "path", _ecosystem(), dependency.alias("dependency"), "error")
    return rows.where("error IS NOT NULL OR dependency <> ''").distinct()


def _ecosystem() -> Column:
    known = F.create_map(*[F.lit(x) for pair in MANIFESTS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.col("name")), F.lit("dotnet")).alias("ecosystem")


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of all manifests among files (repository_id, path, text), each name once a file; an unreadable manifest gives a row with an error.

    A null text counts as empty, which is no JSON and no XML. What follows the root of an XML document is passed over.
    """
    name = F.substring_index("path", "/", -1)
    rows = files.where(name.isin(*MANIFESTS) | name.endswith(".csproj")).select("repository_id", "path", name.alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    n, t = F.col("name"), F.col("text")
    toml, yaml = n.endswith(".toml"), n == "pubspec.yaml"
    as_json, as_xml = n.endswith(".json"), (n == "pom.xml") | n.endswith(".csproj")
    names = (
        F.when(n == "composer.json", json_keys(t, SECTIONS["composer.json"])).when(n == "package.json", json_keys(t, SECTIONS["package.json"]))
        .when(n == "pom.xml", pom_names(t)).when(n.endswith(".csproj"), project_names(t)).otherwise(line_names(n, t))
    )
    error = F.when(as_json, F.lit(JSON_ERROR)).when(as_xml, F.lit(XML_ERROR))
    item = lambda d, e: F.struct(d.cast("string").alias("dependency"), e.cast("string").alias("error"))
    read = rows.where(~toml & ~yaml).select("repository_id", "path", _ecosystem(), error.alias("e"), F.array_distinct(names).alias("names"))
    items = F.when(F.col("names").isNull(), F.array(item(F.lit(None), F.col("e")))).otherwise(F.transform("names", lambda d: item(d, F.lit(None))))
    out = read.select("repository_id", "path", "ecosystem", F.inline(items))
    dart = pubspec_names(rows.where(yaml)).select("repository_id", "path", F.lit(MANIFESTS["pubspec.yaml"]).alias("ecosystem"), "dependency", F.lit(None).cast("string").alias("error"))
    return out.unionByName(dart).unionByName(toml_rows(rows.where(toml)))

"""Manifests as the engine reads them: sections, damaged files, and formats of lines."""

import pytest

from quaymark.sources.manifests import manifest_dependencies

ROWS = "repository_id string, path string, text string, extra string"
POM = """<?xml version="1.0"?>
<!-- <dependency><groupId>no</groupId></dependency> -->
<m:project xmlns:m="http://maven.apache.org/POM/4.0.0"><m:parent><m:groupId>no</m:groupId><m:artifactId>no</m:artifactId></m:parent>
<m:dependencies><m:dependency><m:groupId> g </m:groupId><m:artifactId>one</m:artifactId><m:exclusions><m:exclusion><m:groupId>no</m:groupId></m:exclusion></m:exclusions></m:dependency>
<m:dependency><m:artifactId>two</m:artifactId></m:dependency></m:dependencies>
<m:dependencyManagement><m:dependencies><m:dependency><m:groupId>g</m:groupId><m:artifactId>three</m:artifactId></m:dependency></m:dependencies></m:dependencyManagement>
<m:build><m:plugins><m:plugin><m:artifactId>no</m:artifactId><m:dependencies><m:dependency><m:groupId>g</m:groupId><m:artifactId>four</m:artifactId></m:dependency></m:dependencies></m:plugin></m:plugins></m:build>
<m:profiles><m:profile><m:dependencies><m:dependency><m:groupId>g</m:groupId><m:artifactId>five</m:artifactId></m:dependency></m:dependencies></m:profile></m:profiles></m:project>"""
PUBSPEC = """name: app
dependencies: # the app's
  # none
  dio: ^5

  http:
    git: y
    path: z
  dio: ^4
environment:
  sdk: x
dev_dependencies:
      lints: any
dependency_overrides:
\t'meta': 1
flutter:
  assets: a
"""
CASES = [
    ("composer.json", '{"require": {"a/b": "1", "c/d": {"x": 1}}, "require-dev": {"a/b": "1"}, "other": {"no": 1}}', ["a/b", "c/d"], None),
    ("composer.json", '{"require": [], "require-dev": null}', [], None),
    ("package.json", '{"dependencies": {"a.b": "1", "@s/p": "2"}, "peerDependencies": {"r": "1", "r": "2"}}', ["@s/p", "a.b", "r"], None),
    ("package.json", '{"dependencies": {"a": }}', [], "JSONDecodeError"),
    ("package.json", "[1]", [], "JSONDecodeError"),
    ("package.json", None, [], "JSONDecodeError"),
    ("pom.xml", POM, [":two", "g:five", "g:four", "g:one", "g:three"], None),
    ("pom.xml", "﻿<project/>", [], None),
    ("pom.xml", "<project><dependencies>", [], "ParseError"),
    ("pom.xml", " ", [], "ParseError"),
    ("pom.xml", '<!DOCTYPE p SYSTEM "http://h.invalid/x.dtd"><p><dependency><artifactId>a</artifactId></dependency></p>', [":a"], None),
    ("App.csproj", '<Project><ItemGroup><PackageReference Include="A.B" Version="1"/><PackageReference Update="C"/><Reference Include="no"/></ItemGroup><ItemGroup Condition="x"><PackageReference Include="D"><Version>1</Version></PackageReference></ItemGroup><Target><ItemGroup><PackageReference Include="E"/></ItemGroup></Target><Choose><When><ItemGroup><PackageReference Include="F"/></ItemGroup></When><Otherwise><ItemGroup><PackageReference Include="G"/></ItemGroup></Otherwise></Choose></Project>', list("CDEFG") + ["A.B"], None),
    ("App.csproj", "<Project><ItemGroup></Project>", [], "ParseError"),
    ("pubspec.yaml", PUBSPEC, ["dio", "http", "lints", "meta"], None),
    ("pubspec.yaml", None, [], None),
    ("requirements.txt", "Foo_Bar[x]>=1 ; python_version<'3'\r\n\n  baz\n# no\n-r no.txt\n", ["baz", "foo-bar"], None),
    ("build.gradle.kts", 'plugins { id("org.x.boot") version "1" }\ndependencies {\n implementation(platform("g:bom:1"))\n kapt \'h:k\'\n implementation(project(":no"))\n}', ["g:bom", "h:k", "org.x.boot"], None),
    ("Gemfile", "source 'no'\ngem 'rails', '~> 7'\ngroup :test do\n  gem(\"rspec\")\n  # gem 'no'\nend\n", ["rails", "rspec"], None),
    ("go.mod", "module h.io/no\ngo 1.2\nrequire h.io/a v1.0.0\nrequire (\n\th.io/b/v2 v2.0.0 // indirect\n)\n", ["h.io/a", "h.io/b/v2"], None),
    ("pyproject.toml", '[project]\ndependencies = ["A_b>2"]\noptional-dependencies = {t = ["c"]}\n[tool.poetry.dependencies]\npython = "3"\nd = "1"\n[tool.poetry.dev-dependencies]\ne = "1"\n', ["a-b", "c", "d", "e"], None),
    ("pyproject.toml", "[", [], "TOMLDecodeError"),
    ("pyproject.toml", "project = 1\n", [], None),
    ("Cargo.toml", '[dependencies]\nserde_json = "1"\n', ["serde_json"], None),
    ("main.py", "x", [], None),
]


def test_formats(spark):
    """Each case in two repositories: equal paths and texts stay apart."""
    data = [(r, f"{k}/{name}", text, "e") for r in ("r", "s") for k, (name, text, _, _) in enumerate(CASES)]
    found = [tuple(x) for x in manifest_dependencies(spark.createDataFrame(data, ROWS)).select("repository_id", "path", "dependency", "error").collect()]
    want = [(r, f"{k}/{name}", d, None) for r in ("r", "s") for k, (name, _, names, _) in enumerate(CASES) for d in names]
    want += [(r, f"{k}/{name}", None, error) for r in ("r", "s") for k, (name, _, _, error) in enumerate(CASES) if error]
    assert sorted(map(repr, found)) == sorted(map(repr, want))


@pytest.mark.parametrize("only", ["none", "main.py"])
def test_nothing_to_read(spark, only):
    files = spark.createDataFrame([("r", "main.py", "x", "e")], ROWS).where(f"path = '{only}'")
    assert manifest_dependencies(files).collect() == []


def test_python_only_for_toml(spark):
    """Only the branch of TOML files has a Python stage."""
    plan = manifest_dependencies(spark.createDataFrame([("r", "a.toml", "", "e")], ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "EvalPython" not in plan


def test_lines_are_sorted_where_their_files_were_dealt(spark, monkeypatch):
    """The number of tasks follows from the files' characters, and lines are not shuffled after they are made."""
    from quaymark.sources import manifests

    monkeypatch.setattr(manifests, "TEXT_OF_TASK", 30)
    text = "dependencies:\n  a:\n    git: x\n  b: 1\nother:\n  c: 1\n"
    rows = manifests.pubspec_names(spark.createDataFrame([("r", f"{k}/pubspec.yaml", text) for k in range(3)], "repository_id string, path string, text string"))
    assert sorted((r.path, r.dependency) for r in rows.collect()) == [(f"{k}/pubspec.yaml", d) for k in range(3) for d in "ab"]
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and f", {-(-3 * len(text) // 30)}), REPARTITION_BY_NUM" in plan

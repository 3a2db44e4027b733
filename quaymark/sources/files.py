"""Source trees as rows, and the snapshot that they belong to."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 2_000_000
#: Extensions of text files to be read, next to those of languages.
TEXT_EXTENSIONS = ("kts", "swift", "json", "yaml", "yml", "toml", "xml", "gradle", "properties", "csproj")
PRUNED = (".git", "node_modules", "vendor", "dist", "build", ".venv", "__pycache__", "target")


class SnapshotError(ValueError):
    """The target is not the pinned root of a work tree."""


def git(root: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=True).stdout.strip()


def verify_snapshot(root: str, ref: str = "HEAD") -> dict[str, str | bool]:
    """Root, commit and dirty flag of a work tree whose ``ref`` is its HEAD; anything else is an error."""
    try:
        top, head, wanted = git(root, "rev-parse", "--show-toplevel"), git(root, "rev-parse", "HEAD"), git(root, "rev-parse", f"{ref}^{{commit}}")
        dirty = bool(git(root, "status", "--porcelain"))
    except (OSError, subprocess.CalledProcessError) as problem:
        raise SnapshotError(f"no readable git work tree at {root}") from problem
    if Path(top).resolve() != Path(root).resolve():
        raise SnapshotError(f"{root} is not the root of its work tree")
    if head != wanted:
        raise SnapshotError(f"{ref} is not checked out")
    return {"root": top, "source_commit": head, "dirty": dirty}


def tracked_files(spark: SparkSession, root: str, repository_id: str) -> DataFrame:
    """(repository_id, path) of the files that the work tree's commit holds."""
    names = [p for p in git(root, "ls-files", "-z").split("\0") if p]
    return spark.createDataFrame([(repository_id, p) for p in names], "repository_id string, path string")


def repository_identity(root: str, stated: str | None = None) -> tuple[str, str]:
    """(id, where it comes from): stated, else the origin's URL without credentials, else the folder's name."""
    import re

    if stated:
        return stated, "explicit"
    try:
        origin = git(root, "remote", "get-url", "origin")
    except (OSError, subprocess.CalledProcessError):
        origin = ""
    if origin:
        return re.sub(r"(?<=://)[^/@]*@", "", origin).removesuffix(".git"), "origin"
    return Path(root).resolve().name, "directory"


def submodules(text: str) -> list[str]:
    """Paths in a .gitmodules file."""
    import configparser

    parser = configparser.ConfigParser(strict=False, interpolation=None)
    parser.read_string("\n".join(line.strip() for line in text.splitlines()))
    return sorted(parser[s]["path"] for s in parser.sections() if "path" in parser[s])


def read_tree(spark: SparkSession, root: str, repository_id: str, extensions: Iterable[str] | None = None, exclude: Iterable[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """repository_id, path, length, sha256 and text (null where it is not UTF-8) of a tree's files.

    Paths and sizes are filtered in the scan, before contents are read. A file over ``max_bytes`` is
    never read: it is a row without sha256 and text.
    """
    from quaymark.functions.paths import excluded

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace("path", "^[a-z]+:/+", "/").alias("full")
    base = rows.where(F.col("length") <= max_bytes).select(full, "length", "content")
    base = base.unionByName(rows.where(F.col("length") > max_bytes).select(full, "length", F.lit(None).cast("binary").alias("content")))
    path = F.expr(f"substring(full, {len(str(Path(root)).rstrip('/')) + 2})") if "://" not in root else F.regexp_extract("full", f"{root.split('://', 1)[1].strip('/')}/(.*)$", 1)
    own = base.withColumn("path", path)
    pruned = F.exists(F.split("path", "/"), lambda p: p.isin(*PRUNED))
    own = own.where(~pruned & ~excluded(F.col("path"), exclude))
    if extensions:
        own = own.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return own.select(F.lit(repository_id).alias("repository_id"), "path", "length", F.sha2("content", 256).alias("sha256"), text.alias("text"))


def unread(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows (repository_id, path, detector, code, line) of code, configuration and manifests whose text was not read."""
    from quaymark.operators.inventory import LANGUAGES, extension
    from quaymark.sources.manifests import MANIFESTS

    name = F.element_at(F.split("path", "/"), -1)
    candidate = extension(F.col("path")).isin(*LANGUAGES, *TEXT_EXTENSIONS) | name.isin(*MANIFESTS)
    code = F.when(F.col("length") > max_bytes, "skipped_oversize").otherwise("text_read_failed")
    return files.where(F.col("text").isNull() & candidate).select("repository_id", "path", F.lit("inventory").alias("detector"), code.alias("code"), F.lit(None).cast("int").alias("line"))


def symlinks(root: str) -> list[str]:
    """Links of a tree, which are never followed."""
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_symlink() and not any(x in PRUNED for x in p.parts))

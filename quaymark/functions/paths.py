"""Paths and URLs of endpoints, as column expressions."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a placeholder, which may carry a pattern up to the first closing brace.
PLACEHOLDER = r"\{([A-Za-z_][A-Za-z0-9_-]*)(?::[^}]+)?\}"


def path_shape(path: Column) -> Column:
    """The path with its placeholders' names and patterns left out."""
    return F.regexp_replace(path, PLACEHOLDER, "{}")


def path_parameter_names(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(PLACEHOLDER), F.lit(1))


def canonical_path(path: Column) -> Column:
    """The path with its placeholders called param1, param2 and so on."""
    parts = F.split(path, PLACEHOLDER, -1)
    named = F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.lit("{param"), k.cast("string"), F.lit("}"), p)))
    return F.array_join(named, "")


def templated(text: Column) -> Column:
    """Interpolations of three styles, ``${x}``, ``{$x}`` and ``:x``, as placeholders."""
    braces = F.regexp_replace(F.regexp_replace(text, r"\$\{\s*([A-Za-z_]\w*)[^}]*\}", "{$1}"), r"\{\$([A-Za-z_]\w*)[^}]*\}", "{$1}")
    return F.regexp_replace(braces, r"(?<=/):([A-Za-z_]\w*)", "{$1}")


def split_url(text: Column) -> tuple[Column, Column]:
    """(base or null, path) of a literal URL; query and fragment go, an empty path is ``/``."""
    url = F.trim(text)
    whole = url.rlike(r"^https?://")
    base = F.when(whole, F.regexp_extract(url, r"^(https?://[^/?#]*)", 1))
    path = F.regexp_extract(F.when(whole, F.regexp_replace(url, r"^https?://[^/?#]*", "")).otherwise(url), r"^([^?#]*)", 1)
    return base, F.when(path == "", "/").otherwise(path)


def contract_path(path: Column) -> Column:
    """Of an absolute http(s) URL the path, if it has one; anything else as it is."""
    own = F.regexp_extract(path, r"^https?://[^/?#]*(/[^?#]*)", 1)
    return F.when(path.rlike(r"^https?://") & (own != ""), own).otherwise(path)


def excluded(path: Column, rules: Iterable[str]) -> Column:
    """Whether a path is one of the rules or lies below one."""
    found = F.lit(False)
    for rule in rules:
        clean = rule.replace("\\", "/").strip("/").removeprefix("./")
        found = found | (path == clean) | path.startswith(f"{clean}/")
    return found


def selected(selectors: Iterable[str], *values: Column) -> Column:
    """Whether any value matches any glob selector, in whole and by case."""
    found = F.lit(False)
    for selector in selectors:
        pattern = fnmatch.translate(selector)
        for value in values:
            found = found | F.coalesce(value.rlike(f"^(?:{pattern})"), F.lit(False))
    return found


def scope(endpoint_id: Column, method: Column, path: Column, include: Iterable[str], exclude: Iterable[str]) -> Column:
    """``required`` or ``excluded``: by the include list, if there is one, and then the exclude list."""
    shape = path_shape(path)
    values = (endpoint_id, path, shape, F.concat_ws(" ", method, path), F.concat_ws(" ", method, shape))
    inside = selected(include, *values) if include else F.lit(True)
    return F.when(inside & ~selected(exclude, *values), "required").otherwise("excluded")

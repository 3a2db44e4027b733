"""Stable identifiers from contents, equal on every run and engine."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def digest(prefix: str, length: int, *parts: Column) -> Column:
    """``prefix`` and the first hex digits of SHA-256 over the parts, null as empty, with a bar between."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.left(F.sha2(text, 256), F.lit(length)))


def endpoint_id(api_id: Column, direction: Column, method: Column, path: Column) -> Column:
    return digest("ep_", 20, F.coalesce(F.nullif(api_id, F.lit("")), F.lit("unknown-api")), F.lower(F.trim(direction)), F.upper(F.trim(method)), F.trim(path))


def _json_string(x: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\\\\\"), '"', r'\\\\"'), F.lit('"'))


def contract_id(direction: Column, method: Column, shape: Column, namespace: Column | None = None) -> Column:
    """The id of an endpoint's contract: a digest of canonical JSON with sorted keys.

    Names of parameters, hosts, lines and files do not count.
    """
    parts = [F.lit('{"direction":'), _json_string(direction), F.lit(',"method":'), _json_string(F.upper(method)), F.lit(',"path_shape":'), _json_string(shape)]
    if namespace is not None:
        parts.append(F.when(namespace.isNull(), "").otherwise(F.concat(F.lit(',"stable_namespace":'), _json_string(F.coalesce(namespace, F.lit(""))))))
    return F.concat(F.lit("endpoint-"), F.left(F.sha2(F.concat(*parts, F.lit("}")), 256), F.lit(20)))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys, no blanks and ASCII only; null where it is none."""

    @pandas_udf("string")
    def run(texts):
        def one(t):
            try:
                return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return run(text)

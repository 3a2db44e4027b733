"""PHP functions that hand a URL on to cURL, and the calls that say which URL.

Each file gives rows about its functions: where cURL takes its URL and method from a parameter or a
literal, and what is passed at each local call. Spark joins then follow the calls from such a function
to its callers, one call a step, until URL and method are literals. What stays a variable stays open.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.functions.frames import cut
from quaymark.functions.text import literal, mask_code, matching, split_top

MOST_CALLS = 8
ROWS = "repository_id string, path string, kind string, owner string, name string, arguments array<string>, line int, last int"
_FUNCTION = re.compile(r"\bfunction\s+(\w+)\s*\(")
_CALL = re.compile(r"(?:\$this\s*->\s*|self\s*::\s*|static\s*::\s*|(?<![\w>$:\\]))([A-Za-z_]\w*)\s*\(")
_TEMPLATE = re.compile(r"\{?\$(?:\w+\s*->\s*)*(\w+)\}?")


def meaning(expression: str, parameters: list[str]) -> str | None:
    """``p:2`` for the third parameter, ``l:text`` for a literal with placeholders for what is spliced in, else None."""
    expression = expression.strip()
    if expression in parameters:
        return f"p:{parameters.index(expression)}"
    parts = []
    for part in split_top(expression, "."):
        text = literal(part)
        if text is not None:
            parts.append(_TEMPLATE.sub(r"{\1}", text) if part.strip()[0] == '"' else text)
        elif parts and (name := re.fullmatch(r"\$(?:\w+->)*(\w+)", part.strip())):
            parts.append("{" + name[1] + "}")
        else:
            return None
    return "l:" + "".join(parts) if parts else None


def function_rows(text: str) -> Iterator[tuple[str, str, str | None, list[str | None], int, int]]:
    """(kind, owner, name, arguments, offset, end) of a file: ``curl`` with URL and method, ``call`` with what is passed."""
    code = mask_code(text, hash_comments=True)
    for f in _FUNCTION.finditer(code):
        close = matching(code, f.end() - 1)
        start = code.find("{", close)
        end = matching(code, start) if close > 0 and start > 0 else -1
        if end < 0 or ";" in code[close:start]:
            continue
        parameters = [m[0] for p in split_top(code[f.end() : close]) if (m := re.search(r"\$\w+", p))]
        body = code[start:end]
        for call in _CALL.finditer(body):
            stop = matching(body, call.end() - 1)
            given = split_top(body[call.end() : stop]) if stop > 0 else []
            if call[1] == "curl_init":
                said = re.search(r"CURLOPT_CUSTOMREQUEST\s*,\s*([^)]+)\)", body)
                post = re.search(r"CURLOPT_POST\s*,\s*(?:true|1)\b", body, re.IGNORECASE)
                url = re.search(r"CURLOPT_URL\s*,\s*([^)]+)\)", body)
                address = given[0] if given else url[1] if url else ""
                yield "curl", f[1], None, [meaning(address, parameters), meaning(said[1], parameters) if said else "l:POST" if post else "l:GET"], f.start(), end
            elif not call[1].startswith("curl_"):
                yield "call", f[1], call[1], [meaning(a, parameters) for a in given], start + call.start(), end


def curl_functions(files: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for repository, path, text in zip(frame["repository_id"], frame["path"], frame["text"], strict=True):
                ends = [m.start() for m in re.finditer("\n", text)]
                line = lambda at: bisect_right(ends, at - 1) + 1  # noqa: B023, E731
                out += [(repository, path, kind, owner, name, arguments, line(at), line(end)) for kind, owner, name, arguments, at, end in function_rows(text)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    return files.where(F.lower("path").endswith(".php") & F.col("text").contains("curl_init")).select("repository_id", "path", "text").mapInPandas(run, ROWS)


def wrapped_calls(files: DataFrame, most_calls: int = MOST_CALLS) -> tuple[DataFrame, DataFrame]:
    """(endpoints: repository_id, path, method, url, line), (functions: repository_id, path, first, last, whole).

    ``whole`` tells whether every local call of a function that hands a parameter to cURL came to literals:
    a caller that is called by nobody, calls beyond ``most_calls`` steps and cycles leave it open.
    A name that a file defines several times is not followed.
    """
    rows = cut(curl_functions(files))
    here = ["repository_id", "path"]
    single = rows.where("kind = 'curl'").groupBy(*here, "owner").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    given = rows.where("kind = 'curl'").join(single, [*here, "owner"], "left_semi")
    start = given.select(*here, F.col("owner").alias("source"), "owner", F.col("arguments")[0].alias("url"), F.col("arguments")[1].alias("method"), "line", "last")
    open_ = lambda c: F.col(c).startswith("p:")
    front = cut(start.where((open_("url") | open_("method")) & F.col("url").isNotNull() & F.col("method").isNotNull()))
    functions, steps = front.select(*here, "source", F.col("line").alias("first"), "last"), []
    calls = rows.where("kind = 'call'").select(*here, F.col("owner").alias("caller"), F.col("name").alias("owner"), "arguments", F.col("line").alias("at"))
    stuck = None
    for k in range(most_calls):
        passed = lambda c: F.when(open_(c), F.try_element_at("arguments", F.substring(c, 3, 9).cast("int") + 1)).otherwise(F.col(c))
        met = front.drop("line", "last").join(calls, [*here, "owner"])
        if k:  # what nobody calls has handed its parameter on to no end
            alone = front.join(calls, [*here, "owner"], "left_anti").select(*here, "source")
            stuck = alone if stuck is None else stuck.unionByName(alone)
        step = cut(met.select(*here, "source", F.col("caller").alias("owner"), passed("url").alias("url"), passed("method").alias("method"), F.col("at").alias("line")).distinct())
        steps.append(step)
        front = step.where("url IS NOT NULL AND method IS NOT NULL").where(open_("url") | open_("method")).withColumn("last", F.col("line"))
        if front.isEmpty():
            break
    # Calls beyond the last step, around a cycle or not, are open too.
    left = front.select(*here, "source")
    stuck = (left if stuck is None else stuck.unionByName(left)).distinct().withColumn("open", F.lit(True))
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step)
    done = F.coalesce(F.col("url").startswith("l:") & F.col("method").startswith("l:"), F.lit(False))
    found = every.where(done).select(*here, F.upper(F.expr("substring(method, 3)")).alias("method"), F.expr("substring(url, 3)").alias("url"), "line").distinct()
    # Calls that only hand parameters on are judged by their own callers.
    handed = F.coalesce(open_("url") | open_("method"), F.lit(False)) & F.col("url").isNotNull() & F.col("method").isNotNull()
    judged = every.groupBy(*here, "source").agg(F.count_if(done).alias("good"), F.count_if(~done & ~handed).alias("bad"))
    whole = F.coalesce((F.col("good") > 0) & (F.col("bad") == 0), F.lit(False)) & F.col("open").isNull()
    return found, functions.join(judged, [*here, "source"], "left").join(stuck, [*here, "source"], "left").select(*here, "first", "last", whole.alias("whole"))

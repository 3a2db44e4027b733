"""Source facts of endpoints as catalog facts: statuses, requiredness and parameters that the path implies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaymark.functions.paths import path_parameter_names
from quaymark.functions.tri import strings

#: The note that holds a contract's status, and the catalog's word for each.
STATUS_NOTE = "contract_enrichment_status"
CONTRACT_STATUSES = {
    "evaluated_complete": "complete", "evaluated_partial": "partial", "required_not_complete": "partial", "not_applicable": "not_applicable",
    "complete": "complete", "partial": "partial", "unresolved": "unresolved", "unknown": "unknown",
}
SEMANTIC_STATUSES = ("complete", "partial", "unresolved")
PARAMETER = "struct<required:boolean,type:string,format:string>"


def note_value(notes: Column, name: str) -> Column:
    """The value of the first ``name=value`` note, or null."""
    first = F.try_element_at(F.filter(notes, lambda x: x.startswith(f"{name}=")), F.lit(1))
    return F.substring(first, F.lit(len(name) + 2), F.length(first))


def contract_status(notes: Column) -> Column:
    """The catalog's contract status; without a note, or with a word of no meaning, it is unknown."""
    words = F.create_map(*[F.lit(x) for pair in CONTRACT_STATUSES.items() for x in pair])
    return F.coalesce(F.try_element_at(words, note_value(notes, STATUS_NOTE)), F.lit("unknown"))


def semantic_status(value: Column) -> Column:
    return F.when(value.isin(*SEMANTIC_STATUSES), value).otherwise("unknown")


def requiredness(fields: Column, required: Column, optional: Column) -> tuple[Column, Column, Column]:
    """(required, optional, unknown) names in order: what is required is not optional, and the fields that are neither are unknown."""
    every, need = strings(fields), strings(required)
    free = F.array_except(F.array_intersect(strings(optional), every), need)
    return need, F.array_sort(free), F.array_sort(F.array_except(F.array_except(every, need), free))


def with_path_parameters(parameters: Column, path: Column) -> Column:
    """A map of parameters by ``location:name``, completed by the path's placeholders that it lacks, which are required."""
    known = F.coalesce(parameters, F.from_json(F.lit("{}"), f"map<string,{PARAMETER}>"))
    names = F.transform(F.array_distinct(path_parameter_names(path)), lambda n: F.concat(F.lit("path:"), n))
    missing = F.filter(names, lambda n: ~F.map_contains_key(known, n))
    implied = F.struct(F.lit(True).alias("required"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("format"))
    return F.map_concat(known, F.map_from_entries(F.transform(missing, lambda n: F.struct(n.alias("k"), implied.alias("v")))))

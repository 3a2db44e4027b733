"""Constraints on documents as predicates; what breaks one becomes a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    """What a column must be. ``types``: string, integer, number, boolean, date-time, of JSON text if ``json_path`` is given."""

    column: str
    required: bool = True
    one_of: tuple[str, ...] | None = None
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    min_length: int | None = None
    date_time: bool = False
    integer: bool = False
    json_path: str | None = None

    @property
    def name(self) -> str:
        return self.column + (self.json_path or "")[1:]

    def checks(self) -> list[tuple[str, Column]]:
        """(rule, whether it is broken)."""
        x = F.get_json_object(self.column, self.json_path) if self.json_path else F.col(self.column)
        text, number = x.cast("string"), F.expr(f"try_cast({'get_json_object(' + self.column + ', ' + repr(self.json_path) + ')' if self.json_path else self.column} AS DOUBLE)")
        out = [("required", x.isNull())] if self.required else []
        if self.one_of is not None:
            out.append(("enum", ~text.isin(*self.one_of)))
        if self.pattern is not None:
            out.append(("pattern", ~text.rlike(self.pattern)))
        if self.min_length is not None:
            out.append(("minLength", F.length(text) < self.min_length))
        if self.date_time:
            out.append(("date-time", x.isNotNull() & F.try_to_timestamp(text).isNull()))
        if self.integer:
            out.append(("type", x.isNotNull() & (number.isNull() | (number != F.floor(number)))))
        if self.least is not None:
            out.append(("minimum", number < self.least))
        if self.most is not None:
            out.append(("maximum", number > self.most))
        return out


def violations(rows: DataFrame, key: str, constraints: list[Constraint]) -> DataFrame:
    """(key, field, rule) of each broken constraint."""
    tests = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(c.name).alias("field"), F.lit(rule).alias("rule"))) for c in constraints for rule, broken in c.checks()]
    return rows.select(key, F.explode(F.array_compact(F.array(*tests))).alias("v")).select(key, "v.field", "v.rule")


class Invalid(ValueError):
    """A document breaks its schema."""


def require_valid(rows: DataFrame, key: str, constraints: list[Constraint]) -> None:
    found = violations(rows, key, constraints).limit(5).collect()
    if found:
        raise Invalid("; ".join(f"{r[0]}: {r.field} breaks {r.rule}" for r in found))


def schema_fields(schema: Column) -> Column:
    """Names under ``properties`` of a JSON schema, in order."""
    return F.coalesce(F.array_sort(F.json_object_keys(F.get_json_object(schema, "$.properties"))), F.array().cast("array<string>"))


def schema_required(schema: Column) -> Column:
    """Names that a JSON schema lists as required, in order."""
    return F.coalesce(F.array_sort(F.array_distinct(F.from_json(F.get_json_object(schema, "$.required"), "array<string>"))), F.array().cast("array<string>"))


def schema_profile(schema: Column, field: str) -> tuple[Column, Column]:
    """(type, format) of one property, whatever its name holds."""
    properties = F.from_json(F.get_json_object(schema, "$.properties"), "map<string,string>")
    one = F.try_element_at(properties, F.lit(field))
    return F.get_json_object(one, "$.type"), F.get_json_object(one, "$.format")

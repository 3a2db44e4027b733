"""Contracts compared: a reference with a candidate, field by field.

Every rule is an expression that gives an array of findings (classification, code, detail); a row's
class is its worst finding: breaking, then unknown, then additive, then same. Unknown facts stay
unknown, on either side.

A contract is a struct with ``request`` (fields, required_fields, optional_fields,
unknown_requiredness_fields, content_type, types and formats by field), ``response`` (fields,
optional_fields, status_codes, content_type, types, formats, tolerates_additional_fields,
status_code_compatibility), ``parameters`` (map of ``location:name`` to a struct of required, type
and format), ``authentication`` (authentication, authorization, credential_format, scheme,
header_semantics, schemes), ``contract_status``, ``semantic_status``, ``materiality`` and
``behavior`` (maps ``response_semantics`` and ``side_effects``, set ``internal``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions.tri import given, is_false, is_true, stricter, strings

FINDING = "array<struct<classification:string,code:string,detail:string>>"
REQUEST = "struct<fields:array<string>,required_fields:array<string>,optional_fields:array<string>,unknown_requiredness_fields:array<string>,content_type:string,types:map<string,string>,formats:map<string,string>,accepts_additional_fields:boolean,rejects_additional_fields:boolean,accepts_additional_parameters:boolean,rejects_additional_parameters:boolean>"
RESPONSE = "struct<fields:array<string>,required_fields:array<string>,optional_fields:array<string>,fields_used_by_consumer:array<string>,status_codes:array<int>,content_type:string,types:map<string,string>,formats:map<string,string>,tolerates_additional_fields:boolean,tolerates_additional_statuses:boolean,status_code_compatibility:map<string,string>>"
PARAMETERS = "map<string,struct<required:boolean,type:string,format:string>>"
AUTHENTICATION = "struct<authentication:string,authorization:string,credential_format:string,scheme:string,header_semantics:string,schemes:array<string>,required:boolean>"
BEHAVIOR = "struct<response_semantics:map<string,string>,side_effects:map<string,string>,internal:array<string>>"
CONTRACT = f"struct<request:{REQUEST},response:{RESPONSE},parameters:{PARAMETERS},authentication:{AUTHENTICATION},contract_status:string,semantic_status:string,materiality:string,behavior:{BEHAVIOR}>"
#: Classes of findings from least to worst; the codes in this file's rules and in ``consumption`` are fixed values too.
RANKS = {"same": 0, "additive": 1, "unknown": 2, "breaking": 3}


def finding(kind: str, code: Column | str, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("classification"), (F.lit(code) if isinstance(code, str) else code).alias("code"), detail.cast("string").alias("detail"))


def none() -> Column:
    return F.array().cast(FINDING)


def when(test: Column, *found: Column) -> Column:
    """The findings where the test is true; an unknown test is not."""
    return F.when(F.coalesce(test, F.lit(False)), F.array(*found)).otherwise(none())


def each(items: Column, kind: str, code: str) -> Column:
    return F.transform(items, lambda x: finding(kind, code, x))


def compare_profile(before: tuple[Column, Column], after: tuple[Column, Column], detail: Column, codes: dict[str, str | Column]) -> Column:
    """Type and format of one thing: different is breaking, not known on either side unknown.

    Formats may both be missing; only one missing is unknown.
    """
    (type_a, format_a), (type_b, format_b) = before, after
    known = given(type_a) & given(type_b)
    return F.concat(
        when(~known, finding("unknown", codes["unknown_type"], detail)),
        when(known & (type_a != type_b), finding("breaking", codes["type"], detail)),
        when(given(format_a) & given(format_b) & (format_a != format_b), finding("breaking", codes["format"], detail)),
        when(given(format_a) != given(format_b), finding("unknown", codes["unknown_format"], detail)),
    )


def _profile(side: Column, field: Column) -> tuple[Column, Column]:
    return F.try_element_at(side["types"], field), F.try_element_at(side["formats"], field)


def _each_profile(a: Column, b: Column, fields: Column, part: str) -> Column:
    codes = {"type": f"{part}_field_type_changed", "format": f"{part}_field_format_changed", "unknown_type": f"{part}_field_type_unknown", "unknown_format": f"{part}_field_format_unknown"}
    return F.flatten(F.transform(fields, lambda f: compare_profile(_profile(a, f), _profile(b, f), f, codes)))


def _content_type(a: Column, b: Column, material: Column, part: str) -> Column:
    x, y = a["content_type"], b["content_type"]
    differ = given(x) & given(y) & (x != y)
    return F.concat(
        when(differ, finding("breaking", f"{part}_content_type_incompatible", F.concat_ws(" != ", x, y))),
        when(~differ & material & (x.isNull() | y.isNull()), finding("unknown", f"{part}_content_type_unknown", F.lit("missing"))),
    )


def compare_request(a: Column, b: Column) -> Column:
    fields_a, fields_b, need_a, need_b = strings(a["fields"]), strings(b["fields"]), strings(a["required_fields"]), strings(b["required_fields"])
    added = F.array_sort(F.array_except(F.array_except(fields_b, fields_a), need_b))
    unsure = F.array_sort(F.array_union(strings(a["unknown_requiredness_fields"]), strings(b["unknown_requiredness_fields"])))
    optional = strings(b["optional_fields"])
    return F.concat(
        each(F.array_sort(F.array_except(need_a, fields_b)), "breaking", "required_request_field_removed"),
        each(F.array_sort(F.array_except(need_b, fields_a)), "breaking", "required_request_field_added"),
        each(F.array_intersect(added, optional), "additive", "optional_request_field_added"),
        each(F.array_except(added, optional), "unknown", "request_field_requiredness_unknown"),
        each(unsure, "unknown", "request_field_requiredness_unknown"),
        _each_profile(a, b, F.array_sort(F.array_intersect(fields_a, fields_b)), "request"),
        _content_type(a, b, (F.size(fields_a) > 0) | (F.size(fields_b) > 0), "request"),
    )


def compare_response(a: Column, b: Column) -> Column:
    fields_a, fields_b = strings(a["fields"]), strings(b["fields"])
    codes_a, codes_b = (F.array_sort(F.array_distinct(F.array_compact(F.coalesce(x["status_codes"], F.array().cast("array<int>"))))) for x in (a, b))
    added = F.array_sort(F.array_except(fields_b, fields_a))
    tolerated = F.when(is_true(a["tolerates_additional_fields"]), F.array_intersect(added, F.array_except(strings(b["optional_fields"]), strings(b["required_fields"])))).otherwise(F.array().cast("array<string>"))

    def new_status(code: Column) -> Column:
        says = F.try_element_at(F.coalesce(b["status_code_compatibility"], F.create_map().cast("map<string,string>")), code.cast("string"))
        kind = F.when(says.eqNullSafe(F.lit("breaking")), "breaking").when(says.eqNullSafe(F.lit("compatible")), "additive").otherwise("unknown")
        name = F.when(kind == "breaking", "response_status_added_breaking").when(kind == "additive", "response_status_added_compatible").otherwise("response_status_added_unknown")
        return F.struct(kind.alias("classification"), name.alias("code"), code.cast("string").alias("detail"))

    return F.concat(
        each(F.array_sort(F.array_except(fields_a, fields_b)), "breaking", "response_field_removed"),
        _each_profile(a, b, F.array_sort(F.array_intersect(fields_a, fields_b)), "response"),
        F.transform(F.array_sort(F.array_except(codes_a, codes_b)), lambda c: finding("breaking", "response_status_removed", c)),
        F.transform(F.array_sort(F.array_except(codes_b, codes_a)), new_status),
        when(F.size(tolerated) > 0, finding("additive", "response_fields_added_compatible", F.array_join(tolerated, ","))),
        each(F.array_except(added, tolerated), "unknown", "response_field_addition_compatibility_unknown"),
        _content_type(a, b, (F.size(fields_a) > 0) | (F.size(fields_b) > 0), "response"),
    )


def _map(x: Column) -> Column:
    return F.coalesce(x, F.create_map().cast(PARAMETERS))


def compare_parameters(a: Column, b: Column) -> Column:
    """Parameters by ``location:name``."""
    a, b = _map(a), _map(b)

    def known(key: Column) -> Column:
        x, y, path = F.try_element_at(a, key), F.try_element_at(b, key), key.startswith("path:")
        codes = {
            "type": F.when(path, "path_parameter_incompatible_type").otherwise("parameter_incompatible_type"),
            "format": F.when(path, "path_parameter_incompatible_format").otherwise("parameter_incompatible_format"),
            "unknown_type": "parameter_type_unknown",
            "unknown_format": "parameter_format_unknown",
        }
        return F.concat(
            when(x["required"].isNull() | y["required"].isNull(), finding("unknown", "parameter_requiredness_unknown", key)),
            when(stricter(x["required"], y["required"]), finding("breaking", "parameter_requiredness_became_stricter", key)),
            compare_profile((x["type"], x["format"]), (y["type"], y["format"]), key, codes),
        )

    def new(key: Column) -> Column:
        need, header = F.try_element_at(b, key)["required"], key.startswith("header:")
        kind = F.when(is_true(need), "breaking").when(is_false(need), "additive").otherwise("unknown")
        code = (
            F.when(is_true(need), F.when(header, "required_header_added").otherwise("required_parameter_added"))
            .when(is_false(need), F.when(key.startswith("query:"), "optional_query_parameter_added").otherwise("optional_parameter_added"))
            .otherwise(F.when(header, "header_compatibility_unknown").otherwise("parameter_requiredness_unknown"))
        )
        return F.struct(kind.alias("classification"), code.alias("code"), key.alias("detail"))

    keys_a, keys_b = F.map_keys(a), F.map_keys(b)
    removed = F.transform(F.array_sort(F.array_except(keys_a, keys_b)), lambda k: finding("breaking", F.when(k.startswith("path:"), "path_parameter_removed").otherwise("parameter_removed"), k))
    return F.concat(removed, F.flatten(F.transform(F.array_sort(F.array_intersect(keys_a, keys_b)), known)), F.transform(F.array_sort(F.array_except(keys_b, keys_a)), new))


MECHANISM = ("authentication", "authorization", "credential_format", "scheme", "header_semantics")


def auth_demonstrated(x: Column) -> Column:
    found = F.size(strings(x["schemes"])) > 0
    for name in MECHANISM:
        found = found | given(x[name])
    return found


def auth_strength(x: Column) -> Column:
    """0 without a mechanism, 1 with authentication, 2 with authorization as well."""
    return F.when(~auth_demonstrated(x), 0).when(given(x["authorization"]), 2).otherwise(1)


def compare_authentication(a: Column, b: Column, enforce_policy: bool = False) -> Column:
    up, down = auth_strength(b) > auth_strength(a), auth_strength(b) < auth_strength(a)
    both = auth_demonstrated(a) & auth_demonstrated(b)
    attributes = [when(both & (F.coalesce(a[n], F.lit("")) != F.coalesce(b[n], F.lit(""))), finding("breaking", "auth_mechanism_incompatible", F.lit(n))) for n in MECHANISM if n != "authorization"]
    return F.concat(
        when(up, finding("breaking", "authentication_stricter", F.lit("authentication"))),
        when(down, finding("breaking" if enforce_policy else "same", "security_policy_drift_weaker_authentication", F.lit("authentication"))),
        when(auth_demonstrated(a) != auth_demonstrated(b), finding("unknown", "auth_mechanism_compatibility_unknown", F.lit("authentication"))),
        *attributes,
    )


def semantics_unknown(x: Column) -> Column:
    weak = F.coalesce(x["semantic_status"].isin("unknown", "unresolved"), F.lit(True))
    return weak | ((x["semantic_status"] == "partial") & F.coalesce(x["materiality"].isin("external", "unknown"), F.lit(True)))


def compare_behavior(a: Column, b: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    sa, sb, ea, eb = (F.coalesce(x["behavior"][n], empty) for n in ("response_semantics", "side_effects") for x in (a, b))
    unknown = semantics_unknown(a) | semantics_unknown(b)

    def added_effect(k: Column) -> Column:
        says = F.try_element_at(eb, k)
        kind = F.when(says.eqNullSafe(F.lit("compatible")), "additive").when(says.eqNullSafe(F.lit("incompatible")), "breaking").otherwise("unknown")
        code = F.concat(F.lit("external_side_effect_added_"), F.when(kind == "additive", "compatible").otherwise(kind))
        return F.struct(kind.alias("classification"), code.alias("code"), k.alias("detail"))

    differing = F.filter(F.array_intersect(F.map_keys(sa), F.map_keys(sb)), lambda k: F.try_element_at(sa, k) != F.try_element_at(sb, k))
    known = F.concat(
        each(F.array_sort(differing), "breaking", "response_semantics_incompatible"),
        each(F.array_sort(F.array_except(F.map_keys(sa), F.map_keys(sb))), "unknown", "response_semantics_missing"),
        each(F.array_sort(F.array_except(F.map_keys(sb), F.map_keys(sa))), "additive", "response_semantics_added"),
        each(F.array_sort(F.array_except(F.map_keys(ea), F.map_keys(eb))), "breaking", "external_side_effect_removed"),
        F.transform(F.array_sort(F.array_except(F.map_keys(eb), F.map_keys(ea))), added_effect),
        when(strings(a["behavior"]["internal"]) != strings(b["behavior"]["internal"]), finding("same", "internal_semantic_drift_reported", F.lit("internal"))),
    )
    return F.when(unknown, F.array(finding("unknown", "semantic_behavior_unknown", F.lit("behavior")))).otherwise(known)


def material_unknown(x: Column) -> Column:
    """Reasons for which one side's contract is not known well enough, in order."""
    request, response, parameters = x["request"], x["response"], _map(x["parameters"])
    fields = F.size(strings(request["fields"])) > 0
    shown = F.size(strings(response["fields"])) > 0
    unsure = F.filter(F.map_entries(parameters), lambda e: e["value"]["required"].isNull())
    untyped = F.filter(F.map_entries(parameters), lambda e: ~given(e["value"]["type"]))
    reason = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    location = lambda e, what: F.concat(F.substring_index(e["key"], ":", 1), F.lit(f"_parameter_{what}"))
    simple = F.array(
        reason(F.coalesce(x["contract_status"], F.lit("unknown")).isin("unknown", "partial"), "contract_status"),
        reason(F.coalesce(x["semantic_status"], F.lit("unknown")).isin("unknown", "unresolved"), "semantic_status"),
        reason(F.size(strings(request["unknown_requiredness_fields"])) > 0, "request_requiredness"),
        reason(fields & request["content_type"].isNull(), "request_content_type"),
        reason(F.size(F.coalesce(response["status_codes"], F.array().cast("array<int>"))) == 0, "response"),
        reason(shown & response["content_type"].isNull(), "response_content_type"),
        reason(~auth_demonstrated(x["authentication"]), "authentication"),
    )
    return F.array_distinct(F.concat(F.array_compact(simple), F.array_sort(F.transform(unsure, lambda e: location(e, "requiredness"))), F.array_sort(F.transform(untyped, lambda e: location(e, "type")))))


def rank(kind: Column) -> Column:
    found = None
    for name, value in RANKS.items():
        found = F.when(kind == name, value) if found is None else found.when(kind == name, value)
    return found


def worst(findings: Column) -> Column:
    """The class of the worst finding: breaking, unknown, additive, same."""
    kinds = F.transform(findings, lambda f: f["classification"])
    return F.when(F.array_contains(kinds, "breaking"), "breaking").when(F.array_contains(kinds, "unknown"), "unknown").when(F.array_contains(kinds, "additive"), "additive").otherwise("same")


def compare_contracts(reference: DataFrame, candidate: DataFrame, keys: list[str], enforce_policy: bool = False) -> DataFrame:
    """Full outer join of two catalogs (keys and ``contract``): findings, reasons and class of each endpoint."""
    pair = reference.select(*keys, F.col("contract").alias("a")).join(candidate.select(*keys, F.col("contract").alias("b")), keys, "full_outer")
    a, b = F.col("a"), F.col("b")
    rules = F.concat(
        compare_parameters(a["parameters"], b["parameters"]), compare_request(a["request"], b["request"]), compare_response(a["response"], b["response"]),
        compare_authentication(a["authentication"], b["authentication"], enforce_policy), compare_behavior(a, b),
    )
    findings = F.when(b.isNull(), F.array(finding("breaking", "endpoint_removed", F.lit("endpoint")))).when(a.isNull(), F.array(finding("additive", "endpoint_added", F.lit("endpoint")))).otherwise(rules)
    reasons = F.when(a.isNull() | b.isNull(), F.array().cast("array<string>")).otherwise(F.array_union(material_unknown(a), material_unknown(b)))
    out = pair.select(*keys, a.isNotNull().alias("required"), findings.alias("findings"), reasons.alias("unknown_reasons"))
    plain = worst(F.col("findings"))
    return out.withColumn("classification", F.when((F.size("unknown_reasons") > 0) & plain.isin("same", "additive"), "unknown").otherwise(plain))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def summary(compared: DataFrame) -> DataFrame:
    """Counts by class and by kind of finding, in one row."""
    classes = [F.count_if(F.col("classification") == k).alias(k) for k in RANKS]
    kinds = F.transform("findings", lambda f: f["classification"])
    findings = [F.coalesce(F.sum(F.size(F.filter(kinds, _is(k)))), F.lit(0)).cast("bigint").alias(f"{k}_findings") for k in RANKS]
    drift = F.coalesce(F.sum(F.size(F.filter("findings", lambda f: f["code"].startswith("security")))), F.lit(0)).cast("bigint")
    return compared.agg(F.count("*").alias("endpoints"), F.count_if("required").alias("required_endpoints"), *classes, *findings, drift.alias("security_drift"))


def gate(mode: str, breaking: Column, unknown: Column) -> Column:
    """``passed`` or ``failed``: report never fails, breaking fails on breaking, strict on unknown too."""
    fails = {"report": F.lit(False), "breaking": breaking, "strict": breaking | unknown}[mode]
    return F.when(fails, "failed").otherwise("passed")

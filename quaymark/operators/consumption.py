"""Whether a consumer can live with the provider that it calls.

Checks carry a status (breaking, unknown, compatible) in the field ``classification``; a record's
status is its worst check, or missing and ambiguous where there is not exactly one provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions.tri import given, is_false, is_true, strings
from quaymark.operators.compatibility import (
    MECHANISM,
    _map,
    _profile,
    auth_demonstrated,
    auth_strength,
    compare_profile,
    each,
    finding,
    when,
)


def tolerance(extra: Column, accepts: Column, rejects: Column, codes: tuple[str, str, str]) -> Column:
    """Additional things as one check: accepted, rejected or not known."""
    some, listed = F.size(extra) > 0, F.array_join(extra, ",")
    return F.concat(
        when(some & accepts, finding("compatible", codes[0], listed)),
        when(some & ~accepts & rejects, finding("breaking", codes[1], listed)),
        when(some & ~accepts & ~rejects, finding("unknown", codes[2], listed)),
    )


def _profiles(a: Column, b: Column, fields: Column, part: str) -> Column:
    codes = {"type": f"{part}_field_type_incompatible", "format": f"{part}_field_format_incompatible", "unknown_type": f"{part}_field_type_unknown", "unknown_format": f"{part}_field_format_unknown"}
    return F.flatten(F.transform(fields, lambda f: compare_profile(_profile(a, f), _profile(b, f), f, codes)))


def check_status(a: Column, b: Column) -> Column:
    """Contracts and semantics that are not complete, on either side; an internal part may stay open."""
    out = []
    for role, x in (("consumer", a), ("provider", b)):
        out.append(when(F.coalesce(x["contract_status"].isin("partial", "unresolved", "unknown"), F.lit(True)), finding("unknown", f"{role}_contract_status_partial", x["contract_status"])))
        weak = F.coalesce(x["semantic_status"].isin("unknown", "unresolved"), F.lit(True)) | ((x["semantic_status"] == "partial") & ~F.coalesce(x["materiality"] == "internal", F.lit(False)))
        out.append(when(weak, finding("unknown", f"{role}_semantic_status_partial", x["semantic_status"])))
    return F.concat(*out)


def check_request(a: Column, b: Column) -> Column:
    sent, known, need = strings(a["fields"]), strings(b["fields"]), strings(b["required_fields"])
    unsure = [each(strings(x["unknown_requiredness_fields"]), "unknown", f"{role}_request_requiredness_unknown") for role, x in (("consumer", a), ("provider", b))]
    return F.concat(
        *unsure,
        each(F.array_sort(F.array_except(need, sent)), "breaking", "provider_requires_unsent_request_field"),
        tolerance(F.array_sort(F.array_except(sent, known)), is_true(b["accepts_additional_fields"]), is_true(b["rejects_additional_fields"]), ("provider_accepts_additional_request_fields", "provider_rejects_consumer_request_field", "provider_request_field_acceptance_unknown")),
        _profiles(a, b, F.array_sort(F.array_intersect(sent, known)), "request"),
    )


def check_response(a: Column, b: Column) -> Column:
    used = F.when(F.size(strings(a["fields_used_by_consumer"])) > 0, strings(a["fields_used_by_consumer"])).otherwise(strings(a["required_fields"]))
    known, none = strings(b["fields"]), F.array().cast("array<int>")
    extra = F.when(F.size(used) > 0, F.array_sort(F.array_except(known, used))).otherwise(F.array().cast("array<string>"))
    want, have = (F.array_sort(F.array_distinct(F.array_compact(F.coalesce(x["status_codes"], none)))) for x in (a, b))
    more, fields, statuses = F.array_except(have, want), a["tolerates_additional_fields"], a["tolerates_additional_statuses"]
    return F.concat(
        when(F.size(used) == 0, finding("unknown", "consumer_response_requirements_unknown", F.lit("response"))),
        when((F.size(known) == 0) & b["types"].isNull(), finding("unknown", "provider_response_schema_unknown", F.lit("response"))),
        each(F.array_sort(F.array_except(used, known)), "breaking", "provider_missing_required_response_field"),
        tolerance(extra, is_true(fields), is_false(fields), ("consumer_tolerates_additional_response_fields", "consumer_rejects_additional_response_fields", "consumer_response_field_tolerance_unknown")),
        _profiles(a, b, F.array_sort(F.array_intersect(used, known)), "response"),
        when(F.size(want) == 0, finding("unknown", "consumer_status_codes_unknown", F.lit("status"))),
        when(F.size(have) == 0, finding("unknown", "provider_status_codes_unknown", F.lit("status"))),
        F.transform(F.array_except(want, have), lambda c: finding("breaking", "provider_missing_required_status_code", c)),
        tolerance(F.transform(more, lambda c: c.cast("string")), is_true(statuses), is_false(statuses), ("consumer_tolerates_additional_status_codes", "consumer_rejects_additional_status_codes", "consumer_status_code_tolerance_unknown")),
    )


def check_parameters(a: Column, b: Column, provider_request: Column) -> Column:
    a, b = _map(a), _map(b)
    rejects, accepts = is_true(provider_request["rejects_additional_parameters"]), is_true(provider_request["accepts_additional_parameters"])
    own = []
    for role, x in (("consumer", a), ("provider", b)):
        own.append(each(F.array_sort(F.map_keys(F.map_filter(x, lambda _, v: v["required"].isNull()))), "unknown", f"{role}_parameter_requiredness_unknown"))
        own.append(each(F.array_sort(F.map_keys(F.map_filter(x, lambda _, v: v["type"].isNull()))), "unknown", f"{role}_parameter_type_unknown"))
    needed = F.array_sort(F.array_except(F.map_keys(F.map_filter(b, lambda _, v: is_true(v["required"]))), F.map_keys(a)))

    def unknown_to_provider(k: Column) -> Column:
        kind = F.when(rejects, "breaking").when(accepts, "compatible").otherwise("unknown")
        code = F.when(rejects, "provider_rejects_consumer_parameter").when(accepts, "provider_accepts_consumer_parameter").otherwise("provider_parameter_acceptance_unknown")
        return F.struct(kind.alias("classification"), code.alias("code"), k.alias("detail"))

    def shared(k: Column) -> Column:
        x, y, path = F.try_element_at(a, k), F.try_element_at(b, k), k.startswith("path:")
        codes = {
            "type": F.when(path, "path_parameter_type_incompatible").otherwise("parameter_type_incompatible"),
            "format": F.when(path, "path_parameter_format_incompatible").otherwise("parameter_format_incompatible"),
            "unknown_type": "parameter_type_unknown",
            "unknown_format": "parameter_format_unknown",
        }
        return F.concat(when(x["required"].isNull() | y["required"].isNull(), finding("unknown", "parameter_requiredness_unknown", k)), compare_profile((x["type"], x["format"]), (y["type"], y["format"]), k, codes))

    return F.concat(
        *own,
        each(needed, "breaking", "provider_requires_unsent_parameter"),
        F.transform(F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b))), unknown_to_provider),
        F.flatten(F.transform(F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b))), shared)),
    )


def check_content_types(a: Column, b: Column) -> Column:
    size = lambda x: F.size(strings(x)) > 0
    out = []
    material = {
        "request": size(a["request"]["fields"]) | size(b["request"]["fields"]) | size(b["request"]["required_fields"]),
        "response": size(a["response"]["fields_used_by_consumer"]) | size(a["response"]["required_fields"]) | size(b["response"]["fields"]),
    }
    for part, matters in material.items():
        x, y = a[part]["content_type"], b[part]["content_type"]
        differ = given(x) & given(y) & (x != y)
        out.append(when(differ, finding("breaking", f"{part}_content_type_incompatible", F.concat_ws(" != ", x, y))))
        out.append(when(~differ & matters & (x.isNull() | y.isNull()), finding("unknown", f"{part}_content_type_unknown", F.lit("missing"))))
    return F.concat(*out)


def check_authentication(a: Column, b: Column, enforce_policy: bool = False) -> Column:
    sends = is_true(a["required"]) | given(a["authentication"])
    weaker = (auth_strength(b) < auth_strength(a)) & auth_demonstrated(b)
    both = auth_demonstrated(a) & auth_demonstrated(b)
    attributes = []
    for name in MECHANISM:
        attributes.append(when(both & given(b[name]) & ~given(a[name]), finding("unknown", "consumer_credential_mechanism_unknown", F.lit(name))))
        attributes.append(when(both & given(b[name]) & given(a[name]) & (a[name] != b[name]), finding("breaking", "consumer_credential_mechanism_incompatible", F.lit(name))))
    return F.concat(
        when(is_true(b["required"]) & ~sends, finding("breaking", "provider_requires_authentication_not_sent_by_consumer", F.lit("authentication"))),
        when(b["required"].isNull(), finding("unknown", "provider_authentication_requiredness_unknown", F.lit("authentication"))),
        when(weaker, finding("breaking" if enforce_policy else "compatible", "security_policy_drift_weaker_provider_authentication", F.lit("authentication"))),
        when(sends & ~auth_demonstrated(b), finding("unknown", "auth_mechanism_compatibility_unknown", F.lit("authentication"))),
        *attributes,
    )


def record_status(checks: Column) -> Column:
    kinds = F.transform(checks, lambda f: f["classification"])
    return F.when(F.array_contains(kinds, "breaking"), "breaking").when(F.array_contains(kinds, "unknown"), "unknown").otherwise("compatible")


def check_consumers(consumers: DataFrame, providers: DataFrame, keys: list[str], consumer_id: str, enforce_policy: bool = False) -> DataFrame:
    """Each consumer (id, keys and ``contract``) with its checks and status; providers have keys and ``contract``.

    Providers are counted by key first and only keys with one provider join their contracts, so an
    ambiguous key multiplies nothing.
    """
    counted = providers.groupBy(*keys).agg(F.count("*").alias("n_providers"))
    single = providers.join(counted.where("n_providers = 1"), keys, "left_semi").select(*keys, F.col("contract").alias("b"))
    rows = consumers.select(consumer_id, *keys, F.col("contract").alias("a")).join(counted, keys, "left").join(single, keys, "left")
    a, b = F.col("a"), F.col("b")
    rules = F.concat(
        check_status(a, b), check_request(a["request"], b["request"]), check_response(a["response"], b["response"]), check_parameters(a["parameters"], b["parameters"], b["request"]),
        check_content_types(a, b), check_authentication(a["authentication"], b["authentication"], enforce_policy),
    )
    n = F.coalesce("n_providers", F.lit(0))
    checks = F.when(n == 0, F.array(finding("breaking", "provider_missing", F.lit("provider")))).when(n > 1, F.array(finding("unknown", "provider_ambiguous", n))).otherwise(rules)
    out = rows.select(consumer_id, *keys, n.cast("bigint").alias("n_providers"), checks.alias("checks"))
    return out.withColumn("status", F.when(F.col("n_providers") == 0, "missing").when(F.col("n_providers") > 1, "ambiguous").otherwise(record_status(F.col("checks"))))


STATUSES = ("compatible", "breaking", "missing", "ambiguous", "unknown")


def summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("dependencies"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.coalesce(F.sum(F.size("checks")), F.lit(0)).cast("bigint").alias("checks"))

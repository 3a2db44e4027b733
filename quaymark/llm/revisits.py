"""WARC revisits: records that say "not modified" get the response they stand for.

A revisit takes the latest full response that was captured earlier under the same canonical URL. Its
validators must agree: entity tags if both have one (weakly compared), else the times of last
modification, else the payload digests. The result carries the response's payload and its headers,
updated by those that a not-modified answer may change (``PERMITTED``).

The as-of join works on narrow rows in two steps, so that a URL with very many captures is not one
task's work: captures are dealt out by ranges of URL and time, as many as the session's shuffles have
partitions, so that a hot URL or a burst of visits falls into several; within a URL and range a window
carries the latest response forward; the last response of each URL and range, one row each, is carried
to later ranges. Payloads join by the found response's number; a response that more than ``HOT`` revisits name is
copied, and its revisits are dealt over the copies.

Captures: ``record_id`` long, ``url``, ``kind`` (``response`` or ``revisit``), ``captured_at`` long,
``status`` int, ``headers`` map of strings with lower-case names, ``digest``, ``payload`` strings.

Defined cases: no URL, no time or no earlier full response (status 200) gives ``unresolved``; no
validator in common gives ``unverified``, differing ones ``mismatch``, neither with a payload; of
responses at one time the larger record_id is the later; a response at the revisit's own time is not
earlier; equal rows each get a result, and so do revisits that share a record_id, each by its own URL and
time; of full responses that share one, the content of least hash counts; a response without a record_id cannot be
named and is passed over, as if it were not there; URLs, headers and payloads of any
length are taken whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm.common import partitions_for, reliable_checkpoint

#: Revisits of one copy of a response.
HOT = 10_000
#: Header fields that a 304 response may update (RFC 9110 and 9111).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track visits.
TRACKING = ("ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, ``m.`` and default ports, path without a last slash, query without tracking.

    Scheme and fragment do not count; parameters are sorted. A null URL stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def latest_earlier(events: DataFrame) -> DataFrame:
    """(record_id, key, captured_at, found) of each revisit: the latest response strictly before it under its key.

    ``events``: record_id, key, captured_at, is_response; keys, times and numbers of responses are not null.
    """
    order = ["captured_at", "is_response", "record_id"]
    ranges = partitions_for(events.sparkSession)
    # The ranges are kept, as both steps must see the same ones.
    sliced = reliable_checkpoint(events.repartitionByRange(ranges, "key", *order).withColumn("slice", F.spark_partition_id()))
    within = Window.partitionBy("key", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    response = F.when(F.col("is_response"), F.col("record_id"))
    near = sliced.withColumn("near", F.last(response, ignorenulls=True).over(within)).where(~F.col("is_response"))
    # Each URL has at most one row a range here, filled from the range before.
    last = sliced.groupBy("key", "slice").agg(F.max(F.when(F.col("is_response"), F.struct("captured_at", "record_id"))).alias("last"))
    carried = last.withColumn("far", F.last("last.record_id", ignorenulls=True).over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    far = carried.select(F.col("key").alias("k"), F.col("slice").alias("s"), "far")
    return near.join(far, (near.key == far.k) & (near.slice == far.s), "left").select("record_id", "key", "captured_at", F.coalesce("near", "far").alias("found"))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Each revisit with its outcome, the response found, merged headers and the payload."""
    own = captures.select(
        F.col("record_id").cast("bigint").alias("record_id"), canonical_url(F.col("url")).alias("key"), "kind", F.col("captured_at").cast("bigint").alias("captured_at"), "status", "headers", "digest", "payload"
    )
    whole = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    events = own.where(F.col("key").isNotNull() & F.col("captured_at").isNotNull() & (whole | (F.col("kind") == "revisit")))
    found = reliable_checkpoint(latest_earlier(events.select("record_id", "key", "captured_at", whole.alias("is_response"))).distinct())
    revisits = own.where(F.col("kind") == "revisit").select("record_id", F.col("key").alias("canonical_url"), "captured_at", F.col("headers").alias("sent"), F.col("digest").alias("sent_digest"))
    by = found.select(F.col("record_id").alias("r"), F.col("key").alias("k"), F.col("captured_at").alias("at"), "found")
    same = F.col("record_id").eqNullSafe(F.col("r")) & (F.col("canonical_url") == F.col("k")) & (F.col("captured_at") == F.col("at"))
    named = revisits.join(by, same, "left").drop("r", "k", "at")
    responses = own.where(whole).select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), F.col("digest").alias("stored_digest"), "payload")
    content = F.struct(F.xxhash64(F.to_json("stored"), "stored_digest", "payload").alias("h"), F.struct("stored", "stored_digest", "payload").alias("r"))
    responses = responses.groupBy("response_id").agg(F.min_by(content["r"], content["h"]).alias("r")).select("response_id", "r.*")
    # There is one hot response for HOT revisits at most, two numbers each.
    hot = F.broadcast(found.where("found IS NOT NULL").groupBy(F.col("found").alias("c")).agg(F.ceil(F.count(F.lit(1)) / F.lit(HOT)).cast("int").alias("copies")).where("copies > 1"))
    is_hot, spread = F.col("found") == F.col("c"), F.pmod(F.xxhash64("record_id", "captured_at"), F.col("copies")).cast("int")
    cold = named.join(hot, is_hot, "left_anti").join(responses, F.col("found") == F.col("response_id"), "left")
    dealt = named.join(hot, is_hot).withColumn("copy", spread).drop("c", "copies")
    copied = responses.join(hot, F.col("response_id") == F.col("c")).withColumn("copy_", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("c", "copies")
    both = cold.unionByName(dealt.join(copied, (F.col("found") == F.col("response_id")) & (F.col("copy") == F.col("copy_")), "left").drop("copy", "copy_"))
    modified = [F.try_element_at(F.col(c), F.lit("last-modified")) for c in ("sent", "stored")]
    agree = F.coalesce(_tag(F.col("sent")) == _tag(F.col("stored")), modified[0] == modified[1], F.col("sent_digest") == F.col("stored_digest"))
    outcome = F.when(F.col("response_id").isNull(), "unresolved").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    updates = F.map_filter(F.coalesce("sent", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*PERMITTED))
    stored = F.map_filter(F.coalesce("stored", F.create_map().cast("map<string,string>")), lambda k, _: F.try_element_at(updates, k).isNull())
    good = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "captured_at", "outcome", "response_id",
        F.when(good, F.map_concat(stored, updates)).alias("headers"),
        F.when(good, F.col("payload")).alias("payload"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl over ``pages``: each page's response, and a later visit that found it not modified.

    Visits spell their URLs in other ways; a fifth of them carry another entity tag than the page, a
    seventh only a time of last modification, an eleventh no validator, and one in 13 comes too early.
    """
    k = F.col("page_id")
    tag = F.concat(F.lit('"'), F.left(F.md5("html"), F.lit(16)), F.lit('"'))
    modified = F.concat(F.lit("day "), (k % 365).cast("string"))
    base = pages.select(k.cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    response = base.select(
        (2 * k).alias("record_id"), "url", F.lit("response").alias("kind"), (k * 1000).alias("captured_at"), F.when(k % 17 == 3, 404).otherwise(200).alias("status"),
        F.create_map(
            F.lit("etag"), tag, F.lit("last-modified"), modified, F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.concat(F.lit("max-age="), (k % 7 * 60).cast("string")),
            F.lit("content-length"), F.octet_length("html").cast("string"),
        ).alias("headers"),
        F.sha1("html").alias("digest"), F.col("html").alias("payload"),
    )
    sent = F.when(k % 11 == 0, F.create_map(F.lit("content-length"), F.lit("0"))).otherwise(
        F.map_concat(
            F.when(k % 7 == 0, F.create_map(F.lit("last-modified"), modified)).otherwise(F.create_map(F.lit("etag"), F.when(k % 5 == 0, F.concat(F.lit("W/"), F.lit('"'), F.md5("url"), F.lit('"'))).otherwise(tag))),
            F.create_map(F.lit("cache-control"), F.lit("no-cache"), F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("day "), (k % 400).cast("string"))),
        )
    )
    revisit = base.select(
        (2 * k + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), F.lit("revisit").alias("kind"),
        F.when(k % 13 == 5, k * 1000 - 500).otherwise(k * 1000 + 500).alias("captured_at"), F.lit(304).alias("status"), sent.alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def revisits_digest(pages: DataFrame) -> DataFrame:
    lines = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.element_at(F.col("headers"), k)))
    return resolve_revisits(captures_of(pages)).select(
        "record_id", "canonical_url", "captured_at", "outcome", "response_id", F.array_join(lines, "\n").alias("merged_headers"), F.sha2("payload", 256).alias("payload_sha256")
    )


REVISITS_SQL = r"""
WITH base AS (SELECT page_id AS k, url, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
canon AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)[.]', '') AS host,
                 regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                 list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ('ref', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid'))) AS q FROM base),
c AS (SELECT k, html, url, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key,
             '"' || left(md5(html), 16) || '"' AS tag, 'day ' || (k % 365) AS modified FROM canon),
resp AS (SELECT *, k * 1000 AS t FROM c WHERE k % 17 <> 3),
rev AS (SELECT *, CASE WHEN k % 13 = 5 THEN k * 1000 - 500 ELSE k * 1000 + 500 END AS t FROM c),
pair AS (SELECT r.k, r.key, r.t, s.k AS sk, s.html, s.tag AS stag, s.modified AS smod, r.modified AS rmod,
                CASE WHEN r.k % 11 = 0 OR r.k % 7 = 0 THEN NULL WHEN r.k % 5 = 0 THEN '"' || md5(r.url) || '"' ELSE r.tag END AS rtag,
                CASE WHEN r.k % 11 = 0 OR r.k % 7 = 0 THEN NULL WHEN r.k % 5 = 0 THEN 'W/"' || md5(r.url) || '"' ELSE r.tag END AS sent_tag
         FROM rev r ASOF LEFT JOIN resp s ON r.key = s.key AND r.t > s.t),
done AS (SELECT *, CASE WHEN sk IS NULL THEN 'unresolved' WHEN k % 11 = 0 THEN 'unverified'
                        WHEN k % 7 = 0 THEN CASE WHEN rmod = smod THEN 'resolved' ELSE 'mismatch' END
                        WHEN rtag = stag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM pair)
SELECT 2 * k + 1 AS record_id, key AS canonical_url, t AS captured_at, outcome, 2 * sk AS response_id,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: no-cache' || chr(10) || 'content-length: ' || strlen(html) || chr(10) || 'content-type: text/html' || chr(10) || 'date: day ' || (k % 400) || chr(10)
            || 'etag: ' || coalesce(sent_tag, stag) || chr(10) || 'last-modified: ' || CASE WHEN k % 7 = 0 THEN rmod ELSE smod END END AS merged_headers,
       CASE WHEN outcome = 'resolved' THEN sha256(html) END AS payload_sha256
FROM done"""

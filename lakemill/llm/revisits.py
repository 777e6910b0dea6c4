"""WARC not-modified revisits: as-of join to the latest earlier full response of the same url.

Captures of one canonical url are split by time span, so a url that holds a third of all captures
is worked on by many tasks: within a span the latest response is a running maximum, across spans
one row per url and span carries it on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_SECONDS = 3600
# Headers that a not-modified answer must not change: they describe the connection or the body
# that was stored (fixed values).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te",
    "trailer", "transfer-encoding", "upgrade",
)
# Query parameters that do not change what is served (fixed values).
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid|jsessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, user, default port and www; path without a trailing
    slash; parameters sorted, without tracking ones; no fragment."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"(?s)^.*?://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^.*?://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    wanted = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    params = F.array_join(F.array_sort(wanted), "&")
    return F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))


def _entries(headers: Column) -> Column:
    """Sorted (name, value) entries with lower-case names; of equal names the last one stays."""
    lowered = F.transform(
        F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    last = F.filter(
        F.transform(
            lowered,
            lambda e, i: F.when(
                ~F.exists(
                    F.slice(lowered, i + 2, F.size(lowered)), lambda later: later["key"] == e["key"]
                ),
                e,
            ),
        ),
        lambda e: e.isNotNull(),
    )
    return F.array_sort(last)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Entries of the stored headers, updated by those that a revisit may change."""
    allowed = F.filter(fresh, lambda e: ~e["key"].isin(*KEPT_HEADERS))
    left = F.filter(stored, lambda e: ~F.exists(allowed, lambda a: a["key"] == e["key"]))
    return F.array_sort(F.concat(left, allowed))


def resolve_revisits(captures: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """One row per revisit of `captures`: record_id, canonical, ts, status, response_id, headers.

    `captures` has record_id, url, ts (seconds), kind ('response' or 'revisit'), etag,
    last_modified, digest and headers (map). The response is the latest with a smaller ts of the
    same canonical url, of equal ts the largest record_id. status: `resolved` if the first
    validator that both have (digest, etag by weak comparison, last_modified) is equal, `changed`
    if it differs, `unverified` if they share none, `orphan` without response. headers are the
    merged entries where resolved or unverified, else the revisit's own. A null url is an empty
    one; rows without ts match nothing; null headers are none; repeated rows give repeated
    revisits, and as responses count once. Further columns are ignored.
    """
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind",
        "etag", "last_modified", "digest", _entries(F.col("headers")).alias("headers"),
    ).withColumn("_span", F.floor(F.col("ts") / span_seconds))
    full = F.when(
        (F.col("kind") == "response") & F.col("ts").isNotNull(),
        F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"),
    )
    rows = rows.where("kind IN ('response', 'revisit')").withColumn("_full", full)
    # of the responses of one moment the largest record_id: struct order
    near = (
        Window.partitionBy("canonical", "_span")
        .orderBy("ts")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    earlier = Window.partitionBy("canonical").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        rows.where(F.col("ts").isNotNull())
        .groupBy("canonical", "_span")
        .agg(F.max("_full").alias("_best"))
        .withColumn("_carried", F.max("_best").over(earlier))
        .where("_carried IS NOT NULL")
        .select("canonical", "_span", "_carried")
    )
    found = (
        rows.withColumn("_near", F.when(F.col("ts").isNotNull(), F.max("_full").over(near)))
        .where("kind = 'revisit'")
        .join(spans, ["canonical", "_span"], "left")
        .withColumn("r", F.coalesce("_near", "_carried"))
    )
    checks = [
        (F.col("digest"), F.col("r.digest")),
        (_weak(F.col("etag")), _weak(F.col("r.etag"))),
        (F.col("last_modified"), F.col("r.last_modified")),
    ]
    verdict = F.coalesce(
        *(F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("changed")) for a, b in checks),
        F.lit("unverified"),
    )
    status = F.when(F.col("r").isNull(), "orphan").otherwise(verdict)
    merged = F.when(
        F.col("status").isin("resolved", "unverified"), merged_headers(F.col("r.headers"), F.col("headers"))
    ).otherwise(F.col("headers"))
    return found.withColumn("status", status).select(
        "record_id", "canonical", "ts", "status", F.col("r.record_id").alias("response_id"),
        merged.alias("headers"),
    )

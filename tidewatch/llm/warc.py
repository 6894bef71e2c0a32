"""Resolution of WARC revisit records to the full responses they stand for.

A revisit ("not modified") record carries no payload. It is joined, as of its time, to the latest earlier full
response of the same canonical URL. The match counts when the validators agree: equal payload digests where
both have one, else equal ETags, else equal Last-Modified. The headers of the result are the response's with
those that a revisit may update (PERMITTED) taken from the revisit.

Captures are dealt by canonical URL and by block of time, so that a URL with a third of all captures is not one
task: inside a block a running last value finds the response, and one row per block and URL carries the last
response forward.

Null URL or time: the record resolves to nothing and takes no part in a join. Ties in time: the response with the greatest
record_id wins, and a response at a revisit's own time counts as earlier. Repeated rows stay. Values of any length are
read whole. An empty table gives an empty result; further columns are kept, but for those named like the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import table

#: Header fields that a 304 response may update.
PERMITTED = ("date", "cache-control", "expires", "etag", "last-modified", "vary", "content-location")
BLOCK_SECONDS = 3600


def canonical_url(url: F.Column) -> F.Column:
    """Scheme, fragment, port 80 or 443, www. and a closing slash removed and the host lowered; the query stays as it is."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^(www\.)|:(80|443)$", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"/$", ""))


def resolve_revisits(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """records: record_id, type ('response' or 'revisit'), url, time (seconds), digest, headers (map).

    Adds resolved_id, valid and merged_headers.
    """
    columns = [c for c in records.columns if c not in ("resolved_id", "valid", "merged_headers")]
    keyed = records.select(F.struct(*columns).alias("row")).withColumn("canonical", canonical_url(F.col("row.url")))
    keyed = keyed.withColumn("block", F.floor(F.col("row.time") / block_seconds))
    lowered = F.transform_keys("row.headers", lambda k, _: F.lower(k))
    response = F.col("row.type") == "response"
    full = F.struct(F.col("row.time").alias("time"), F.col("row.record_id").alias("record_id"), F.col("row.digest").alias("digest"), lowered.alias("headers"))
    placed = keyed.where("canonical is not null and block is not null").withColumn("full", F.when(response, full))
    order = [F.col("row.time"), F.when(response, 0).otherwise(1), F.col("row.record_id")]
    inside = Window.partitionBy("canonical", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = placed.where("full is not null").groupBy("canonical", "block").agg(F.max_by("full", F.struct("full.time", "full.record_id")).alias("end"))
    spots = placed.select("canonical", "block").distinct().join(ends, ["canonical", "block"], "left")
    before = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select("canonical", "block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = placed.withColumn("found", F.last("full", ignorenulls=True).over(inside)).join(carried, ["canonical", "block"], "left")
    found = found.select("row", F.when(F.col("row.type") == "revisit", F.coalesce("found", "carried")).alias("found"))
    # records that no URL or time places would all meet in one task of the windows
    apart = keyed.where("canonical is null or block is null").select("row", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    found = found.unionByName(apart)
    own = F.coalesce(lowered, F.create_map().cast("map<string,string>"))

    def same(field: str) -> F.Column:
        return F.element_at(own, F.lit(field)) == F.element_at(F.col("found.headers"), F.lit(field))

    valid = F.coalesce(F.col("row.digest") == F.col("found.digest"), same("etag"), same("last-modified"), F.lit(False))
    kept = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.col("found.headers"), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(kept), k), F.lit(False))), kept)
    return found.select(
        "row.*", F.when(valid, F.col("found.record_id")).alias("resolved_id"), valid.alias("valid"),
        F.when(valid, merged).alias("merged_headers"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures made from pages: of every canonical URL the first is a full response and later ones are revisits
    where page_id is not a multiple of three; page_id is the capture's time."""
    pages = table(spark, sf_dir, "pages")
    records = pages.select(
        F.col("page_id").alias("record_id"), F.regexp_replace("url", r"/[^/]*$", "/").alias("url"), F.col("page_id").alias("time"),
        F.when(F.col("page_id") % 3 == 0, "response").otherwise("revisit").alias("type"),
        F.when(F.col("page_id") % 5 != 0, F.crc32(F.regexp_replace("url", r"/[^/]*$", "/")).cast("string")).alias("digest"),
        F.create_map(F.lit("ETag"), (F.col("page_id") % 2).cast("string"), F.lit("Server"), F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string"))).alias("headers"))
    found = resolve_revisits(records, 1000)
    return found.select("record_id", "url", "type", "resolved_id", F.element_at("merged_headers", F.lit("etag")).alias("etag"),
                        F.element_at("merged_headers", F.lit("server")).alias("server"))


OP3_SQL = r"""
WITH r AS (SELECT page_id AS record_id, regexp_replace(url, '/[^/]*$', '/') AS url,
    CASE WHEN page_id % 3 = 0 THEN 'response' ELSE 'revisit' END AS type, page_id % 5 <> 0 AS has_digest, CAST(page_id % 2 AS VARCHAR) AS etag FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '^www\.', ''), '/$', '') AS canonical FROM r),
f AS (SELECT a.record_id, a.url, a.type, a.has_digest, a.etag, b.record_id AS found_id, b.has_digest AS found_digest, b.etag AS found_etag, b.url AS found_url,
    row_number() OVER (PARTITION BY a.record_id ORDER BY b.record_id DESC) AS n
    FROM c a LEFT JOIN c b ON a.type = 'revisit' AND b.type = 'response' AND a.canonical = b.canonical AND b.record_id <= a.record_id),
v AS (SELECT *, CASE WHEN found_id IS NULL THEN FALSE WHEN has_digest AND found_digest THEN url = found_url ELSE etag = found_etag END AS valid FROM f WHERE n = 1)
SELECT record_id, url, type, CASE WHEN valid THEN found_id END AS resolved_id, CASE WHEN valid THEN etag END AS etag,
    CASE WHEN valid THEN 's' || CAST(found_id % 7 AS VARCHAR) END AS server FROM v
"""

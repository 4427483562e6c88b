"""Resolution of not-modified revisit records.

Each revisit takes the latest earlier full response of the same canonical URL (an as-of join), the
revisit's validators are compared with that response, and the headers that a 304 may update are merged.

The as-of join is two window passes over narrow rows: inside (URL, time slice) first, then over each
URL's slice summaries, of which there are at most ``SLICES`` however many records a URL has.  Slices hold
about equal numbers of records, so a hot URL is spread over them even where its records come in a burst,
and payloads never move.

Defined results: a response at the same instant as the revisit is not earlier; among responses of one instant
the larger rec_id wins; records with a null URL or null time resolve to nothing; a null header map is an
empty one; header names are compared, and returned, in lower case, and of names that differ only in case the
first counts; other columns are ignored, whatever their names; repeated records are resolved each; an empty table gives an empty result.  ``outcome`` is
"resolved", "mismatch" (a validator differs), "unvalidated" (nothing to compare; not merged) or "no_response".
An ETag, where both sides have one, decides alone (weak comparison); else Last-Modified does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SLICES = 256
# Header fields that a not-modified answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = r"(?i)(^|&)(utm_[a-z]*|ref|fbclid|gclid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, "www.", default port; no fragment, tracking parameter or trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path, query = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    kept = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), r"^&", "")
    return F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def lower_names(headers: Column) -> Column:
    """Header map with names in lower case; of equal names the first."""
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    names = F.transform(pairs, lambda e: e["key"])
    return F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Rows (rec_id, url, ts, kind, headers, digest) -> one row per record of kind "revisit".

    Columns: rec_id, url_key, ts, outcome, refers_to (rec_id of the response), digest (of the response, where resolved),
    headers (merged where resolved, else the revisit's own).
    """
    rows = records.select("rec_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", "digest", lower_names(F.col("headers")).alias("headers"))
    found = rows.agg(F.percentile_approx("ts", [i / SLICES for i in range(1, SLICES)], 10 * SLICES).alias("q")).head()["q"]
    edges = F.array(*[F.lit(x) for x in sorted(set(found or []))]).cast("array<bigint>")
    rows = rows.withColumn("_slice", F.when(F.col("ts").isNotNull(), F.size(F.filter(edges, lambda x: x < F.col("ts")))))
    usable = (F.col("kind") == "response") & F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    found = F.when(usable, F.struct("rec_id", "digest", "headers"))
    order = [F.col("ts"), (F.col("kind") == "response").cast("int"), F.col("rec_id")]
    inside = W.partitionBy("url_key", "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = rows.withColumn("_near", F.last(found, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    latest = rows.where(usable).groupBy("url_key", "_slice").agg(F.max_by(F.struct("rec_id", "digest", "headers"), F.struct("ts", "rec_id")).alias("_last"))
    asked = near.where("_near IS NULL AND url_key IS NOT NULL AND _slice IS NOT NULL").select("url_key", "_slice").distinct()
    marks = latest.withColumn("_asked", F.lit(0)).unionByName(asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True)
    past = W.partitionBy("url_key").orderBy("_slice", F.desc("_asked")).rowsBetween(W.unboundedPreceding, -1)
    far = marks.withColumn("_far", F.last("_last", ignorenulls=True).over(past)).where("_asked = 1").select("url_key", "_slice", "_far")
    both = near.join(far, ["url_key", "_slice"], "left")
    hit = F.coalesce("_near", "_far")
    own, got = F.col("headers"), F.col("_hit.headers")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    tags = own["etag"].isNotNull() & got["etag"].isNotNull()
    dates = own["last-modified"].isNotNull() & got["last-modified"].isNotNull()
    outcome = (
        F.when(F.col("_hit").isNull(), "no_response")
        .when(tags, F.when(tag(own) == tag(got), "resolved").otherwise("mismatch"))
        .when(dates, F.when(own["last-modified"] == got["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    fresh = F.map_filter(own, lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(got, lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    out = both.withColumn("_hit", hit).withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return out.select(
        "rec_id", "url_key", "ts", "outcome", F.col("_hit.rec_id").alias("refers_to"), F.when(ok, F.col("_hit.digest")).alias("digest"), F.when(ok, merged).otherwise(own).alias("headers")
    )


def records_from_pages(pages: DataFrame) -> DataFrame:
    """Capture records derived from raw pages: a full response of each page, and a later revisit of each.

    Times are ten units a page.  A revisit comes 5 units after its page; one in three carries the ETag (one in seven
    of those a stale one), one in three only Last-Modified, the rest both; one in eleven carries nothing.
    """
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length("html").alias("size"))
    p = p.withColumn("ts", F.col("page_id") * 10)
    modified = F.concat(F.lit("day-"), (F.col("page_id") % 365).cast("string"))
    text = lambda c: c.cast("string")
    response = p.select(
        (F.col("page_id") * 2).alias("rec_id"), "url", "ts", F.lit("response").alias("kind"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), "digest"), F.lit("last-modified"), modified, F.lit("date"), text(F.col("ts")), F.lit("content-length"), text(F.col("size")), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
        "digest",
    )
    bare, turn = F.col("page_id") % 11 == 0, F.col("page_id") % 3
    etag = F.when(~bare & (turn != 1), F.when(F.col("page_id") % 7 == 0, F.lit("stale")).otherwise(F.col("digest")))
    revisit = p.select(
        (F.col("page_id") * 2 + 1).alias("rec_id"), "url", (F.col("ts") + 5).alias("ts"), F.lit("revisit").alias("kind"),
        F.create_map(F.lit("etag"), etag, F.lit("last-modified"), F.when(~bare & (turn != 0), modified), F.lit("date"), text(F.col("ts") + 5), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=90")).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return response.unionByName(revisit)


def digest_columns(resolved: DataFrame) -> DataFrame:
    """The headers that matter as plain columns."""
    h = F.col("headers")
    return resolved.select("rec_id", "url_key", "ts", "outcome", "refers_to", "digest", h["etag"].alias("etag"), h["date"].alias("date"), h["cache-control"].alias("cache_control"), h["content-length"].alias("content_length"), h["last-modified"].alias("last_modified"))


ORACLE = r"""
WITH b AS (
  SELECT page_id, page_id * 10 AS ts, md5(coalesce(html, '')) AS dg, length(html) AS size,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
k AS (
  SELECT *, regexp_extract(bare, '^[^/?]*([^?]*)', 1) AS path,
         regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_replace(regexp_extract(bare, '\?(.*)$', 1), '(^|&)(utm_[a-z]*|ref|fbclid|gclid)=[^&]*', '', 'gi'), '^&', '') AS q FROM b),
u AS (SELECT *, host || regexp_replace(path, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url_key, 'day-' || (page_id % 365) AS lm FROM k),
v AS (
  SELECT *, ts + 5 AS vts,
         CASE WHEN page_id % 11 <> 0 AND page_id % 3 <> 1 THEN CASE WHEN page_id % 7 = 0 THEN 'stale' ELSE dg END END AS vtag,
         CASE WHEN page_id % 11 <> 0 AND page_id % 3 <> 0 THEN lm END AS vlm FROM u),
j AS (
  SELECT v.*, r.page_id AS rp, r.ts AS rts, r.dg AS rdg, r.lm AS rlm, r.size AS rsize,
         row_number() OVER (PARTITION BY v.page_id ORDER BY r.ts DESC, r.page_id DESC) AS n
  FROM v LEFT JOIN u r ON r.url_key = v.url_key AND r.ts < v.vts),
o AS (
  SELECT *, CASE WHEN rp IS NULL THEN 'no_response' WHEN vtag IS NOT NULL THEN CASE WHEN vtag = rdg THEN 'resolved' ELSE 'mismatch' END
                 WHEN vlm IS NOT NULL THEN CASE WHEN vlm = rlm THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS outcome
  FROM j WHERE n = 1)
SELECT page_id * 2 + 1 AS rec_id, url_key, vts AS ts, outcome, rp * 2 AS refers_to,
       CASE WHEN outcome = 'resolved' THEN rdg END AS digest,
       CASE WHEN outcome = 'resolved' THEN coalesce(vtag, 'W/' || rdg) ELSE vtag END AS etag,
       CAST(vts AS VARCHAR) AS date, 'max-age=90' AS cache_control,
       CASE WHEN outcome = 'resolved' THEN CAST(rsize AS VARCHAR) ELSE '0' END AS content_length,
       CASE WHEN outcome = 'resolved' THEN coalesce(vlm, rlm) ELSE vlm END AS last_modified
FROM o
"""

"""Not-modified revisits: each is joined to the latest earlier full response of its canonical URL, in DataFrame functions.

The as-of join works in two steps, so that one URL with very many records needs no single task: inside (URL, time slot)
a window looks back, and the last response of earlier slots is carried over from one row for each slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Header fields of a not-modified answer that must not replace those of the stored response: what describes the
#: stored body, and fields that are meant for one connection alone.
KEPT_FIELDS = ["content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "trailers", "transfer-encoding", "upgrade"]
#: Query parameters that only track where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid)="


def canonical_url(url: Column) -> Column:
    """One name for the spellings of a URL; null stays null.

    Scheme and host in lower case without scheme, user, "www." and default port; no fragment, no tracking parameters, the
    other parameters sorted; no slash at the end of the path.
    """
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """A map of headers by names in lower case; names that differ in case alone are one, with their values in the order of the
    spellings, joined by a comma as repeated fields are (nulls are left out of it; all null: null)."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e.key)))

    def value(name: Column) -> Column:
        own = F.transform(F.filter(entries, lambda e: (F.lower(e.key) == name) & e.value.isNotNull()), lambda e: e.value)
        return F.when(F.size(own) > 0, F.array_join(own, ", "))

    return F.when(headers.isNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.map_from_arrays(names, F.transform(names, value)))


def resolve_revisits(records: DataFrame, slot: int = 86_400) -> DataFrame:
    """Resolves (record_id long, url, ts long, status int, etag, last_modified, headers map<string,string>, digest).

    One row for each record: record_id, url_key, ts, outcome, resolved_id, headers, digest. Status 200 is a full response
    ("full", resolved to itself), 304 a revisit, others are "other". A revisit takes the response of its url_key with the
    largest smaller ts (ties: the largest record_id): "resolved" if both have the same entity tag (weakly compared), or,
    where either has none, the same last-modified; else "mismatch"; "missing" if there is none before. A resolved one has the
    response's digest and headers, the revisit's own fields replacing those except KEPT_FIELDS (names in lower case).
    Header names that differ in case alone are one field (see lower_names). Null url or ts: never resolved ("missing"), nor resolved to. record_id must tell records apart; records that repeat it
    are each resolved, and one that two responses share resolves to the one that is larger by (etag, last_modified, digest).
    Other columns are dropped.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", F.col("status"), "etag", "last_modified", lower_names(F.col("headers")).alias("headers"), "digest")
    r = r.withColumn("slot", F.floor(F.col("ts") / slot))
    full = F.when((F.col("status") == 200) & F.col("url_key").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "record_id"))
    inside = Window.partitionBy("url_key", "slot").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = r.groupBy("url_key", "slot").agg(F.max(full).alias("last")).where("url_key is not null and slot is not null")
    carried = slots.withColumn("carried", F.max("last").over(across)).select("url_key", "slot", "carried")
    found = r.withColumn("near", F.max(full).over(inside)).join(carried, ["url_key", "slot"], "left")
    found = found.withColumn("ref", F.when((F.col("status") == 304) & F.col("url_key").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near.record_id", "carried.record_id")))
    base = r.where("status = 200").groupBy(F.col("record_id").alias("ref")).agg(F.max_by(F.struct("etag", "last_modified", "headers", "digest"), F.struct("etag", "last_modified", "digest")).alias("base"))
    # rows without a reference never meet the join: a null key in a third of all rows would be one hot key
    direct, wanted = found.where("ref is null"), found.where("ref is not null").join(base, "ref", "left")
    both = direct.withColumn("base", F.lit(None).cast(base.schema["base"].dataType)).unionByName(wanted)
    tags = F.col("etag").isNotNull() & F.col("base.etag").isNotNull()
    same = F.when(tags, _weak(F.col("etag")) == _weak(F.col("base.etag"))).otherwise(F.coalesce(F.col("last_modified") == F.col("base.last_modified"), F.lit(False)))
    outcome = F.when(F.col("status") == 200, "full").when(F.col("status") != 304, "other").when(F.col("status").isNull(), "other").when(F.col("ref").isNull(), "missing").when(same, "resolved").otherwise("mismatch")
    new = F.map_filter("headers", lambda k, v: ~k.isin(KEPT_FIELDS))
    merged = F.map_concat(F.map_filter("base.headers", lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    out = both.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return out.select("record_id", "url_key", "ts", "outcome", F.when(ok, F.col("ref")).when(F.col("outcome") == "full", F.col("record_id")).alias("resolved_id"), F.when(ok, merged).otherwise(F.col("headers")).alias("headers"), F.when(ok, F.col("base.digest")).otherwise(F.col("digest")).alias("digest"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl in which every page is fetched in full and later visited again, with validators that at times disagree."""
    p = F.col("page_id")
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.when(p % 3 != 0, F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"')))
    day = F.concat(F.lit("day "), (p % 97).cast("string"))
    no = F.lit(None).cast("string")
    first = F.struct((2 * p).alias("record_id"), F.col("url"), (10 * p).alias("ts"), F.lit(200).alias("status"), tag.alias("etag"), F.when(p % 5 != 0, day).alias("last_modified"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), day, F.lit("Content-Length"), F.length("html").cast("string")).alias("headers"), digest.alias("digest"))
    again = F.struct((2 * p + 1).alias("record_id"), F.col("url"), (10 * p + 1 + 10 * (p % 7)).alias("ts"), F.lit(304).alias("status"), F.when(p % 11 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)).alias("etag"), F.when(p % 13 != 0, day).alias("last_modified"), F.create_map(F.lit("date"), F.concat(day, F.lit(" again")), F.lit("content-length"), F.lit("0"), F.lit("etag"), F.coalesce(tag, F.lit("-"))).alias("headers"), no.alias("digest"))
    return pages.select(F.explode(F.array(first, again)).alias("r")).select("r.*")


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolves the revisits of a crawl of all pages; headers as sorted text."""
    out = resolve_revisits(crawl_of(common.table(spark, sf_dir, "pages")), slot=4096)
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), F.coalesce(e.value, F.lit(""))))), "; ")
    return out.select("record_id", "url_key", "ts", "outcome", "resolved_id", fields.alias("headers"), "digest")


#: The same as op5_revisits, by DuckDB's own window functions over whole URLs.
OP5_SQL = r"""
WITH pages_x AS (
  SELECT page_id p, url, html, sha256(coalesce(html, '')) dig FROM pages
), recs AS (
  SELECT 2*p AS record_id, url, 10*p AS ts, 200 AS status,
         CASE WHEN p % 3 <> 0 THEN '"' || substr(dig,1,16) || '"' END AS etag,
         CASE WHEN p % 5 <> 0 THEN 'day ' || (p % 97) END AS lm, dig AS digest,
         'day ' || (p % 97) AS d, length(html)::varchar AS len, NULL AS tag FROM pages_x
  UNION ALL
  SELECT 2*p+1, url, 10*p + 1 + 10*(p % 7), 304,
         CASE WHEN p % 11 = 0 THEN '"other"' WHEN p % 3 <> 0 THEN 'W/"' || substr(dig,1,16) || '"' END,
         CASE WHEN p % 13 <> 0 THEN 'day ' || (p % 97) END, NULL,
         'day ' || (p % 97), '0', coalesce(CASE WHEN p % 3 <> 0 THEN '"' || substr(dig,1,16) || '"' END, '-') FROM pages_x
), parts AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM recs
), named AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid)='))) AS qs FROM parts
), keyed AS (
  SELECT *, hp || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END AS url_key FROM named
), looked AS (
  SELECT *, max(CASE WHEN status = 200 THEN {'ts': ts, 'id': record_id} END) OVER (PARTITION BY url_key ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM keyed
), joined AS (
  SELECT a.*, CASE WHEN a.status = 304 THEN a.seen.id END AS ref, b.etag AS betag, b.lm AS blm, b.digest AS bdigest, b.d AS bd, b.len AS blen
  FROM looked a LEFT JOIN keyed b ON b.status = 200 AND a.status = 304 AND b.record_id = a.seen.id
), judged AS (
  SELECT *, CASE WHEN status = 200 THEN 'full' WHEN ref IS NULL THEN 'missing'
    WHEN CASE WHEN etag IS NOT NULL AND betag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(betag, '^W/', '') ELSE coalesce(lm = blm, false) END THEN 'resolved' ELSE 'mismatch' END AS outcome FROM joined
)
SELECT record_id, url_key, ts, outcome, CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN ref END AS resolved_id,
  CASE WHEN outcome = 'full' THEN 'content-length: ' || coalesce(len, '') || '; content-type: text/html; date: ' || d
       WHEN outcome = 'resolved' THEN 'content-length: ' || coalesce(blen, '') || '; content-type: text/html; date: ' || d || ' again; etag: ' || tag
       ELSE 'content-length: 0; date: ' || d || ' again; etag: ' || tag END AS headers,
  CASE WHEN outcome = 'resolved' THEN bdigest ELSE digest END AS digest
FROM judged
"""

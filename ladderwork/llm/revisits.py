"""WARC: resolution of not-modified revisits.

A revisit record says that a server answered 304 Not Modified. It is joined, by canonical URL and capture time, to the
latest earlier full response; validators are checked, and headers that a 304 may update are merged into the stored ones.

The as-of join is a window over ids and times only; payloads and headers join afterwards by record id. A URL is cut into
time slots, each slot passes its last response on, so a URL that holds a third of all records is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_frequent, stage

#: Header fields that a 304 response updates in a stored one.
UPDATED_HEADERS = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Records per time slot, were they spread evenly.
SLOT_RECORDS = 200_000

#: Query parameters that name a visit, not a page.
_TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without scheme, www. or m., port 80 or 443, fragment, tracking parameters, index.html and trailing slash."""
    out = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(out, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)", 1))
    rest = F.regexp_replace(out, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^(?:www|m)\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_replace(rest, rf"([?&]){_TRACKING}=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&+", "&"), r"\?&", "?"), r"[?&]$", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, r"/index\.html?$", "/"), r"/$", ""))


def capture_records(pages: DataFrame) -> DataFrame:
    """WARC-like records of a table of pages: each page is captured in full, and again later, when the server says it is unchanged.

    record_id, url, captured (order of capture), kind (response or revisit) and headers. One in seven revisits names
    another validator, one in five has a date only; pages of an empty or null html have no ETag.
    """
    tag = F.when(F.coalesce(F.length("html"), F.lit(0)) > 0, F.md5("html"))
    day = F.concat(F.lit("day "), (F.col("page_id") % 9).cast("string"))
    known = lambda *pairs: F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in pairs]), lambda _, v: v.isNotNull())
    number = lambda shift: (F.col("page_id") * 2 + shift).cast("bigint")
    response = F.struct(
        number(0).alias("record_id"), F.col("page_id").cast("bigint").alias("captured"), F.lit("response").alias("kind"),
        known("etag", F.when(F.col("page_id") % 6 != 0, tag), "last-modified", day, "date", day, "content-type", F.lit("text/html"), "cache-control", F.lit("max-age=60")).alias("headers"),
    )
    revisit = F.struct(
        number(1).alias("record_id"), (F.col("page_id") + 3).cast("bigint").alias("captured"), F.lit("revisit").alias("kind"),
        known(
            "etag", F.when(F.col("page_id") % 5 != 0, F.when(F.col("page_id") % 7 == 0, F.lit("other")).otherwise(F.concat(F.lit("W/"), tag))),
            "last-modified", day, "date", F.concat(F.lit("later "), day), "content-type", F.lit("text/plain"), "cache-control", F.lit("max-age=3600"),
        ).alias("headers"),
    )
    return pages.where("page_id is not null").select("url", F.explode(F.array(response, revisit)).alias("r")).select("r.record_id", "url", "r.captured", "r.kind", "r.headers")


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit with the response that it stands for.

    records: record_id (unique), url, captured (bigint, grows with time), kind (response or revisit), headers (map with
    lower-case names); other columns are ignored. One row per revisit: record_id, url (canonical), captured, response_id,
    status and headers. The response is the latest one of the same canonical URL that was captured before the revisit
    (of the same time the largest record_id). status: `no_response` (none is earlier), `mismatch` (validators differ),
    `unchecked` (no validator in common) or `resolved`. Entity tags are compared weakly; dates count where a tag is
    missing on either side. headers are the response's with those of UPDATED_HEADERS that the revisit names, or the
    revisit's own where it isn't resolved or unchecked. A null url matches null nowhere; a null time is never earlier;
    repeated record_ids give a row per combination; an empty table gives no rows.
    """
    records = records.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("captured").cast("bigint").alias("captured"), "kind", "headers")
    n, low, high = records.agg(F.count("*"), F.min("captured"), F.max("captured")).first()
    slots = max(1, -(-n // SLOT_RECORDS))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // slots))
    slim = records.where("captured is not null and url is not null").select("record_id", "url", "captured", "kind", F.floor((F.col("captured") - F.lit(low or 0)) / width).alias("slot"))
    is_response = F.col("kind") == "response"
    here = F.struct("captured", "record_id")
    # Within a slot: the last response of an earlier time. Rows of one time see none of each other.
    inside = Window.partitionBy("url", "slot").orderBy("captured").rangeBetween(Window.unboundedPreceding, -1)
    own = slim.withColumn("found", F.max(F.when(is_response, here)).over(inside)).where("kind = 'revisit'")
    # Over slots: the last response of any earlier slot.
    last = slim.groupBy("url", "slot").agg(F.max(F.when(is_response, here)).alias("last"))
    before = Window.partitionBy("url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("url", "slot", F.max("last").over(before).alias("carried"))
    found = own.join(carried, ["url", "slot"], "left").select("record_id", F.coalesce("found", "carried")["record_id"].alias("response_id"))
    revisits = records.where("kind = 'revisit'").join(stage(found, "found"), "record_id", "left")
    stored = records.where(is_response).select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"))
    both = join_frequent(revisits, stored, "response_id")
    named = lambda c, name: F.try_element_at(F.coalesce(c, F.create_map().cast("map<string,string>")), F.lit(name))
    tags = [_weak(named(F.col(c), "etag")) for c in ("stored", "headers")]
    dates = [named(F.col(c), "last-modified") for c in ("stored", "headers")]
    have = lambda pair: pair[0].isNotNull() & pair[1].isNotNull()
    status = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when(have(tags), F.when(tags[0] == tags[1], "resolved").otherwise("mismatch"))
        .when(have(dates), F.when(dates[0] == dates[1], "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    new = F.map_filter("headers", lambda k, v: k.isin(UPDATED_HEADERS))
    kept = F.map_filter("stored", lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    merged = F.map_concat(kept, new)
    both = both.withColumn("status", status)
    return both.select(
        "record_id", "url", "captured", "response_id", "status",
        F.when(F.col("status").isin("resolved", "unchecked"), F.coalesce(merged, "stored")).otherwise(F.col("headers")).alias("headers"),
    )


def revisit_report(pages: DataFrame) -> DataFrame:
    """Resolved records of the pages' captures, headers as columns."""
    name = lambda h: F.try_element_at("headers", F.lit(h)).alias(h.replace("-", "_"))
    return resolve_revisits(capture_records(pages)).select(
        "record_id", "url", "captured", "response_id", "status", *map(name, ["etag", "last-modified", "date", "content-type", "cache-control"])
    )


_URL_SQL = r"""
  regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)', 1)), '^(?:www|m)\.', ''), ':(?:80|443)$', '')
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*', ''),
    '([?&])(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]$', ''), '/index\.html?$', '/'), '/$', '')
"""

REVISIT_SQL = rf"""
with p as (
  select page_id, {_URL_SQL} as url, case when length(html) > 0 then md5(html) end as tag, 'day ' || cast(page_id % 9 as varchar) as day
  from (select *, regexp_replace(trim(url), '#.*$', '') as u from pages) where page_id is not null),
responses as (select page_id * 2 as record_id, url, page_id as captured, case when page_id % 6 <> 0 then tag end as etag, day from p),
revisits as (
  select page_id * 2 + 1 as record_id, url, page_id + 3 as captured, day,
    case when page_id % 5 <> 0 then case when page_id % 7 = 0 then 'other' else 'W/' || tag end end as etag from p),
joined as (
  select v.*, r.record_id as response_id, r.etag as stored_etag, r.day as stored_day, row_number() over (partition by v.record_id order by r.captured desc, r.record_id desc) as n
  from revisits v left join responses r on r.url = v.url and r.captured < v.captured),
checked as (
  select *, case when response_id is null then 'no_response'
    when stored_etag is not null and etag is not null then case when stored_etag = regexp_replace(etag, '^W/', '') then 'resolved' else 'mismatch' end
    when stored_day = day then 'resolved' else 'mismatch' end as status
  from joined where n = 1)
select record_id, url, captured, response_id, status,
  case when status = 'resolved' then coalesce(etag, stored_etag) else etag end as etag,
  case when status = 'resolved' then stored_day else day end as last_modified,
  'later ' || day as date,
  case when status = 'resolved' then 'text/html' else 'text/plain' end as content_type,
  'max-age=3600' as cache_control
from checked
"""

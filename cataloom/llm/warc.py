"""Not-modified revisits of a crawl archive (operator 5).

A capture is (record_id, url, ts, kind, etag, last_modified, headers): kind 'response' is a
full record, 'revisit' says that the server answered "not modified".  Each revisit is joined as
of its time to the latest earlier full response of the same canonical URL.  It resolves to
that response if a validator agrees: the entity tags, compared weakly, where both records have
one; else the modification dates, where both have one.  The resolved capture has the response's
headers, updated by those of the revisit that a "not modified" answer may change
(``PERMITTED``).

The join is one shuffle by URL and one window over it, whatever the number of captures of
a URL; bodies don't travel, ``with_bodies`` attaches them.

Defined results, by the column outcome: 'resolved'; 'no earlier response' where there is none,
or the revisit has no URL or time; 'changed' where the compared validators differ;
'unvalidated' where neither can be compared.  Only 'resolved' has refers_to and headers.  Of
responses of the same time the one of the greatest record_id counts; a response of the revisit's
own time isn't earlier; repeated rows are resolved apart; an empty tag or date is none; null
headers are none; header names are lower-cased, of names that then clash the value that sorts last counts;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a "not modified" answer updates in a stored response (RFC 9111, 3.2 and RFC 9110, 15.4.5).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that don't tell one page from another.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical(url: Column) -> Column:
    """host[:port]/path[?query]: lower-cased scheme and host, without scheme, user, default port, fragment, last slash and tracking parameters; parameters sorted."""
    trimmed = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(trimmed, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(host, "(:80|:443)$", "")
    rest = F.regexp_extract(trimmed, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _weak(tag: str) -> Column:
    return F.nullif(F.regexp_replace(F.trim(F.col(tag)), "^W/", ""), F.lit(""))


def _lower(headers: Column) -> Column:
    pairs = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.coalesce(F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))), F.expr("cast(map() as map<string,string>)"))


def resolve(captures: DataFrame) -> DataFrame:
    """(record_id, url_key, ts, outcome, refers_to, validator, headers) of every revisit."""
    rows = captures.select("record_id", canonical(F.col("url")).alias("url_key"), "ts", "kind", _weak("etag").alias("tag"), F.nullif(F.trim("last_modified"), F.lit("")).alias("changed"), _lower(F.col("headers")).alias("headers"))
    rows = rows.filter("kind in ('response', 'revisit')")
    found = (F.col("url_key").isNotNull()) & F.col("ts").isNotNull()
    full = F.when(F.col("kind") == "response", F.struct("record_id", "tag", "changed", "headers"))
    # at one time revisits come first: a response of their own time isn't earlier
    order = Window.partitionBy("url_key").orderBy("ts", F.col("kind") == "response", "record_id")
    near = rows.filter(found).withColumn("r", F.last(full, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("kind = 'revisit'")
    lost = rows.filter(~found & (F.col("kind") == "revisit"))
    by_tag, by_date = F.col("tag").isNotNull() & F.col("r.tag").isNotNull(), F.col("changed").isNotNull() & F.col("r.changed").isNotNull()
    agrees = F.when(by_tag, F.col("tag") == F.col("r.tag")).when(by_date, F.col("changed") == F.col("r.changed"))
    outcome = F.when(F.col("r").isNull(), "no earlier response").when(agrees, "resolved").when(~agrees, "changed").otherwise("unvalidated")
    near = near.withColumns({"outcome": outcome, "by": F.when(by_tag, "etag").when(by_date, "last-modified")})
    allowed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("r.headers", lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    done = F.col("outcome") == "resolved"
    text = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")
    out = near.select("record_id", "url_key", "ts", "outcome", F.when(done, F.col("r.record_id")).alias("refers_to"), F.when(done, F.col("by")).alias("validator"), F.when(done, text).alias("headers"))
    none = lost.select("record_id", "url_key", "ts", F.lit("no earlier response").alias("outcome"), F.lit(None).cast(rows.schema["record_id"].dataType).alias("refers_to"), F.lit(None).cast("string").alias("validator"), F.lit(None).cast("string").alias("headers"))
    return out.unionAll(none)


def with_bodies(resolved: DataFrame, captures: DataFrame, body: str = "body") -> DataFrame:
    """Resolved revisits with the body of the response they refer to; of repeated responses of an id the greatest body counts."""
    bodies = captures.filter("kind = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max(body).alias(body))
    return resolved.filter("outcome = 'resolved'").join(bodies, "refers_to").select(*resolved.columns, body)


#: Captures made of the table pages, for Spark and DuckDB alike: every page is a response, and every
#: page is revisited, under another spelling of its URL; the revisits' times, validators and headers
#: go by page_id, so that each outcome occurs.  {map} is the engine's map of two lists of equal length.
PAGES_SQL = """
select page_id * 2 as record_id, url, page_id * 10 as ts, 'response' as kind,
  case when page_id % 6 = 5 then null else concat('"', md5(html), '"') end as etag,
  case when page_id % 4 = 3 then '' else concat('day ', cast(page_id % 97 as string)) end as last_modified,
  {map}({open}'Content-Type', 'Content-Length', 'Cache-Control', 'ETag', 'Date'{close}, {open}'text/html', cast(length(html) as string), 'max-age=60', md5(html), concat('t', cast(page_id * 10 as string)){close}) as headers
from pages
union all
select page_id * 2 + 1, concat(replace(url, 'http://', 'HTTP://'), case when page_id % 3 = 0 and url not like '%#%' and url not like '%?%' then '?utm_source=x' else '' end),
  case when page_id % 11 = 0 then page_id * 10 - 5 else page_id * 10 + 7 * (page_id % 5) + 1 end, 'revisit',
  case when page_id % 7 = 1 then '"other"' when page_id % 7 = 2 then null else concat('W/"', md5(html), '"') end,
  case when page_id % 5 = 4 then null when page_id % 13 = 6 then 'day x' else concat('day ', cast(page_id % 97 as string)) end,
  {map}({open}'Cache-Control', 'Content-Length', 'Date', 'Set-Cookie'{close}, {open}'no-store', '0', concat('t', cast(page_id * 10 + 7 as string)), 'id=1'{close})
from pages
"""


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """The captures that ``PAGES_SQL`` makes of a table of pages."""
    return pages.sparkSession.sql(PAGES_SQL.replace("from pages", "from {pages}").format(map="map_from_arrays", open="array(", close=")", pages="{pages}"), pages=pages)


def sql() -> str:
    """``resolve`` over ``PAGES_SQL`` for DuckDB."""
    allowed = ", ".join(f"'{h}'" for h in PERMITTED)
    key = r"""concat(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), '(:80|:443)$', ''),
      regexp_replace(regexp_extract(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1), '^([^?]*)', 1), '/+$', ''),
      case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end)"""
    kept = rf"""list_sort(list_filter(string_split(regexp_extract(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1), '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^({TRACKING})(=|$)')))"""
    entries = "list_transform(map_entries({0}), lambda e: {{'k': lower(e.key), 'v': e.value}})"
    return f"""
with c as ({PAGES_SQL.format(map="map", open="[", close="]")}),
t as (select *, regexp_replace(trim(url), '#.*$', '') as u from c),
k as (select *, {kept} as q from t),
r as (select record_id, {key} as url_key, ts, kind, nullif(regexp_replace(trim(etag), '^W/', ''), '') as tag, nullif(trim(last_modified), '') as changed, {entries.format("headers")} as headers from k),
j as (select v.*, p.record_id as rid, p.tag as rtag, p.changed as rchanged, p.headers as rheaders,
      row_number() over (partition by v.record_id order by p.ts desc, p.record_id desc) as n
      from (select * from r where kind = 'revisit') v left join (select * from r where kind = 'response') p on v.url_key = p.url_key and p.ts < v.ts),
b as (select *, case when tag is not null and rtag is not null then 'etag' when changed is not null and rchanged is not null then 'last-modified' end as by_what from j where n = 1),
o as (select *, case when rid is null then 'no earlier response' when by_what is null then 'unvalidated' when case when by_what = 'etag' then tag = rtag else changed = rchanged end then 'resolved' else 'changed' end as outcome from b),
m as (select *, list_filter(headers, lambda e: e.k in ({allowed})) as own from o)
select record_id, url_key, ts, outcome, case when outcome = 'resolved' then rid end as refers_to, case when outcome = 'resolved' then by_what end as validator,
  case when outcome = 'resolved' then array_to_string(list_sort(list_transform(list_concat(list_filter(rheaders, lambda e: not list_contains(list_transform(own, lambda o: o.k), e.k)), own), lambda e: e.k || ': ' || coalesce(e.v, ''))), chr(10)) end as headers
from m"""

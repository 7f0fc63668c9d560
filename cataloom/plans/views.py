"""Catalogue-like views of the general tables, the same for Spark and DuckDB.

A view is SQL with {tables}; what the two engines spell apart is marked <<name>>.  In Spark the
names become DataFrames, in DuckDB common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

#: What the engines spell differently: mark -> (Spark, DuckDB).
SPELLED = {
    "artists(": ("array(named_struct('spotify_id', ", "[struct_pack(spotify_id := "),
    "name=": (", 'name', ", ", name := "),
    ")artists": ("))", ")]"),
    "codes(": ("array_sort(collect_set(", "list_sort(list_distinct(list("),
    ")codes": ("))", ")))"),
    "div": ("div", "//"),
    "seconds(": ("timestamp_seconds(", "make_timestamp(1000000 * "),
    "now": ("timestamp'2024-01-20 00:00:00'", "timestamp '2024-01-20 00:00:00'"),
    "time(": ("cast(", "cast("),
    "g": ("", ", 'g'"),
}

COUNTRIES = "UZ,KZ,RU,UA,AE,EG,TR,PL,RO,RS,IN,PK,BD,CN,JP,KR,TH,VN,ID,US,GB,DE,FR,BR,TJ"
LANGUAGES = "uz,ru,ar,pl,hi,zh,th,en,kk,de,fa,ja,,fr,ro"
_LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Letters of other scripts that stand for Latin ones in derived texts.
ALPHABETS = {1: "абцдефгхийклмнопқрстувўхуз", 2: "ابجدهفغحيجكلمنوپقرستثوخشيز", 3: "あびしでえふぐひいじくるむのおぷけらすとうべわくよず", 4: "가나다라마바사아자차카타파하거너더러머버서어저처커터", 5: "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"}

VIEWS = {
    "v_tracks": """
select concat('part:', cast(p.p_partkey as string)) as spotify_id,
  case when p.p_partkey % 3 = 0 then null else concat('ISRC', cast(p.p_partkey % n.most as string)) end as isrc,
  case p.p_partkey % 8 when 1 then concat(p.p_name, ' (Remastered 2019)') when 2 then concat(p.p_name, ' [Live Version]') when 3 then concat(p.p_name, ' feat. Guest')
    when 4 then concat('01. ', p.p_name) when 5 then concat(p.p_name, ' (Official Video)') when 6 then upper(replace(p.p_name, ' ', '-')) when 7 then concat(p.p_name, ' (feat. X) [2019 Remaster]') else p.p_name end as name,
  concat('artist:', cast(s.suppkey as string)) as artist_id,
  <<artists(>>concat('artist:', cast(s.suppkey as string))<<name=>>concat('Supplier ', cast(s.suppkey % 40 as string))<<)artists>> as artists,
  cast(p.p_size * 2 as int) as popularity, cast(floor(p.p_retailprice * 200) as bigint) as duration_ms, p.p_size % 2 = 0 as explicit,
  case p.p_partkey % 6 when 0 then 'base_collected' when 1 then 'audio_features_added' when 2 then 'lyrics_added' when 3 then 'enriched' when 4 then 'failed' else 'filtered_out' end as status,
  split_part('@LANGUAGES', ',', cast(p.p_partkey % 15 + 1 as int)) as language,
  case when p.p_partkey % 4 = 0 then null else p.p_partkey % 4 = 1 end as musicbrainz_enriched,
  cast(p.p_partkey % 3 as int) as mb_priority, cast(p.p_size as double) / 50 as quality_score, p.p_partkey as n
from {part} p
join (select l_partkey, min(l_suppkey) as suppkey from {lineitem} group by l_partkey) s on s.l_partkey = p.p_partkey
cross join (select cast(floor(3.0 * count(*) / 4) as bigint) as most from {part}) n""",
    "v_artists": """
select concat('artist:', cast(s_suppkey as string)) as spotify_id, s_name as name, cast(floor(greatest(s_acctbal, 0) * 5000) as bigint) as followers,
  cast(s_suppkey % 101 as int) as popularity, split_part('@COUNTRIES', ',', cast(s_nationkey + 1 as int)) as country
from {supplier}""",
    "v_occurrences": """
select l.l_orderkey as playlist_id, concat('part:', cast(l.l_partkey as string)) as spotify_id,
  concat(cast(cast(o.o_orderdate as date) as string), '/', lpad(cast(l.l_orderkey as string), 12, '0'), '/', lpad(cast(l.l_linenumber as string), 3, '0'), '/', lpad(cast(l.l_suppkey as string), 12, '0'), '/',
    lpad(cast(cast(floor(l.l_extendedprice * 100 + 0.5) as bigint) as string), 12, '0'), '/', cast(cast(l.l_shipdate as date) as string), '/', lpad(cast(l.l_partkey as string), 12, '0')) as seq,
  cast(o.o_orderdate as timestamp) as at_time, cast(l.l_quantity as int) as mb_priority, concat('album:', cast(l.l_suppkey % 7 as string)) as album_id
from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey""",
    "v_markets": """
select concat('part:', cast(l.l_partkey as string)) as spotify_id, <<codes(>>split_part('@COUNTRIES', ',', cast(c.c_nationkey + 1 as int))<<)codes>> as markets
from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey join {customer} c on c.c_custkey = o.o_custkey group by l.l_partkey""",
    "v_candidates": """
select doc_id, regexp_replace(regexp_extract(text, '^\\\\s*((?:\\\\S+\\\\s+){0,5}\\\\S+)', 1), '\\\\s+', ' '<<g>>) as title, source as artist,
  case when doc_id % 5 = 0 then 0 when doc_id % 7 = 0 then null else n_chars * 100 end as duration_ms, doc_id % 2 = 1 as processed
from {documents}""",
    "v_edges": """
select distinct c.c_custkey as src, (c.c_custkey * 7 + o.o_orderkey % 11) % n.many as dst
from {customer} c join {orders} o on o.o_custkey = c.c_custkey cross join (select count(*) as many from {customer}) n where o.o_orderpriority like '1%'""",
    "v_queue": """
select event_id as item_id, user_id, case event_type when 'view' then 'pending' when 'click' then 'processing' when 'purchase' then 'done' when 'signup' then 'pending' else 'failed' end as status,
  event_type = 'purchase' as processed, case when event_id % 3 = 0 then null else cast(ts as timestamp) end as locked_at, value as priority, cast(event_id % 4 as int) as retry_count,
  cast(ts as timestamp) as next_run_at, cast(event_id % 9 as int) as page, cast(event_id % 7 + 1 as int) as max_pages, cast((event_id * 13) % 60 as int) as got, cast(event_id % 5 as int) as runs,
  split_part('cis,mena,central_asia,other', ',', cast(event_id % 4 + 1 as int)) as region, event_type
from {events}""",
    "v_text": """
select doc_id as id, case doc_id % 6 @SCRIPTS else substr(text, 1, 80) end as text, lang from {documents}""",
}
for _name in VIEWS:
    VIEWS[_name] = VIEWS[_name].replace("@COUNTRIES", COUNTRIES).replace("@LANGUAGES", LANGUAGES)
VIEWS["v_text"] = VIEWS["v_text"].replace("@SCRIPTS", " ".join(f"when {k} then translate(lower(substr(text, 1, 80)), '{_LATIN}', '{letters}')" for k, letters in ALPHABETS.items()))


def spelled(sql: str, engine: int) -> str:
    out = re.sub(r"<<(.+?)>>", lambda m: SPELLED[m.group(1)][engine], sql)
    # a Spark string literal has its backslashes escaped, one of DuckDB doesn't
    return out if engine == 0 else out.replace("\\\\", "\\")


class Views:
    """Tables and views of one folder, as DataFrames: ``v("part")``, ``v("v_tracks")``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        text = spelled(text, 0)
        names = set(re.findall(r"\{(\w+)\}", text)) & {*TABLES, *VIEWS}
        for name in names:
            text = text.replace(f"{{{name}}}", f"<<{name}>>")
        text = re.sub(r"<<(\w+)>>", r"{\1}", text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(text, **{n: self(n) for n in names})


def duck(query: str) -> str:
    """A query for DuckDB over the views it names, which become common table expressions."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", query)]
    bare = lambda sql: re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", sql)
    text = ",\n".join(f"{n} as ({bare(spelled(VIEWS[n], 1))})" for n in names)
    if not names:
        return query
    lead = re.match(r"\s*with( recursive)? ", query)
    if lead:
        return f"with{lead.group(1) or ''} {text},\n{query[lead.end() :]}"
    return f"with {text}\n{query}"

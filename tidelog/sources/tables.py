"""Event-shaped views over the driver's plain tables, each with the SQL that makes the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.derive import derive, search_columns
from ..functions.text import index_text
from ..schema import EVENT


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in EVENT])


HEX = "lpad(lower(hex({0})), 64, '0')"
KEY = "concat('{1}', lpad(lower(hex({0})), 63, '0'))"
DUCK_HEX = "lpad(lower(to_hex({0})), 64, '0')"
DUCK_KEY = "('{1}' || lpad(lower(to_hex({0})), 63, '0'))"
TAGS = "array<array<string>>"


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: signup is a profile, view a note, click a reaction, purchase an article, error a deletion."""
    e = _read(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint) as created_at", "get_json_object(props, '$.k') as k")
    key = KEY.format("user_id", "a")
    return _events(
        e.selectExpr(
            f"{HEX.format('event_id')} as id", f"{key} as pubkey", "created_at",
            "case event_type when 'signup' then 0 when 'view' then 1 when 'click' then 7 when 'purchase' then 30023 else 5 end as kind",
            f"""concat(
              case when event_type in ('view', 'click') then array(array('t', event_type)) else cast(array() as {TAGS}) end,
              case when event_type = 'click' then array(array('e', {HEX.format('greatest(event_id - 1, 0)')}), array('p', {KEY.format('user_id + 1', 'a')})) else cast(array() as {TAGS}) end,
              case when event_type = 'purchase' then array(array('d', k), array('title', concat('item ', k))) else cast(array() as {TAGS}) end,
              case when event_type = 'error' and event_id % 2 = 0 then array(array('e', {HEX.format('greatest(event_id - 2, 0)')})) else cast(array() as {TAGS}) end,
              case when event_type = 'error' and event_id % 2 = 1 then array(array('a', concat('30023:', {key}, ':', k))) else cast(array() as {TAGS}) end,
              case when event_id % 7 = 0 then array(array('expiration', cast(created_at + 100000 as string))) else cast(array() as {TAGS}) end) as tags""",
            "event_type as content", "'' as sig",
        )
    )


_DUCK_KEY = DUCK_KEY.format("user_id", "a")
EV_SQL = f"""
ev0 AS (SELECT event_id, user_id, event_type, cast(floor(epoch(ts)) AS BIGINT) AS created_at, json_extract_string(props, '$.k') AS k FROM events),
ev1 AS (SELECT {DUCK_HEX.format('event_id')} AS id, {_DUCK_KEY} AS pubkey, created_at,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 7 WHEN 'purchase' THEN 30023 ELSE 5 END AS kind,
  list_concat(list_concat(list_concat(
    CASE WHEN event_type IN ('view', 'click') THEN [['t', event_type]] ELSE []::VARCHAR[][] END,
    CASE WHEN event_type = 'click' THEN [['e', {DUCK_HEX.format('greatest(event_id - 1, 0)')}], ['p', {DUCK_KEY.format('(user_id + 1)', 'a')}]] ELSE []::VARCHAR[][] END),
    list_concat(
    CASE WHEN event_type = 'purchase' THEN [['d', k], ['title', 'item ' || k]] ELSE []::VARCHAR[][] END,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN [['e', {DUCK_HEX.format('greatest(event_id - 2, 0)')}]] ELSE []::VARCHAR[][] END)),
    list_concat(
    CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN [['a', '30023:' || {_DUCK_KEY} || ':' || k]] ELSE []::VARCHAR[][] END,
    CASE WHEN event_id % 7 = 0 THEN [['expiration', (created_at + 100000)::VARCHAR]] ELSE []::VARCHAR[][] END)) AS tags,
  event_type AS content, '' AS sig FROM ev0),
ev AS (SELECT *, pubkey AS owner,
  list_transform(list_filter(tags, lambda t: len(t) >= 2 AND regexp_full_match(t[1], '[A-Za-z]')), lambda t: t[1] || ':' || t[2]) AS tag_index,
  coalesce(list_filter(tags, lambda t: t[1] = 'd')[1][2], '') AS d,
  coalesce(list_filter(tags, lambda t: t[1] = 'expiration')[1][2]::BIGINT, 9223372036854775807) AS expires_at,
  CASE WHEN kind IN (0, 3) OR kind BETWEEN 10000 AND 19999 THEN kind || ':' || pubkey || ':'
       WHEN kind BETWEEN 30000 AND 39999 THEN kind || ':' || pubkey || ':' || coalesce(list_filter(tags, lambda t: t[1] = 'd')[1][2], '') END AS address FROM ev1)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as score cards: service = supplier, subject = customer."""
    l, o = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("(l_orderkey * 8 + l_linenumber) * 4194304 + l_partkey as n", "l_suppkey", "o_custkey", "l_quantity", "l_partkey", "unix_seconds(cast(l_shipdate as timestamp)) as created_at")
    return _events(j.selectExpr(f"{KEY.format('n', 'c')} as id", f"{KEY.format('l_suppkey', 'd')} as pubkey", "created_at", "30382 as kind", f"array(array('d', {KEY.format('o_custkey', 'a')}), array('rank', cast(cast(l_quantity as int) as string)), array('followers', cast(l_partkey as string))) as tags", "'' as content", "'' as sig"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as observers; each names the suppliers of its nation for rank and of the next one for followers."""
    s, n = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    named = s.selectExpr("s_suppkey", "s_nationkey as o", "'30382:rank' as dim").union(s.selectExpr("s_suppkey", "(s_nationkey + 24) % 25 as o", "'30382:followers' as dim"))
    tags = named.groupBy("o").agg(F.expr(f"sort_array(collect_list(array(dim, {KEY.format('s_suppkey', 'd')}, 'wss://relay')))").alias("tags"))
    return _events(n.join(tags, F.col("n_nationkey") == F.col("o")).selectExpr(f"{KEY.format('n_nationkey', 'b')} as id", f"{KEY.format('n_nationkey', 'e')} as pubkey", "cast(1600000000 as bigint) as created_at", "10040 as kind", "tags", "'' as content", "'' as sig"))


TRUST_SQL = f"""
cards AS (SELECT {DUCK_KEY.format('((l_orderkey * 8 + l_linenumber) * 4194304 + l_partkey)', 'c')} AS id, {DUCK_KEY.format('l_suppkey', 'd')} AS service, {DUCK_KEY.format('o_custkey', 'a')} AS subject,
  cast(floor(epoch(l_shipdate)) AS BIGINT) AS created_at, least(greatest(cast(l_quantity AS INTEGER), 0), 100) AS rank, cast(l_partkey AS DOUBLE) AS followers FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
providers AS (SELECT DISTINCT {DUCK_KEY.format('s_suppkey', 'd')} AS service, {DUCK_KEY.format('s_nationkey', 'e')} AS observer, 'rank' AS dim FROM supplier
  UNION SELECT DISTINCT {DUCK_KEY.format('s_suppkey', 'd')}, {DUCK_KEY.format('((s_nationkey + 24) % 25)', 'e')}, 'followers' FROM supplier),
named AS (SELECT subject, observer, dim, CASE dim WHEN 'rank' THEN rank ELSE followers END AS value, created_at, id FROM cards JOIN providers USING (service)),
won AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY subject, observer, dim ORDER BY created_at DESC, id) = 1),
reputation AS (SELECT subject, observer, cast(max(CASE WHEN dim = 'rank' THEN value END) AS INTEGER) AS influence, cast(max(CASE WHEN dim = 'followers' THEN value END) AS FLOAT) AS followers FROM won GROUP BY ALL)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and supplier as profiles with a JSON content."""
    c = _read(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_name as name", "c_mktsegment as about", "'a' as p")
    s = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "s_name as name", "'supplier' as about", "'d' as p")
    return _events(c.union(s).selectExpr("concat(p, lpad(lower(hex(k)), 63, '0')) as id", "concat(p, lpad(lower(hex(k)), 63, '0')) as pubkey", "cast(1500000000 + k as bigint) as created_at", "0 as kind", f"cast(array() as {TAGS}) as tags", "to_json(named_struct('name', name, 'about', about)) as content", "'' as sig"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: title = first line, author by source."""
    d = _read(spark, sf_dir, "documents")
    return _events(d.selectExpr(f"{KEY.format('doc_id', '1')} as id", "concat('f', lpad(lower(hex(crc32(source) % 64)), 63, '0')) as pubkey", "cast(1650000000 + doc_id as bigint) as created_at", "30023 as kind", "array(array('d', cast(doc_id as string)), array('title', substring_index(text, '\\n', 1)), array('t', lang)) as tags", "text as content", "'' as sig"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chat lines."""
    c = _read(spark, sf_dir, "conversations")
    return _events(c.selectExpr(f"{KEY.format('conv_id * 1000 + turn', '2')} as id", "concat('9', lpad(lower(hex(crc32(role) % 64)), 63, '0')) as pubkey", "cast(1660000000 + conv_id * 60 + turn as bigint) as created_at", "9 as kind", f"array(array('e', {KEY.format('conv_id * 1000 + greatest(turn - 1, 0)', '2')})) as tags", "text as content", "'' as sig"))


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as bookmarks: title from the HTML, website = url."""
    p = _read(spark, sf_dir, "pages")
    return _events(p.selectExpr(f"{KEY.format('page_id', '3')} as id", "concat('8', lpad(lower(hex(page_id % 16)), 63, '0')) as pubkey", "cast(1670000000 + page_id as bigint) as created_at", "39701 as kind", "array(array('d', url), array('r', url), array('title', regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))) as tags", "'' as content", "'' as sig"))


def indexed(events: DataFrame) -> DataFrame:
    return index_text(search_columns(derive(events)))

"""Derived tables: listings made deterministically from the driver's tables.

Each is given as a DataFrame and as SQL, so every query has the same input in both engines.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

PROPERTIES = """
select p_partkey as id, cast(floor(p_retailprice * 100) as bigint) as price,
  cast(floor(p_retailprice * 100) as bigint) + (p_partkey % 7 - 3) * 1000 as first_price,
  case when p_partkey % 11 = 0 then null else cast(p_size * 3 as double) end as surface,
  case when p_partkey % 13 = 0 then null else cast(p_partkey * 17 % 900 + 100 as double) end as land_surface,
  case when p_partkey % 9 = 0 then null else p_size % 7 + 1 end as rooms,
  case when p_partkey % 8 = 0 then null else p_size % 4 + 1 end as bedrooms,
  case p_partkey % 3 when 0 then true when 1 then false end as is_new_property,
  case when p_partkey % 17 = 0 then null else 48 + (p_partkey * 37 % 1000) / 1000.0 end as latitude,
  case when p_partkey % 17 = 0 then null else 2 + (p_partkey * 91 % 1000) / 1000.0 end as longitude,
  p_brand as city, lpad(cast(75000 + p_partkey % 97 as varchar(10)), 5, '0') as postal_code, p_name as title,
  substr('ABCDEFG', cast(p_partkey % 7 + 1 as int), 1) as dpe_class, substr('ABCDEFG', cast(p_partkey % 5 + 1 as int), 1) as ges_class,
  cast(p_partkey % 45 as int) as age_days, cast(p_partkey % 30 as int) as updated_days, cast(date '2024-01-15' - cast(p_partkey % 45 as int) as timestamp) as first_seen
from part"""

PUBLICATIONS = """
select o_orderkey as id, o_custkey as property_id,
  case o_orderkey % 4 when 0 then 'bienici' when 1 then 'seloger' when 2 then 'logicimmo' else 'leboncoin' end as source,
  concat(case o_orderkey % 6 when 0 then 'century-21-' when 1 then 'ag123-' when 2 then '' else 'iad-france-' end, cast(o_orderkey as varchar(20))) as external_id,
  concat('https://example.org/ad/', cast(o_orderkey as varchar(20))) as url,
  concat('Annonce ', cast(o_orderkey % 50 as varchar(20))) as title,
  cast(floor(o_totalprice) as bigint) as price, o_orderstatus <> 'F' as is_active, o_orderdate as scraped_at, cast(cast(o_orderdate as date) + cast(o_orderkey % 5 as int) as timestamp) as updated_at,
  case when o_orderkey % 5 = 0 then null else cast(40 + o_custkey % 60 + o_orderkey % 3 as double) end as surface,
  case when o_orderkey % 7 = 0 then null else cast(200 + o_custkey % 500 as double) end as land_surface,
  case when o_orderkey % 6 = 0 then null else cast(o_custkey % 6 + 1 as int) end as rooms,
  case when o_orderkey % 9 = 0 then null else cast(o_custkey % 4 + 1 as int) end as bedrooms,
  case o_orderkey % 3 when 0 then true when 1 then false end as is_new_property,
  concat('Ville ', cast(o_custkey % 23 as varchar(20))) as city,
  case when o_orderkey % 31 = 0 then null else lpad(cast(76000 + o_custkey % 40 as varchar(10)), 5, '0') end as postal_code,
  case o_orderkey % 8 when 0 then 'Maison' when 1 then 'house' when 2 then 'Appartement' when 3 then 'Pavillon' when 4 then ' Maison  de ville' when 5 then 'Villa' when 6 then 'Propriété avec cour' end as property_type,
  case when o_orderkey % 4 = 1 then null else concat('Texte ', o_orderpriority) end as description,
  case when o_orderkey % 10 = 0 then null else concat('https://img.example.org/', cast(o_orderkey % 97 as varchar(20)), '.jpg?w=', cast(o_orderkey % 3 as varchar(20))) end as image_a,
  concat('https://img.example.org/p', cast(o_custkey % 11 as varchar(20)), '.jpg') as image_b,
  case o_orderkey % 5 when 0 then 'Garage' when 1 then 'Jardin' when 2 then 'Cave' when 3 then ' Garage ' end as highlight_a,
  case o_orderkey % 3 when 0 then 'Piscine' when 1 then 'Terrasse' end as highlight_b
from orders"""

REACTIONS = """
select property_id, type, event_id from (
  select user_id as property_id, case event_type when 'purchase' then 'like' else 'dislike' end as type, event_id,
    row_number() over (partition by user_id order by ts desc, event_id desc) as rn
  from events where event_type in ('purchase', 'error')) latest
where rn = 1"""

REACTION_LOG = """
select event_id, user_id as property_id, ts,
  case when event_type = 'purchase' then 'toggle' when event_type = 'error' then 'toggle' when event_type = 'click' and event_id % 2 = 0 then 'archive'
    when event_id % 7 = 0 then 'unarchive' when event_id % 5 = 0 then 'remove' when event_id % 3 = 0 then 'undo' when event_id % 2 = 0 then 'add' else 'none' end as action,
  case when event_type = 'purchase' or event_id % 4 < 2 and event_type <> 'error' then 'like' else 'dislike' end as type
from events"""

CERTIFICATES = """
select s.s_suppkey * 100 + n.n_nationkey as number_, cast(s.s_suppkey % 90 as int) as age,
  substr('ABCDEFG', cast((s.s_suppkey + n.n_nationkey) % 7 + 1 as int), 1) as dpe_class, substr('ABCDEFG', cast(n.n_nationkey % 5 + 1 as int), 1) as ges_class,
  case when s.s_suppkey % 23 = 0 then null else cast((s.s_suppkey * 7 + n.n_nationkey) % 300 as double) end as consumption,
  case when s.s_suppkey % 4 = 0 then null else cast((s.s_suppkey + n.n_nationkey) % 60 as double) end as emission,
  case when n.n_nationkey % 8 = 0 then null when n.n_nationkey % 3 = 0 then '76' else '75' end as department,
  48 + (s.s_suppkey * 13 % 1000) / 1000.0 as latitude, case when n.n_nationkey % 7 = 0 then null else 2 + (n.n_nationkey * 29 % 1000) / 1000.0 end as longitude,
  concat(cast(n.n_nationkey as varchar(10)), ' Rue de l''Église, ', s.s_name, case when s.s_suppkey % 3 = 0 then ' Hameau des Écureuils' else '' end) as address,
  case when s.s_suppkey % 6 = 0 then null else cast(30 + s.s_suppkey % 90 as double) end as surface,
  case when s.s_suppkey % 8 = 0 then null else cast(1950 + s.s_suppkey % 70 as int) end as construction_year,
  case when s.s_suppkey % 9 = 0 then null else cast(date '2024-01-15' - cast(s.s_suppkey * 11 % 1400 as int) as timestamp) end as established
from supplier s cross join nation n"""

HOMES = """
select id, case when id % 19 = 0 then null when id % 2 = 0 then '75011' else '76190' end as postal_code,
  case when id % 13 = 0 then null else dpe_class end as dpe_class, case when id % 4 = 0 then null else ges_class end as ges_class,
  case when id % 3 = 0 then null else cast(id % 300 as double) end as consumption, case when id % 5 = 0 then cast(id % 60 as double) end as emission,
  latitude, longitude, surface, case when id % 6 = 0 then null else cast(1955 + id % 60 as int) end as construction_year,
  concat(title, ' - rue de l''église') as title, case when id % 2 = 0 then 'Superbe maison, hameau des écureuils' end as description
from properties"""

RELISTED = """
select * from publications
union all select id + 10000000 as id, property_id + 1000000 as property_id, case when source = 'seloger' then 'logicimmo' else 'seloger' end as source, concat('r', external_id) as external_id, concat(url, '/r') as url, title, price,
  id % 4 <> 0 as is_active, scraped_at, updated_at, case when id % 18 = 0 then surface + 1 else surface end as surface, land_surface, rooms, bedrooms, is_new_property, city, postal_code, property_type, description, image_a, image_b, highlight_a, highlight_b
from publications where id % 6 = 0"""

STOCK = """
select property_id as id, price, price + property_id % 3 * 500 as first_price, property_id % 3 > 0 as has_price_drop, title, surface, land_surface, rooms, bedrooms, is_new_property, city, postal_code, scraped_at as first_seen_at
from (select *, row_number() over (partition by property_id order by id) as rn from relisted) numbered where rn = 1"""

VIEWS = {"properties": PROPERTIES, "publications": PUBLICATIONS, "reactions": REACTIONS, "reaction_log": REACTION_LOG, "certificates": CERTIFICATES, "homes": HOMES, "relisted": RELISTED, "stock": STOCK}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The driver's tables and the derived ones, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = VIEWS[name]
        used = [t for t in (*TABLES, *VIEWS) if re.search(rf"(?:from|join) {t}\b", sql)]
        return self.spark.sql(reduce(lambda s, t: re.sub(rf"(from|join) {t}\b", rf"\1 {{{t}}}", s), used, sql), **{t: getattr(self, t) for t in used})


def with_views(sql: str) -> str:
    """sql over the derived tables that it names."""
    named = {name for name in VIEWS if re.search(rf"\b{name}\b", sql)}
    while more := {name for name in VIEWS if any(re.search(rf"\bfrom {name}\b", VIEWS[n]) for n in named)} - named:
        named |= more
    used = [f"{name} as ({VIEWS[name]})" for name in VIEWS if name in named]
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(used + [body[15:]])}"
    if body.lower().startswith("with "):
        return f"with {', '.join(used + [body[5:]])}"
    return f"with {', '.join(used)} {body}" if used else body

"""Registered queries of the listing engine, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foyer.functions import scalars as S
from foyer.operators import certificates, enrichment, learning, matching, photos, projection, reactions, scorecache, search, stats
from foyer.plans.fixtures import Tables
from foyer.plans.registry import ORACLE_SQL, QUERIES, query, rounded  # noqa: F401  the driver reads both from here
from foyer.session import stored

ACTIVE = "select p.* from properties p where exists (select 1 from publications u where u.property_id = p.id and u.is_active)"


def _active(t: Tables) -> DataFrame:
    return stats.active_properties(t.properties, t.publications)


def _stored(t: Tables) -> DataFrame:
    """Properties with the columns that only the store has."""
    return t.properties.withColumn("has_price_drop", F.col("first_price") > F.col("price")).withColumn("first_seen_at", -F.col("age_days"))


STORED = "select p.*, first_price > price as has_price_drop, -age_days as first_seen_at from properties p"

# ---------------------------------------------------------------- statistics


@query(f"with active as ({ACTIVE}) select count(*) as n, min(price) as min_price, max(price) as max_price, cast(floor(quantile_cont(price, 0.5) + 0.5) as bigint) as median_price, cast(floor(avg(price) + 0.5) as bigint) as avg_price from active")
def a07_price_stats(t):
    return stats.price_stats(_active(t))


@query(f"""with active as ({ACTIVE}) select (select count(*) from properties) as properties, (select count(*) from active) as active_properties,
  (select count(*) from active where first_price > price) as price_drops, (select count(*) from publications where is_active) as publications, (select count(*) from publications where not is_active) as inactive_publications""")
def a01_a02_a03_a06_overview(t):
    return stats.overview(t.properties, t.publications)


@query("select source, count(*) filter (is_active) as active, count(*) filter (not is_active) as inactive from publications group by source")
def a05_counts_by_source(t):
    return stats.counts_by_source(t.publications)


@query("select city, count(*) as n from properties group by city order by n desc, city limit 10")
def a08_top_cities(t):
    return stats.top_cities(t.properties)


@query("select count(*) filter (scraped_at >= timestamp '1998-07-01' - interval 7 day) as scraped, count(*) filter (not is_active and scraped_at >= timestamp '1998-07-01' - interval 7 day) as deactivated, strftime(max(scraped_at), '%Y-%m-%d') as last_day from publications")
def a09_a10_activity(t):
    return stats.activity(t.publications, "1998-07-01")


@query("select count(*) as n from (select property_id from publications where is_active group by 1 having count(distinct source) > 1)")
def a11_multi_source(t):
    return stats.multi_source(t.publications)


@query("""with n as (select strftime(first_seen, '%Y-%m-%d') as day, count(*) as n from properties group by 1), s as (select strftime(scraped_at, '%Y-%m-%d') as day, count(*) as n from publications group by 1),
  d as (select strftime(updated_at, '%Y-%m-%d') as day, count(*) as n from publications where not is_active group by 1)
  select day, coalesce(n.n, 0) as new_properties, coalesce(s.n, 0) as scrapes, coalesce(d.n, 0) as deactivations from n full join s using (day) full join d using (day)""")
def a12_j15_activity_by_day(t):
    return stats.activity_by_day(t.properties.withColumnRenamed("first_seen", "first_seen_at"), t.publications)


@query("select strftime(ts, '%Y-W%W') as week, count(*) filter (type = 'like') as likes, count(*) filter (type = 'dislike') as dislikes from reaction_log where action = 'toggle' group by 1")
def a13_reactions_by_week(t):
    return stats.reactions_by_week(t.reaction_log.filter("action = 'toggle'").withColumnRenamed("ts", "created_at"))


def _label(c: str) -> str:
    return f"regexp_replace(format('{{:,}}', {c}), ',', chr(8239), 'g') || chr(160) || '€'"


@query(f"""with active as ({ACTIVE}), l as (select min(price) as lo, max(price) as hi, greatest(cast(ceil((max(price) - min(price)) / 8.0) as bigint), 1) as step from active),
  b as (select case when hi = lo then 0 else least((price - lo) // step, 7) end as bucket, lo, hi, step from active cross join l)
  select bucket, lo + bucket * step as low, case when bucket = 7 or hi = lo then hi else lo + (bucket + 1) * step - 1 end as high, count(*) as n, {_label('low')} || case when low = high then '' else ' – ' || {_label('high')} end as label from b group by bucket, lo, hi, step""")
def a14_price_histogram(t):
    return stats.price_histogram(_active(t))


@query("""with u as (select property_id, image_a as url from publications where image_a is not null union all select property_id, image_b from publications),
  o as (select url from u group by url having count(distinct property_id) >= 3) select distinct regexp_replace(url, '[?#].*$', '') as photo from o""")
def a15_j06_overused_photos(t):
    return stats.overused_photos(_with_arrays(t.publications))


@query(f"""with active as ({ACTIVE}) select '2024-01-15' as date, count(*) as active_properties, (select count(*) from publications where is_active) as active_publications,
  cast(floor(quantile_cont(price, 0.5) + 0.5) as bigint) as median_price, count(*) filter (first_price > price) as price_drop_count from active""")
def a18_s23_snapshot(t):
    row = stats.snapshot(t.properties, t.publications, "2024-01-15")
    return stats.upsert_snapshot(row.limit(0), row)


@query("""with d as (select distinct strftime(ts + interval 1 day * (event_id % 2) * 7, '%Y-%m-%d') as date from events)
  select strftime(x, '%Y-%m-%d') as date from generate_series(date '2024-01-01', date '2024-02-05', interval 1 day) g(x) where strftime(x, '%Y-%m-%d') not in (select date from d)""")
def u05_missing_days(t):
    days = t.events.select(F.date_format(F.expr("ts + make_dt_interval(cast(event_id % 2 * 7 as int))"), "yyyy-MM-dd").alias("date")).distinct()
    return stats.missing_days(days, "2024-01-01", "2024-02-05")


@query("select count(*) filter (type = 'like') as likes, count(*) filter (type = 'dislike') as dislikes from reactions where event_id % 8 <> 0")
def a16_reaction_counts(t):
    return reactions.counts(_reactions(t))


@query("select count(*) filter (user_id % 3 = 0) > 0 or count(*) = 0 as send from events")
def a17_notify_household(t):
    return reactions.notify_household(t.events.select((F.col("user_id") % 3 == 0).alias("enabled")))


@query(f"with active as ({ACTIVE}) select id, first_price, price, first_price - price as price_drop from active where first_price > price order by price_drop desc, id limit 10")
def o07_largest_drops(t):
    return stats.largest_drops(_active(t))


# ---------------------------------------------------------------- search


def _page_sql(sql: str, offset: int = 0) -> str:
    """SQL of a page with its rows' places."""
    return f"select row_number() over () + {offset} as at, * from ({sql})"


@query(_page_sql(f"""with s as ({STORED}) select id, price from s where price between 90000 and 190000 and surface >= 20 and land_surface >= 150 and rooms >= 2 and bedrooms >= 1 and exists (select 1 from publications u where u.property_id = s.id and u.is_active and u.source = 'seloger')
  and not exists (select 1 from reactions r where r.property_id = s.id) order by price desc, id limit 50 offset 3""", 3))
def p01_o01_o03_search(t):
    f = search.SearchFilters(min_price=90000, max_price=190000, min_surface=20, min_land_surface=150, min_rooms=2, min_bedrooms=1, source="seloger", without_reaction=True, sort="price_desc", offset=3, limit=50)
    return search.search(_stored(t), t.publications, t.reactions, f).select("at", "id", "price")


@query(_page_sql(f"""with s as ({STORED}) select id, price from s where translate(city, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%brand#1%' and not is_new_property and first_price > price
  and exists (select 1 from publications u where u.property_id = s.id and u.is_active) order by price, id limit 100"""))
def p01a_p01d_p01i_old_drops(t):
    f = search.SearchFilters(city="bRAND#1", old_only=True, price_drop_only=True, limit=100)
    return search.search(_stored(t), t.publications, None, f).select("at", "id", "price")


@query(_page_sql(f"""with s as ({STORED}), said as (select distinct property_id from publications where is_active and contains(lower(description), '2-high'))
  select id from s where exists (select 1 from publications u where u.property_id = s.id and u.is_active) and (contains(lower(title), 'blue') or id in (select property_id from said)) order by first_seen_at desc, id limit 200"""))
def p01g_text_search(t):
    f = search.SearchFilters(text="2-HIGH", sort="date_desc", limit=200)
    found = [search.matching(_stored(t), t.publications, None, search.SearchFilters(text=x)) for x in ("2-HIGH", "blue")]
    return search.page(found[0].unionByName(found[1]).distinct(), f).select("at", "id")


HAVERSINE = "6371 * 2 * atan2(sqrt(a), sqrt(1 - a))"


def _km(lat: str, lng: str) -> str:
    a = f"pow(sin(radians(latitude - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(latitude)) * pow(sin(radians(longitude - {lng}) / 2), 2)"
    return HAVERSINE.replace("(a)", f"({a})").replace("1 - a", f"1 - ({a})")


@query(_page_sql(f"""with s as ({STORED}), d as (select id, surface, {_km('48.5', '2.5')} as km from s where latitude is not null and exists (select 1 from publications u where u.property_id = s.id and u.is_active))
  select id, cast(floor(km * 1000 + 0.5) as bigint) as meters from d where km <= 45 / 60.0 * 50 order by coalesce(surface, 0) desc, km, id limit 40 offset 5""", 5))
def p02_p03_o02_geo_search(t):
    f = search.SearchFilters(city="ignored", travel_minutes=45, sort="surface_desc", limit=40, offset=5)
    found = search.search(_stored(t), t.publications, None, f, center=(48.5, 2.5))
    return found.select("at", "id", F.floor(F.col("distance_km") * 1000 + 0.5).cast("long").alias("meters"))


@query("select count(*) as total from properties p where price >= 120000 and exists (select 1 from publications u where u.property_id = p.id and u.is_active)")
def o04_total(t):
    return search.total(search.matching(_stored(t), t.publications, None, search.SearchFilters(min_price=120000)))


@query('select "at", id, price from properties join (values (1, 17), (2, 3), (3, 999), (4, 5)) w("at", wanted) on id = wanted')
def s04_by_ids(t):
    return search.by_ids(t.properties, [17, 3, 999, 5, 123456789]).select("at", "id", "price")


@query("select p.id, count(u.id) as n, sum(u.price) as total from properties p left join publications u on u.property_id = p.id group by p.id")
def s01_j03_nested_publications(t):
    nested = search.with_publications(t.properties, t.publications)
    return nested.select("id", F.when(F.col("publications").isNull(), 0).otherwise(F.size("publications")).cast("long").alias("n"), F.aggregate("publications", F.lit(0).cast("long"), lambda s, x: s + x["price"]).alias("total"))


@query("select count(*) as n from properties where latitude is not null and longitude is not null")
def p15_mappable(t):
    return search.mappable(t.properties).agg(F.count("*").alias("n"))


@query(_page_sql("select event_id as id from events where event_id < 500 and event_type = 'click' order by ts desc, event_id desc limit 21"))
def p14_o10_keyset_page(t):
    log = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type")
    return search.keyset_page(log, 20, 500, event_type="click").select("at", "id")


@query("select property_id as id from publications except select id from properties union all (select id from properties except select property_id from publications)")
def j02_orphans(t):
    return matching.without_publications(t.properties, t.publications).select("id")


def _reactions(t: Tables) -> DataFrame:
    """The latest reactions; each eighth is archived."""
    return t.reactions.withColumns({"archived": F.col("event_id") % 8 == 0, "created_at": F.col("event_id")})


@query("select p.id, r.type as reaction, r.event_id % 8 = 0 as reaction_archived from properties p left join reactions r on r.property_id = p.id")
def j05_reaction_map(t):
    return search.with_reactions(t.properties, _reactions(t)).select("id", "reaction", "reaction_archived")


@query(_page_sql("select p.id from properties p join reactions r on r.property_id = p.id where r.type = 'like' and r.event_id % 8 <> 0 order by r.event_id desc limit 200"))
def o08_j04_reaction_page(t):
    return reactions.listing_page(t.properties, _reactions(t), "like").select("at", "id")


@query("select id, latitude, longitude, price, first_seen as first_seen_at, surface from properties where id = 17")
def s02_s03_lean_by_id(t):
    return search.lean(search.by_id(t.properties.withColumnRenamed("first_seen", "first_seen_at"), 17))


@query("select id from properties where postal_code in (select lpad(cast(75000 + id % 60 as varchar), 5, '0') from publications where not is_active)")
def s06_of_postal_codes(t):
    listed = t.publications.filter("not is_active").select(F.lpad((F.col("id") % 60 + 75000).cast("string"), 5, "0").alias("postal_code"))
    return search.of_keys(t.properties, listed, "postal_code").select("id")


@query(f"""with s as ({STORED}) select row_number() over (order by price desc, id) as at, id from s where price >= 90500 and exists (select 1 from publications u where u.property_id = s.id and u.is_active)""")
def o05_ranked_ids(t):
    f = search.SearchFilters(min_price=90500, sort="price_desc")
    return search.ranked_ids(search.matching(_stored(t), t.publications, None, f), f)


@query(_page_sql("select id from properties where first_seen > timestamp '2024-01-05' order by first_seen desc, id limit 60"))
def o06_added_since(t):
    return search.added_since(t.properties.withColumnRenamed("first_seen", "first_seen_at"), "2024-01-05 00:00:00", 60).select("at", "id")


@query(_page_sql("""with w as (select * from properties order by price, id limit 100) select id from w order by coalesce(case when surface is not null then surface * 100 / price end, 0) desc, price, id limit 20 offset 10""", 10))
def o09_window_then_rank(t):
    f = search.SearchFilters(offset=10, limit=20)
    return search.window_then_rank(t.properties, F.col("surface") * 100 / F.col("price"), f).select("at", "id")


# ---------------------------------------------------------------- projection

RANK = "case source when 'bienici' then 0 when 'seloger' then 1 when 'logicimmo' then 2 else 3 end"
_FIRST = f"order by {RANK}, scraped_at desc, id"


def _picked(names: tuple[str, ...]) -> str:
    return ", ".join(f"first({n} {_FIRST}) as {n}" if n in projection.PRIMARY else f"first({n} {_FIRST}) filter ({n} is not null) as {n}" for n in names)


PROJECTED = ("title", "price", "city", "surface", "land_surface", "rooms", "bedrooms", "is_new_property", "postal_code")


@query(f"select property_id, {_picked(PROJECTED)} from publications where is_active group by property_id")
def w01_w02_projection(t):
    return projection.project(t.publications, PROJECTED)


@query(f"""with live as (select distinct property_id from publications where is_active) select property_id, {_picked(('property_type', 'surface'))} from publications
  where is_active or property_id not in (select property_id from live) group by property_id""")
def p17_display_projection(t):
    return projection.display(t.publications, ("property_type", "surface"))


@query(f"""with n as (select property_id, {_picked(('title', 'price', 'surface', 'rooms'))} from publications where is_active group by property_id)
  select p.id, case when n.property_id is null then p.title else n.title end as title, case when n.property_id is null then p.price else n.price end as price,
  case when n.property_id is null then p.surface else n.surface end as surface, case when n.property_id is null then p.first_price > p.price else p.first_price > n.price end as has_price_drop
  from properties p left join n on n.property_id = p.id""")
def m08_m20_refresh(t):
    return projection.refresh(_stored(t), t.publications).select("id", "title", "price", "surface", "has_price_drop")


@query(f"""with h as (select property_id, {RANK} as r, scraped_at, id, trim(x) as x, i from publications, (values (1), (2)) k(i), lateral (select case i when 1 then highlight_a else highlight_b end as x) where is_active),
  o as (select property_id, x, row_number() over (partition by property_id order by r, scraped_at desc, id, i) as n from h where x is not null and x <> ''), f as (select property_id, x, min(n) as n from o group by 1, 2)
  select u.property_id, string_agg(f.x, ',' order by f.n) as highlights from (select distinct property_id from publications where is_active) u left join f on f.property_id = u.property_id group by 1""")
def a29_merged_highlights(t):
    return projection.highlights(_with_arrays(t.publications)).withColumn("highlights", F.array_join("highlights", ","))


@query("select property_id, first(description order by length(description) desc, id) as description from publications where is_active and trim(description) <> '' group by 1")
def a30_longest_description(t):
    return projection.longest_description(t.publications)


@query("select u.property_id, u.id, u.source, u.price, u.rooms from publications u join properties p on p.id = u.property_id where u.price is distinct from p.price or u.rooms is distinct from p.rooms")
def p20_publication_deltas(t):
    return projection.deltas(t.properties, t.publications, ("price", "rooms"))


def _with_arrays(publications: DataFrame) -> DataFrame:
    """Arrays and maps from the scalar columns of the derived table; looks of pictures whose names end alike differ in a few bits."""
    pictures = F.array_compact(F.array("image_a", "image_b"))
    name = lambda u: F.regexp_replace(u, r"[?#].*$", "")
    look = F.transform(pictures, lambda u: F.concat(F.substring(F.md5(F.regexp_extract(name(u), r"([0-9])\.jpg$", 1).cast("binary")), 1, 12), F.substring(F.md5(name(u)), 1, 4)))
    return publications.withColumn("image_urls", pictures).withColumn("highlights", F.array("highlight_a", "highlight_b")).withColumn("highlights", F.array_compact("highlights")).withColumn("image_local_hashes", F.map_from_arrays(pictures, F.transform(pictures, F.md5))).withColumn("image_perceptual_hashes", F.map_from_arrays(pictures, look))


@query(f"""with recursive u as (select property_id, {RANK} as r, id, i, x.url from publications, (values (1), (2)) k(i), lateral (select case i when 1 then image_a else image_b end as url) x where is_active and x.url is not null),
  o as (select property_id, row_number() over (partition by property_id order by r, id, i) as n, url, regexp_replace(url, '[?#].*$', '') as k from u),
  p as (select *, md5(url) as content, substr(md5(regexp_extract(k, '([0-9])[.]jpg$', 1)), 1, 12) || substr(md5(k), 1, 4) as look from o),
  s(property_id, n, ks, contents, looks, shown) as (select distinct property_id, cast(0 as bigint), cast([] as varchar[]), cast([] as varchar[]), cast([] as varchar[]), cast([] as varchar[]) from p
    union all select x.property_id, x.n, case when hit then ks else list_append(ks, x.k) end, case when hit then contents else list_append(contents, x.content) end, case when hit then looks else list_append(looks, x.look) end, case when hit then shown else list_append(shown, '/api/media/' || x.content) end
    from (select s.*, p.n as pn, p.k, p.content, p.look as plook, list_contains(ks, p.k) or list_contains(contents, p.content) or len(list_filter(looks, lambda y: y[1:12] = p.look[1:12] and bit_count(xor(cast(concat('0x', y[13:16]) as bigint), cast(concat('0x', p.look[13:16]) as bigint))) <= 8)) > 0 as hit
      from s join p on p.property_id = s.property_id and p.n = s.n + 1) q, lateral (select q.property_id, q.pn as n, q.k, q.content, q.plook as look) x)
  select s.property_id, array_to_string(shown, '|') as photos from s join (select property_id, max(n) as n from p group by 1) m on m.property_id = s.property_id and m.n = s.n""")
def w08_photo_sequence(t):
    merged = projection.photos(_with_arrays(t.publications))
    return merged.filter(F.size("photos") > 0).select("property_id", F.array_join(F.transform("photos", lambda x: x["url"]), "|").alias("photos"))


# ---------------------------------------------------------------- matching

_CANON = "regexp_replace(trim(lower(coalesce({0}, ''))), '\\s+', ' ', 'g')"


def _type_sql(c: str) -> str:
    name = _CANON.format(c)
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in S.PROPERTY_TYPES.items())
    return f"case {name} {cases} else case when {name} like 'maison%' or {name} like 'propriété%' or {name} like 'propriete%' then 'house' else {name} end end"


@query(f"select id, {_type_sql('property_type')} as kind from publications")
def f06_canonical_type(t):
    return t.publications.select("id", S.canonical_type(F.col("property_type")).alias("kind"))


_KEY = f"""substr(sha256(concat(coalesce(postal_code, ''), '|', cast(price as varchar), '|', coalesce(printf('%.1f', surface), ''), '|', coalesce(cast(rooms as varchar), ''), '|', coalesce(cast(bedrooms as varchar), ''), '|',
  {_type_sql('property_type')}, '|', coalesce(printf('%.1f', land_surface), ''), '|', case when is_new_property then '1' when not is_new_property then '0' else '' end)), 1, 32)"""


@query(f"select id, {_KEY} as property_key from publications")
def f05_property_key(t):
    return matching.keyed(t.publications).select("id", "property_key")


@query(f"with k as (select id, {_KEY} as property_key from relisted) select property_key, count(*) as n, min(id) as canonical from k group by 1 having count(*) > 1")
def a19_strict_groups(t):
    return matching.strict_groups(t.relisted)


def _score_sql(a: str, b: str) -> tuple[str, str]:
    ta, tb = _type_sql(f"{a}.property_type"), _type_sql(f"{b}.property_type")
    rel = lambda n: f"abs({a}.{n} - {b}.{n}) / cast(greatest({a}.{n}, {b}.{n}) as double)"
    null = lambda n: f"{a}.{n} is null or {b}.{n} is null"
    parts = {
        "price": f"case when {rel('price')} <= 0.02 then 1.0 else 0.0 end",
        "surface": f"case when {null('surface')} then 0.75 when abs({a}.surface - {b}.surface) <= 2 or {rel('surface')} <= 0.02 then 1.0 else 0.0 end",
        "rooms": f"case when {null('rooms')} then 0.75 when abs({a}.rooms - {b}.rooms) <= 1 then 1.0 else 0.0 end",
        "bedrooms": f"case when {null('bedrooms')} then 0.75 when abs({a}.bedrooms - {b}.bedrooms) <= 1 then 1.0 else 0.0 end",
        "land_surface": f"case when {null('land_surface')} then 0.75 when {rel('land_surface')} <= 0.05 then 1.0 else 0.0 end",
        "property_type": f"case when {ta} = '' or {tb} = '' then 0.75 when {ta} = {tb} then 1.0 else 0.0 end",
    }
    total = " + ".join(f"({p}) * cast({matching.WEIGHTS[n]} as double)" for n, p in parts.items())
    veto = "coalesce(" + ", ".join(f"case when ({p}) = 0 then '{matching.VETOES[n]}' end" for n, p in parts.items()) + ")"
    return total, veto


_TOTAL, _VETO = _score_sql("a", "b")
_SAMPLE = "select * from publications where is_active"


@query(f"""with s as ({_SAMPLE}), p as (select a.id as a_id, b.id as b_id, {_TOTAL} as score, {_VETO} as veto from s a join s b on a.postal_code = b.postal_code and a.property_id = b.property_id and a.id < b.id)
  select a_id, b_id, cast(floor(score * 1000000 + 0.5) as bigint) as score, veto from p""")
def f07_t03_pair_scores(t):
    rows = t.publications.filter("is_active")
    score, veto = matching.pair_score()
    pairs = matching.sided(rows, "a_", "id", "property_id").join(matching.sided(rows, "b_", "id", "property_id"), (F.col("a_postal_code") == F.col("b_postal_code")) & (F.col("a_property_id") == F.col("b_property_id")) & (F.col("a_id") < F.col("b_id")))
    return rounded(pairs.select("a_id", "b_id", score.alias("score"), veto.alias("veto")), "score")


_PAIRS = f"""select distinct a.property_id as a_property_id, b.property_id as b_property_id from ({_SAMPLE}) a join ({_SAMPLE}) b on a.postal_code = b.postal_code and a.property_id < b.property_id and abs(a.price - b.price) <= 0.0200001 * greatest(a.price, b.price)
  where ({_TOTAL}) >= cast(0.85 as double) and ({_VETO}) is null"""


@query(_PAIRS)
def j08_match_pairs(t):
    return matching.match_pairs(t.publications.filter("is_active"))


@query(f"""with recursive pairs as ({_PAIRS}), edges as (select a_property_id as a, b_property_id as b from pairs union select b_property_id, a_property_id from pairs),
  reach(id, r) as (select a, a from edges union select reach.id, edges.b from reach join edges on edges.a = reach.r) select id, min(r) as "group" from reach group by id""")
def u09_groups(t):
    return matching.groups(matching.match_links(t.publications.filter("is_active")))


@query("select source, external_id, max_by(price, id) as price, min(id) as pos from (select id, source, cast(property_id % 50 as varchar) as external_id, price from publications) group by 1, 2")
def w05_t07_deduplicated(t):
    rows = t.publications.select(F.col("id").alias("pos"), "source", (F.col("property_id") % 50).cast("string").alias("external_id"), "price")
    return matching.deduplicated(rows).select("source", "external_id", "price", "pos")


_NEW = "select id as pos, source, case when id % 3 = 0 then concat('x', external_id) else external_id end as external_id, case when id % 5 = 0 then concat(url, '?n') else url end as url, price + id % 2 as price, case when id % 4 = 0 then null else 'neu' end as description from publications where id % 7 < 4 and source <> 'leboncoin'"


def _new_listings(t: Tables) -> DataFrame:
    p = t.publications.filter("id % 7 < 4 and source <> 'leboncoin'")
    return p.select(F.col("id").alias("pos"), "source", F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), "external_id")).otherwise(F.col("external_id")).alias("external_id"), F.when(F.col("id") % 5 == 0, F.concat("url", F.lit("?n"))).otherwise(F.col("url")).alias("url"), (F.col("price") + F.col("id") % 2).alias("price"), F.when(F.col("id") % 4 == 0, None).otherwise("neu").alias("description"))


@query(f"with n as ({_NEW}) select n.pos, coalesce(k.id, u.id) as publication_id from n left join publications k on k.source = n.source and k.external_id = n.external_id left join publications u on u.url = n.url")
def s05_j07_existing(t):
    return matching.existing(_new_listings(t), t.publications).select("pos", "publication_id")


@query(f"""with n as ({_NEW}), e as (select n.*, coalesce(k.id, u.id) as publication_id from n left join publications k on k.source = n.source and k.external_id = n.external_id left join publications u on u.url = n.url)
  select p.id, case when e.pos is null then p.price else e.price end as price, case when e.pos is null then p.description else coalesce(e.description, p.description) end as description, p.is_active or e.pos is not null as is_active from publications p left join e on e.publication_id = p.id""")
def m05_m07_updated(t):
    met = matching.existing(_new_listings(t), t.publications).drop("pos")
    return matching.updated(t.publications, met).select("id", "price", "description", "is_active")


@query(f"""with n as ({_NEW}) select p.id, p.is_active and not (p.source in (select source from n) and not exists (select 1 from n where n.source = p.source and n.external_id = p.external_id) and not exists (select 1 from n where n.url = p.url)) as is_active from publications p""")
def u04_m06_deactivated(t):
    return matching.deactivated(t.publications, _new_listings(t)).select("id", "is_active")


_MAP = "select id as duplicate, id - id % 3 as canonical from properties where id % 3 <> 0"


def _mapping(t: Tables) -> DataFrame:
    return t.properties.filter("id % 3 <> 0").select(F.col("id").alias("duplicate"), (F.col("id") - F.col("id") % 3).alias("canonical"))


@query(f"""with m as ({_MAP}), low as (select canonical, min(first_price) as low from m join properties p on p.id = m.duplicate group by 1)
  select p.id, case when low < first_price then low else first_price end as first_price, case when low < first_price then price < low else first_price > price end as has_price_drop from properties p left join low on canonical = p.id where p.id not in (select duplicate from m)""")
def m09_merged_properties(t):
    empty = t.reactions.select(F.col("event_id").alias("id"), "property_id", "type", F.lit(None).cast("timestamp").alias("archived_at"), F.col("event_id").alias("created_at"))
    return matching.merge(_stored(t), t.publications, empty, _mapping(t))[0].select("id", "first_price", "has_price_drop")


@query(f"with m as ({_MAP}) select coalesce(canonical, property_id) as property_id, count(*) as n from publications p left join m on m.duplicate = p.property_id group by 1")
def m09_merged_publications(t):
    empty = t.reactions.select(F.col("event_id").alias("id"), "property_id", "type", F.lit(None).cast("timestamp").alias("archived_at"), F.col("event_id").alias("created_at"))
    return matching.merge(_stored(t), t.publications, empty, _mapping(t))[1].groupBy("property_id").agg(F.count("*").alias("n"))


@query("select id from properties p where exists (select 1 from publications u where u.property_id = p.id)")
def m13_purged(t):
    return matching.purge_orphans(t.properties, t.publications).select("id")


# ---------------------------------------------------------------- learning

# a model holds the newest 200 of a kind
_TRAIN = "select p.* from properties p join (select property_id from reactions where type = '{0}' order by event_id desc, property_id desc limit 200) r on r.property_id = p.id"
WEIGHTS = {"price": 40, "surface": 25, "rooms": 15, "dpe": 10, "distance": 10}


def _training(t: Tables, kind: str) -> DataFrame:
    own = t.reactions.withColumns({"archived_at": F.lit(None).cast("timestamp"), "created_at": F.col("event_id")})
    return stored(learning.training_rows(t.properties, own, kind), "training")  # a few rows of all events, read several times


def _similar_sql(c: str) -> str:
    if c == "dpe":
        rank = lambda s: f"(case {s}.dpe_class when 'A' then 7 when 'B' then 6 when 'C' then 5 when 'D' then 4 when 'E' then 3 when 'F' then 2 when 'G' then 1 else 0 end)"
        return f"1 - abs({rank('p')} - {rank('t')}) / cast(6 as double)"
    if c == "distance":
        a = "pow(sin(radians(t.latitude - p.latitude) / 2), 2) + cos(radians(p.latitude)) * cos(radians(t.latitude)) * pow(sin(radians(t.longitude - p.longitude) / 2), 2)"
        km = HAVERSINE.replace("(a)", f"({a})").replace("1 - a", f"1 - ({a})")
        return f"case when p.latitude is null or t.latitude is null then null else greatest(0, 1 - ({km}) / 25) end"
    return f"case when p.{c} is null or t.{c} is null then null else 1 - least(1, abs(p.{c} - t.{c}) / cast(greatest(abs(p.{c}), abs(t.{c}), 1) as double)) end"


def _scores_sql(tail: str = "", homes: str = "properties", reacted: str = "reactions") -> str:
    """Scores as s{tail}; homes and reacted name the tables to use."""
    means = ", ".join(f"avg({_similar_sql(c)}) as m_{c}" for c in WEIGHTS)
    maxes = ", ".join(f"max({_similar_sql(c)}) as d_{c}" for c in WEIGHTS)
    one = lambda c: f"greatest(0, least(100, 100 * case when d_{c} is null then m_{c} else greatest(0, m_{c} - d_{c} * 0.5) end))"
    gained = " + ".join(f"case when m_{c} is null then 0 else {one(c)} * {w} end" for c, w in WEIGHTS.items())
    total = " + ".join(f"case when m_{c} is null then 0 else {w} end" for c, w in WEIGHTS.items())
    train = _TRAIN.replace("properties", homes).replace("from reactions", f"from {reacted}")
    return f"""likes{tail} as ({train.format('like')}), dislikes{tail} as ({train.format('dislike')}), a{tail} as (select p.id, {means} from {homes} p cross join likes{tail} t group by p.id), b{tail} as (select p.id, {maxes} from {homes} p cross join dislikes{tail} t group by p.id),
      s{tail} as (select id, ({gained}) / cast(nullif({total}, 0) as double) as score from a{tail} left join b{tail} using (id))"""


@query(f"with {_scores_sql()} select id, cast(floor(score * 10000 + 0.5) as bigint) as score from s")
def l03_j10_scores(t):
    scored = learning.score(t.properties, _training(t, "like"), _training(t, "dislike"), WEIGHTS)
    return rounded(scored.select("id", "score"), "score", digits=4)


@query(f"""with untouched as (select min(id) as id from properties where id not in (select property_id from reactions)),
  changed as (select p.* replace (case when p.id % 10 = 0 and p.id not in (select property_id from reactions) then p.price + 5000 else p.price end as price) from properties p),
  more as (select property_id, type, event_id from reactions union all select id, 'dislike', (select max(event_id) + 1 from reactions) from untouched), {_scores_sql("1", "changed")}, {_scores_sql("2", "changed", "more")}
  select 1 as step, s1.id, cast(floor(score * 10000 + 0.5) as bigint) as score, s1.id % 10 = 0 and s1.id not in (select property_id from reactions) as rescored from s1 union all select 2, id, cast(floor(score * 10000 + 0.5) as bigint), true from s2""")
def l08_rescored(t):
    """Prices of some properties change, then one more is disliked: the first rescores those properties, the second makes another model."""
    reacted = stored(t.reactions, "reactions")
    plain = t.properties.join(reacted.select(F.col("property_id").alias("id")), "id", "left_anti")
    changed = t.properties.join(plain.filter("id % 10 = 0").select("id", F.lit(5000).alias("_more")), "id", "left").withColumn("price", F.col("price") + F.coalesce("_more", F.lit(0))).drop("_more")
    one = plain.agg(F.min("id").alias("property_id")).crossJoin(reacted.agg((F.max("event_id") + 1).alias("event_id"))).select("property_id", F.lit("dislike").alias("type"), "event_id")  # one row each

    def step(homes: DataFrame, reacted: DataFrame, cache: DataFrame | None) -> DataFrame:
        dated = reacted.withColumns({"archived_at": F.lit(None).cast("timestamp"), "created_at": F.col("event_id")})
        return stored(scorecache.refreshed(homes, *(stored(learning.training_rows(homes, dated, k), "training") for k in ("like", "dislike")), WEIGHTS, cache), "scores")

    first = step(t.properties, reacted, None)
    second = step(changed, reacted, first)
    third = step(changed, reacted.unionByName(one), second)
    both = [df.select(F.lit(k).alias("step"), "id", "score", "rescored") for k, df in ((1, second), (2, third))]
    return rounded(both[0].unionByName(both[1]), "score", digits=4)


@query(f"with {_scores_sql()}, r as (select id, round(score, 9) as score from s) select id, row_number() over (order by coalesce(score, 0) desc, id) as rank, count(*) over () as rank_total from r")
def w03_ranks(t):
    scored = learning.score(t.properties, _training(t, "like"), _training(t, "dislike"), WEIGHTS)
    return learning.rank_all(scored.withColumn("score", F.round("score", 9))).drop("score")


@query(f"""with l as ({_TRAIN.format('like')}) select cast(floor(quantile_cont(price, 0.5) + 0.5) as bigint) as ideal_price, cast(floor(max(price) * cast(1.15 as double) + 0.5) as bigint) as max_price, cast(floor(min(surface) * cast(0.9 as double) * 1000 + 0.5) as bigint) as min_surface,
  cast(floor(quantile_cont(surface, 0.5) * 1000 + 0.5) as bigint) as ideal_surface, min(rooms) as min_rooms, count(*) filter (not is_new_property) / cast(nullif(count(is_new_property), 0) as double) >= 0.7 as ancien_only from l""")
def l01_preferences(t):
    p = learning.preferences(_training(t, "like"))
    return p.select(S.half_up(F.col("ideal_price")).alias("ideal_price"), S.half_up(F.col("max_price")).alias("max_price"), S.half_up(F.col("min_surface") * 1000).alias("min_surface"), S.half_up(F.col("ideal_surface") * 1000).alias("ideal_surface"), F.col("min_rooms").cast("int").alias("min_rooms"), "ancien_only")


@query(f"with l as ({_TRAIN.format('like')}), v as (select lower(trim(city)) as value, count(*) as n, min(id) as first_ from l where trim(city) <> '' group by 1) select value, n from v order by n desc, first_ limit 1")
def a22_common_text(t):
    return learning.common_text(_training(t, "like"), "city")


@query(f"""with l as ({_TRAIN.format('like')}), c as (select avg(latitude) as clat, avg(longitude) as clng from l where latitude is not null and longitude is not null)
  select cast(floor(greatest(max({_km('clat', 'clng')}), 1) * 1.3 * 1000 + 0.5) as bigint) as max_m from l cross join c where latitude is not null""")
def a24_home_ground(t):
    return learning.home_ground(_training(t, "like")).select(S.half_up(F.col("max_km") * 1000).alias("max_m"))


@query(f"with {_scores_sql()} select id from s where score >= 40 order by round(score, 9) desc, id limit 25")
def o11_backfill_candidates(t):
    scored = learning.score(t.properties, _training(t, "like"), _training(t, "dislike"), WEIGHTS)
    return learning.backfill_candidates(scored.select("id", F.round("score", 9).alias("score")), 40, 25).select("id")


@query("select id from properties p where not exists (select 1 from reactions r where r.property_id = p.id) and id % 10 <> 0 order by price, id limit 100")
def o13_browse_pool(t):
    return learning.browse_pool(t.properties, t.properties.filter("id % 10 = 0"), t.reactions).select("id")


@query()
def o12_pick(t):
    rows = t.properties.select("id", (F.col("id") % 100).cast("double").alias("score"), F.when(F.col("id") % 4 == 0, "weak").otherwise("good").alias("tier"))
    return learning.pick(rows, 3).unionByName(learning.pick(rows, 5))


# ---------------------------------------------------------------- certificates, reactions, enrichment, text

NOW = "2024-01-15 00:00:00"
_STOP = ", ".join(f"'{w}'" for w in S.PLACE_STOPWORDS)
_STREET = S.STREET_NAME.replace("(?iu)", "(?i)").replace("'", "''")
_HINTS = f"""list_distinct(list_filter(list_transform(list_concat(regexp_split_to_array(title, '[\\s,-]+'), regexp_extract_all(title, '{_STREET}', 1), coalesce(regexp_split_to_array(description, '[\\s,-]+'), []), coalesce(regexp_extract_all(description, '{_STREET}', 1), [])),
  lambda x: regexp_replace(strip_accents(lower(x)), '[^a-z0-9]', '', 'g')), lambda x: length(x) >= 4 and x not in ({_STOP})))"""
_PAIRED = f"""h as (select *, substr(postal_code, 1, 2) as department, {_HINTS} as hints from homes), c as (select *, trim(regexp_replace(strip_accents(lower(address)), '\\s+', ' ', 'g')) as norm from certificates),
  j as (select h.id as home_id, h.dpe_class as hd, h.ges_class as hg, h.consumption as hc, h.emission as he, h.surface as hs, h.construction_year as hy, h.hints, c.*, {_km('c.latitude', 'c.longitude').replace('radians(latitude', 'radians(h.latitude').replace('longitude -', 'h.longitude -')} as km
    from h join c on h.department is not null and (c.department is null or c.department = h.department) and (h.dpe_class is null or h.dpe_class = c.dpe_class) and (h.ges_class is null or h.ges_class = c.ges_class)
      and (h.consumption is null or coalesce(abs(h.consumption - c.consumption) <= 2, false)) and (h.emission is null or coalesce(abs(h.emission - c.emission) <= 1, false)))"""
_SCORED = f"""s as (select home_id, number_, norm, (case when hd = dpe_class then 30 else 0 end) + (case when hg = ges_class then 30 else 0 end) + coalesce(50 * (1 - abs(hc - consumption) / 2), 0) + coalesce(30 * (1 - abs(he - emission) / 1), 0)
    + case when hs > 0 and surface is not null then greatest(0, 20 * (1 - abs(hs - surface) / (hs * 0.25::double))) else 0 end + case when km <= 0.5 then 40 when km <= 2 then 25 when km <= 5 then 10 else 0 end
    + coalesce(list_sum(list_transform(hints, lambda x: case when contains(norm, x) then least(25, length(x) + 10) else 0 end)), 0) + case when abs(hy - construction_year) = 0 then 10 when abs(hy - construction_year) <= 5 then 5 else 0 end
    + case when timestamp '{NOW}' >= established and timestamp '{NOW}' < established + interval 730 day then 5 else 0 end as score from j)"""


@query(f"""with {_PAIRED}, {_SCORED}, o as (select home_id, number_, score from (select *, row_number() over (partition by home_id, norm order by score desc, number_) as n from s) where n = 1),
  r as (select *, row_number() over (partition by home_id order by score desc, number_) as rank from o) select home_id, rank, number_, cast(floor(score * 1000 + 0.5) as bigint) as score from r where rank <= 5""")
def j09_w06_p11_f15_f16_certificate_ranks(t):
    return rounded(certificates.rank(t.homes, t.certificates, NOW), "score", digits=3)


def _variants_sql() -> str:
    """For each search of a home the certificates that it finds; the first search with some stays."""
    def metric(n: str, c: str, tolerance: int, mode: str) -> str:
        around = f"coalesce({c} between greatest(0, floor({n} + 0.5) - {tolerance}) and floor({n} + 0.5) + {tolerance}, false)"
        exact = f"case when abs({n} - floor({n} + 0.5)) < 0.05 then coalesce({c} = floor({n} + 0.5), false) else {around} end"
        return f"({n} is null or {exact if mode == 'exact' else around})"

    parts = []
    for kind, own in (("full", "(hc is not null or he is not null)"), ("degraded", "(hc is null and he is null)")):
        for k, (name, mode, ges, surface) in enumerate(certificates.VARIANTS[kind]):
            asked = [own] + ([metric("hc", "consumption", 2, mode), metric("he", "emission", 1, mode)] if mode != "omit" else [])
            asked += ["(hg is null or hg = ges_class)"] * ges + ["(hs is null or coalesce(surface between floor(hs - hs * 0.25) and ceil(hs + hs * 0.25), false))"] * surface
            parts.append(f"select home_id, {k} as k, '{name}' as variant, count(*) as n from j where hd is not null and department is not null and {' and '.join(asked)} group by home_id")
    return " union all ".join(parts)


@query(f"with {_PAIRED}, v as ({_variants_sql()}) select home_id, first(variant order by k) as variant, first(n order by k) as n from v group by home_id")
def p13_certificate_searches(t):
    return certificates.searched(t.homes, t.certificates)


@query("""select id, case when postal_code is null or dpe_class is null then 'unavailable' when consumption is not null or emission is not null then 'full' else 'degraded' end as readiness,
  coalesce(nullif(concat_ws(' · ', 'dept. ' || substr(postal_code, 1, 2), 'DPE ' || dpe_class, 'GES ' || ges_class, cast(consumption as int) || ' kWh/m²/an', cast(emission as int) || ' kg CO₂/m²/an', cast(surface as int) || ' m² (classement)'), ''), title) as label from homes""")
def p12_f17_search_readiness(t):
    c = F.col
    label = certificates.criteria_label(c("postal_code"), c("dpe_class"), c("ges_class"), c("consumption"), c("emission"), c("surface"), c("title"))
    return t.homes.select("id", certificates.readiness(c("postal_code"), c("dpe_class"), c("consumption"), c("emission")).alias("readiness"), label.alias("label"))


@query("select number_, (select count(*) > 500 from certificates where department = '75') as truncated from certificates where department = '75' order by number_ limit 500")
def s16_capped_certificates(t):
    rows, more = certificates.capped(t.certificates.filter("department = '75'"), certificates.CAP, "number_")
    return rows.select("number_").crossJoin(F.broadcast(more))


@query("select number_ % 500 as number_, min_by(pos, coalesce(age, -1) * 1000000 + pos) as pos from (select number_, case when age % 9 = 0 then null else age end as age, number_ as pos from certificates) group by 1")
def w07_t26_oldest_certificate(t):
    rows = t.certificates.select((F.col("number_") % 500).alias("number_"), F.when(F.col("age") % 9 == 0, None).otherwise(F.col("age")).alias("dated"), F.col("number_").alias("pos"))
    return certificates.deduplicate(rows).select("number_", "pos")


@query("select count(*) as n, count(emission) as known from (select number_, emission from certificates where age < 45 union all select number_, null from certificates where age >= 45)")
def u02_certificate_union(t):
    both = certificates.union(t.certificates.filter("age < 45"), t.certificates.filter("age >= 45"))
    return both.agg(F.count("*").alias("n"), F.count("emission").alias("known"))


@query("""with recursive l as (select *, row_number() over (partition by property_id order by ts, event_id) as rn, count(*) over (partition by property_id) as n from reaction_log where action <> 'none'),
  st(property_id, rn, n, s, archived, since_) as (select distinct property_id, cast(0 as bigint), n, cast(null as varchar), false, cast(null as timestamp) from l
    union all select l.property_id, l.rn, l.n,
      case l.action when 'toggle' then case when s = l.type then null else l.type end when 'add' then l.type when 'remove' then case when s = l.type then null else s end
        when 'undo' then case when s = 'dislike' and l.ts - since_ <= interval 5 second then null else s end else s end,
      case l.action when 'toggle' then false when 'add' then case when s is distinct from l.type or s = 'like' then false else archived end when 'archive' then s is not null and s = 'like' or archived when 'unarchive' then case when s = 'like' then false else archived end else archived end,
      case when l.action in ('toggle', 'add') and s is distinct from l.type then l.ts else since_ end
    from st join l on l.property_id = st.property_id and l.rn = st.rn + 1)
  select property_id, s as type, archived, epoch_us(since_) as created_at from st where rn = n and s is not null""")
def m14_reaction_state(t):
    return reactions.current(t.reaction_log).withColumn("created_at", F.unix_micros("created_at"))


@query("""select id, concat_ws(',', case when not (price > 150000) then null end, case when surface is not null and surface <= 0 then 'surface' end, case when latitude not between -90 and 48.9 then null end) as invalid from properties where false
  union all select id, case when title = '' or title is null then 'title' else '' end from properties""")
def p05_validated(t):
    return enrichment.validated(t.properties.select("id", "title", "price", "surface", "land_surface", "rooms", "bedrooms", "latitude", "longitude", "city")).select("id", F.array_join("invalid", ",").alias("invalid"))


@query("select property_id, first(rooms order by case source when 'seloger' then 0 when 'logicimmo' then 1 when 'leboncoin' then 2 else 3 end, id) filter (rooms is not null) as rooms, first(postal_code order by case source when 'seloger' then 0 when 'logicimmo' then 1 when 'leboncoin' then 2 else 3 end, id) filter (postal_code is not null) as postal_code from publications group by 1")
def m16_merged_patches(t):
    return enrichment.merged_patches(t.publications, ["rooms", "postal_code"])


@query("select p_partkey as id, regexp_extract(concat('Bâti en ', cast(1750 + p_partkey % 300 as varchar), '.'), '\\b(18[89][0-9]|19[0-9]{2}|20[0-2][0-9])\\b', 1) as year from part")
def f18_year_from_text(t):
    said = F.concat(F.lit("Bâti en "), (F.col("p_partkey") % 300 + 1750).cast("string"), F.lit("."))
    return t.part.select(F.col("p_partkey").alias("id"), F.coalesce(S.year_from_text(said).cast("string"), F.lit("")).alias("year"))


@query("select id, strftime(scraped_at, '%Y-W%W') as week from publications")
def f08_week_label(t):
    return t.publications.select("id", S.week_label(F.col("scraped_at").cast("date")).alias("week"))


@query("""select id, case when not regexp_matches(c, '^[0-9]{5}$') then null when c like '200%' then '2A' when c like '20%' then '2B' when regexp_matches(c, '^97[1-8]') then substr(c, 1, 3) else substr(c, 1, 2) end as department
  from (select id, lpad(cast(id * 997 % 99999 as varchar), 5, '0') as c from properties)""")
def f12_department(t):
    return t.properties.select("id", S.department(F.lpad((F.col("id") * 997 % 99999).cast("string"), 5, "0")).alias("department"))


@query("""select id, case when external_id like 'century-21-%' then 'century-21' when external_id like 'iad-france-%' then 'iad-france' when external_id like '%-%' then split_part(external_id, '-', 1) end as slug,
  case when external_id like 'century-21-%' then substr(external_id, 12) when external_id like 'iad-france-%' then substr(external_id, 12) when external_id like '%-%' then split_part(external_id, '-', 2) end as ref from publications""")
def f27_agency(t):
    slug, ref = S.agency(F.col("external_id"))
    return t.publications.select("id", slug.alias("slug"), ref.alias("ref"))


@query("select s_suppkey as id, trim(regexp_replace(strip_accents(lower(concat('Île  de Ré, 3 Rue d''Été Ĺǎ ṩ', s_name))), '\\s+', ' ', 'g')) as norm, trim(regexp_replace(strip_accents(lower(concat('Île  de Ré, 3 Rue d''Été Ĺǎ ṩ', s_name))), '[^a-z0-9]+', ' ', 'g')) as city from supplier")
def f14_normalized_address(t):
    said = F.concat(F.lit("Île  de Ré, 3 Rue d'Été Ĺǎ ṩ"), "s_name")
    return t.supplier.select(F.col("s_suppkey").alias("id"), S.normalize_address(said).alias("norm"), S.normalize_city(said).alias("city"))


@query("select id, regexp_replace(format('{:,}', price), ',', chr(8239), 'g') || chr(160) || '€' as label, case when price >= 1000000 then regexp_replace(printf('%.1f', price / 1e6), '\\.0$', '') || 'M' when price >= 1000 then cast(cast(floor(price / 1000.0 + 0.5) as bigint) as varchar) || 'k' else cast(price as varchar) end as short from properties")
def f37_price_labels(t):
    return t.properties.select("id", S.euros(F.col("price")).alias("label"), S.price_short(F.col("price")).alias("short"))


_LOOK = "substr(md5(cast(vec_id % 50 as varchar)), 1, 12) || substr(md5(cast(vec_id % 400 as varchar)), 1, 4)"
_LOOKS = f"looks as (select min(vec_id) as id, {_LOOK} as look from embeddings group by 2)"


def _looks(t: Tables) -> DataFrame:
    part = lambda n, k: F.substring(F.md5((F.col("vec_id") % n).cast("string").cast("binary")), 1, k)
    return t.embeddings.select("vec_id", F.concat(part(50, 12), part(400, 4)).alias("look"))


@query(f"with {_LOOKS} select a.id as a, b.id as b, bit_count(xor(cast(concat('0x', substr(a.look, 9)) as bigint), cast(concat('0x', substr(b.look, 9)) as bigint))) + bit_count(xor(cast(concat('0x', substr(a.look, 1, 8)) as bigint), cast(concat('0x', substr(b.look, 1, 8)) as bigint))) as bits from looks a join looks b on a.id < b.id where bits <= 8")
def j14_f31_hamming(t):
    """Pairs of different photo hashes within 8 bits, each hash by its first photo."""
    return photos.near_looks(_looks(t), "vec_id", "look")[0]


@query(f"with {_LOOKS} select vec_id, id as same_as from embeddings join looks on look = {_LOOK}")
def j14_equal_hashes(t):
    """The first photo that has the hash of each photo."""
    return photos.near_looks(_looks(t), "vec_id", "look")[1]


from foyer.plans import ingest, portals, runs  # noqa: E402, F401  they register their queries

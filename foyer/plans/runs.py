"""Queries of runs: what batches change and count, what is stored and read again, lines of certificates, further criteria; and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foyer.functions import scalars as S
from foyer.operators import answers, cells, certificates, enrichment, geo, learning, matching, photos, serialize, stats, upsert
from foyer.operators.search import SearchFilters
from foyer.operators.textindex import TextIndex
from foyer.plans import catalogue as C
from foyer.plans import ingest, portals
from foyer.plans.fixtures import Tables
from foyer.plans.registry import query, rounded
from foyer.schemas import SOURCES
from foyer.session import shared_dir
from foyer.sources import connectors
from foyer.sources.versions import Store


def _folder(t: Tables, name: str) -> str:
    """A new folder that all machines share."""
    return f"{shared_dir(t.spark)}/foyer/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- places

_KM = C._km("b.latitude", "b.longitude").replace("radians(latitude", "radians(a.latitude").replace("(longitude", "(a.longitude")


@query(f"""select b.id as center_id, a.id, cast(floor({_KM} * 1000 + 0.5) as bigint) as meters from properties a join properties b on a.latitude between b.latitude - 0.2 and b.latitude + 0.2
  where {_KM} <= case b.id % 3 when 0 then 1 when 1 then 3 else 12 end""")
def p02_p03_centers(t):
    """Every property around every property's place, within 1, 3 or 12 km."""
    radius = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(12)), (F.col("id") % 3 + 1).cast("int"))
    found = cells.near_centers(t.properties, t.properties.select(F.col("id").alias("center_id"), "latitude", "longitude", radius.alias("radius_km")))
    return found.select("center_id", "id", S.half_up(F.col("km") * 1000).alias("meters"))


# ---------------------------------------------------------------- batches


def _broken_batch(t: Tables) -> DataFrame:
    """A batch of which some ads lack their price, and a few that fell end below zero."""
    return ingest._batch(t).withColumns({"price": F.when(F.col("pos") % 50 != 10, F.col("price")), "scraped_at": F.col("scraped_at").cast("timestamp_ntz")})


@query("""with b as (select source, id % 50 = 10 or price - case when id % 10 = 2 then 2000 else 0 end <= 0 as bad, id % 5 = 1 as new, id % 10 = 2 or not is_active as differs from relisted where id % 5 < 3)
  select source, count(*) as found, count(*) filter (bad) as invalid, count(*) filter (not bad and new) as added, count(*) filter (not bad and not new and differs) as updated, count(*) filter (not bad and not new and not differs) as skipped from b group by 1""")
def u01_s20_a31_outcomes(t):
    """Counters of a run, observed while its log is written; what is new is inserted or linked, which hangs on the order of ads."""
    ads = ingest._ads(t).withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))
    totals = upsert.recorded(_broken_batch(t), ingest._stock(t), ads, _folder(t, "run"))
    return totals.filter("found > 0").select("source", "found", "invalid", (F.col("inserted") + F.col("linked")).alias("added"), "updated", "skipped")


@query("select distinct property_id from publications where id % 4 < 2 or id % 3 = 0 and id % 4 < 3")
def u11_to_refresh(t):
    outcome = F.element_at(F.array(*map(F.lit, upsert.OUTCOMES)), (F.col("id") % 4 + 1).cast("int"))
    return upsert.to_refresh(t.publications.select("property_id", outcome.alias("outcome"), ((F.col("id") % 3 == 0) & (F.col("id") % 4 < 3)).alias("price_drop")))


@query("select u.id, coalesce(u.price <> p.price and u.price < p.first_price, false) as fell from publications u join properties p on p.id = u.property_id")
def m03_price_fell(t):
    own = t.publications.select(F.col("id").alias("publication_id"), "property_id", F.col("price").alias("now")).join(t.properties.select(F.col("id").alias("property_id"), F.col("price").alias("before"), "first_price"), "property_id")
    return own.select(F.col("publication_id").alias("id"), upsert.price_fell(F.col("before"), F.col("now"), F.col("first_price")).alias("fell"))


@query("""with r as (select *, min(id) over (partition by source, property_id) as first_, row_number() over (partition by source, property_id order by id desc) as n from publications)
  select source, property_id, first_ as pos, price, title from r where n = 1""")
def m04_u08_batch(t):
    """Of ads that share a key the last one's values, in the place of the first."""
    rows = t.publications.withColumn("pos", F.col("id"))
    return matching.deduplicated(rows, ("source", "property_id")).select("source", "property_id", "pos", "price", "title")


_MERGED = """o as (select coalesce(m.canonical, r.property_id) as pid, r.event_id, r.type, row_number() over (partition by coalesce(m.canonical, r.property_id) order by m.duplicate is not null, r.property_id) as n from reactions r left join m on m.duplicate = r.property_id),
  a as (select * from o where n = 1), two as (select a.pid, a.event_id, case when b.type <> a.type and b.event_id > a.event_id then b.type else a.type end as type from a left join o b on b.pid = a.pid and b.n = 2)"""


@query(f"with m as ({C._MAP}), {_MERGED} select two.pid as property_id, two.event_id as id, case when c.type <> two.type and c.event_id > two.event_id then c.type else two.type end as type from two left join o c on c.pid = two.pid and c.n = 3")
def w09_merged_reactions(t):
    """The reactions after duplicates went into their canonical home: a newer one of the other type changes its type only."""
    rows = t.reactions.select(F.col("event_id").alias("id"), "property_id", "type", F.lit(None).cast("timestamp").alias("archived_at"), F.col("event_id").alias("created_at"))
    return matching.merge(C._stored(t), t.publications, rows, C._mapping(t))[2].select("property_id", "id", "type")


@query("""select id, case when id % 10 = 3 then price + 700 else price end as price, case when id % 16 in (select distinct id % 16 from properties where id % 10 = 3) then 2 else 1 end as since from properties""")
def s21_m08_buckets(t):
    """A batch changes prices; the version after it has new files of the buckets that it met only."""
    store = Store(t.spark, _folder(t, "store"), {"properties": "id"}, buckets=16)
    store.publish({"properties": t.properties.select("id", "price")})
    touched = t.properties.filter("id % 10 = 3").select("id")
    now = store.read("properties").withColumn("price", F.when(F.col("id") % 10 == 3, F.col("price") + 700).otherwise(F.col("price")))
    store.publish({"properties": now}, {"properties": touched})
    return store.read("properties").withColumn("bucket", (F.col("id") % 16).cast("int")).join(store.since("properties"), "bucket").select("id", "price", "since")


# ---------------------------------------------------------------- stored and read again

_NEAR = f"""s as (select * from publications where is_active), n as (select * from publications where not is_active),
  p as (select a.id as a_id, b.property_id as pid, {C._TOTAL} as score, {C._VETO} as veto from n a join s b on a.postal_code = b.postal_code),
  w as (select *, row_number() over (partition by a_id, pid order by score desc, veto is not null, veto) as k from p), g as (select * from w where k = 1),
  r as (select a_id, pid, row_number() over (partition by a_id order by round(score, 9) desc, pid) as rank from g where round(score, 9) >= 0.75 and score < cast(0.85 as double))"""


@query(f"with {_NEAR} select a_id as listing_id, count(*) filter (rank <= 3) as n, first(pid order by rank) as best from r group by 1")
def s22_diagnostics(t):
    """Near misses appended to the table of diagnostics, as it is read back."""
    path = _folder(t, "near-misses")
    near = matching.near_misses(t.publications.filter("not is_active"), t.publications.filter("is_active"))
    connectors.append_diagnostics(near, path, C.NOW)
    return t.spark.read.parquet(path).select("listing_id", F.size("near_misses").cast("long").alias("n"), F.col("near_misses")[0]["property_id"].alias("best"))


@query("select source, external_id, price, rooms from (select 'bienici' as source, external_id, price, rooms from publications) union all select 'error of leboncoin', null, null, null")
def s19_connectors(t):
    """Ads written as JSON lines and gathered by their connector; another source has no file."""
    path = _folder(t, "ads")
    portals._bienici_ads(t).write.json(path)
    rows, errors = connectors.gathered(t.spark, {"bienici": path, "leboncoin": f"{path}-none"}, connectors.connectors(("bienici", "leboncoin")))
    failed = errors.select(F.concat(F.lit("error of "), "source").alias("source"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("external_id", "price", "rooms")))
    return rows.select("source", "external_id", "price", "rooms").unionByName(failed)


@query("""with d as (select distinct strftime(ts - interval 1 day * (day(ts) % 3), '%Y-%m-%d') as date from events)
  select strftime(x, '%Y-%m-%d') as date from generate_series(date '2024-01-01', date '2024-02-05', interval 1 day) g(x) where strftime(x, '%Y-%m-%d') not in (select date from d)""")
def u05_gaps(t):
    """Days without a snapshot, where the events of three days count for one."""
    days = t.events.select(F.date_format(F.expr("ts - make_dt_interval(cast(day(ts) % 3 as int))"), "yyyy-MM-dd").alias("date")).distinct()
    return stats.missing_days(days, "2024-01-01", "2024-02-05")


@query("select distinct md5(image_a || source) as hash from publications where image_a is not null and source <> 'bienici'")
def u06_orphans(t):
    """Stored pictures, one for each portal that shows them, that no ad of one portal uses."""
    named = t.publications.filter("image_a is not null").withColumn("hash", F.md5(F.concat("image_a", "source").cast("binary")))
    return enrichment.orphan_images(named.select("hash").distinct(), named.filter("source = 'bienici'").select(F.create_map("image_a", "hash").alias("image_local_hashes")))


@query("""with texts as (select id, case when id % 10 = 0 then 'Nouveau ' || title || ', ' || description else title || ' ' || description end as text from publications)
  select id, 'high' as needle from texts where contains(lower(text), '2 texte 2-h') union all select id, 'new' from texts where contains(lower(text), 'nouveau annonce 3')""")
def p01g_text_index(t):
    """Texts indexed in two batches, the second of which changes some of the first; two searches by trigrams."""
    text = F.concat("title", F.lit(" "), "description")
    rows = t.publications.select("id", text.alias("text"), F.concat(F.lit("Nouveau "), "title", F.lit(", "), "description").alias("new"))
    index = TextIndex(t.spark, _folder(t, "texts"), buckets=16)
    index.add(rows.filter("id % 3 > 0").select("id", "text"))
    index.add(rows.filter("id % 3 = 0 or id % 10 = 0").select("id", F.when(F.col("id") % 10 == 0, F.col("new")).otherwise(F.col("text")).alias("text")))
    found = [index.search(x).withColumn("needle", F.lit(n)) for n, x in (("high", "2 Texte 2-H"), ("new", "NOUVEAU annonce 3"))]
    return found[0].unionByName(found[1])


# ---------------------------------------------------------------- whole answers


@query(f"""with act as (select property_id, count(*) as n_publications, first(url {C._FIRST}) as primary_url, coalesce(bool_or(contains(lower(description), '2-high')), false) as said from publications where is_active group by 1),
  src as (select property_id, string_agg(source, ',' order by r) as sources from (select distinct property_id, {C.RANK} as r, source from publications where is_active) group by 1),
  f as (select p.id, p.price, act.*, sources, r.type as reaction, case when p.id % 2 = 0 then p.id * 3 end as rank from properties p join act on act.property_id = p.id join src on src.property_id = p.id left join reactions r on r.property_id = p.id where p.price >= 91000 and (contains(lower(p.title), 'blue') or said)),
  n as (select *, row_number() over (order by price, id) as place, count(*) over () as total from f) select place, id, total, sources, n_publications, primary_url, reaction, rank from n where place > 5 and place <= 45""")
def s13_list_answer(t):
    """A page of a list with its total, sources, reactions and ranks."""
    f = SearchFilters(min_price=91_000, text="2-HIGH", offset=5, limit=40)
    ranks = t.properties.filter("id % 2 = 0").select("id", F.lit(1.0).alias("score"), (F.col("id") * 3).alias("rank"), F.lit(9).alias("rank_total"))
    homes = t.properties.withColumn("title", F.when(F.contains(F.lower("title"), F.lit("blue")), F.lit("2-high")).otherwise(F.lit("")))  # the title says it, too
    page = answers.list_answer(homes, t.publications, t.reactions, ranks, f)
    return page.select(F.col("at").alias("place"), "id", "total", F.array_join("sources", ",").alias("sources"), "n_publications", "primary_url", "reaction", "rank")


_STATE = " union all ".join(f"select 'sources', '{s}.{state}', count(*) filter (source = '{s}' and is_active = {state == 'active'}) from publications" for s in SOURCES for state in ("active", "inactive"))


@query(f"""with live as (select distinct property_id from publications where is_active), own as (select id, city, id in (select property_id from live) as on_, first_price > price as fell from properties)
  select 'overview' as section, 'properties' as key, count(*) as value from own union all select 'overview', 'active_properties', count(*) filter (on_) from own union all select 'overview', 'price_drops', count(*) filter (on_ and fell) from own
  union all select 'overview', 'multi_source', count(*) from (select property_id from publications where is_active group by 1 having count(distinct source) > 1)
  union all select 'overview', 'publications', count(*) filter (is_active) from publications union all select 'overview', 'inactive_publications', count(*) filter (not is_active) from publications
  union all {_STATE} union all (select 'cities', city, count(*) as n from properties group by 2 order by n desc, city limit 10)""")
def s13_statistics_answer(t):
    """All sections of counts in one pass."""
    return answers.statistics_answer(t.properties, t.publications)


@query(f"""with src as (select property_id, string_agg('source ' || source, ',' order by r) as sources from (select distinct property_id, {C.RANK} as r, source from publications where is_active) group by 1)
  select p.id, city || case when p.id % 4 = 0 then '' else ' (' || postal_code || ')' end as location_line, concat_ws(' · ', cast(surface as int) || ' m²', cast(land_surface as int) || ' m² land', rooms || ' rooms', bedrooms || ' beds') as specs_line,
    concat_ws(',', 'id ' || p.id, coalesce(sources, 'publications-unavailable'), case p.id % 3 when 1 then 'compatibility good' end, case when r.type is not null then 'reaction-' || r.type end, case when price < first_price then 'price-drop ' || {C._label('(first_price - price)')} || ' (−' || cast(floor((first_price - price) * 100.0 / first_price + 0.5) as int) || ' %)' end) as badges
  from properties p left join src on src.property_id = p.id left join reactions r on r.property_id = p.id""")
def f40_summaries(t):
    """Summary lines and badges of all properties."""
    sources = F.transform(F.array_sort(F.collect_set(F.struct(S.source_rank(F.col("source"), SOURCES).alias("r"), "source"))), lambda x: x["source"])
    own = t.publications.filter("is_active").groupBy(F.col("property_id").alias("id")).agg(sources.alias("sources"))
    rows = t.properties.join(own, "id", "left").join(t.reactions.select(F.col("property_id").alias("id"), F.col("type").alias("reaction")), "id", "left")
    rows = rows.withColumns({"postal_code": F.when(F.col("id") % 4 > 0, F.col("postal_code")), "tier": F.when(F.col("id") % 3 == 1, "good")})
    done = serialize.summary(rows)
    return done.select("id", "location_line", "specs_line", F.array_join(F.transform("badges", lambda b: F.concat_ws(" ", b["kind"], b["label"])), ",").alias("badges"))


@query("""with u as (select property_id, regexp_replace(image_a, '[?#].*$', '') as k from publications where image_a is not null union all select property_id, regexp_replace(image_b, '[?#].*$', '') from publications),
  bad as (select k from u group by 1 having count(distinct property_id) >= 16), own as (select id, case when image_a is not null and regexp_replace(image_a, '[?#].*$', '') not in (select k from bad) then image_a end as a, case when image_b not in (select k from bad) then image_b end as b from publications)
  select id, nullif(concat_ws(',', a, b), '') as urls, coalesce(a, b) as image_url from own""")
def f30_unsyndicated(t):
    """Pictures without those that many homes show; urls count by their key."""
    rows = t.publications.select("id", "property_id", F.array_compact(F.array("image_a", "image_b")).alias("image_urls"))
    keyed = rows.withColumn("image_urls", F.transform("image_urls", S.photo_key))
    done = photos.unsyndicated(rows, stats.overused_photos(keyed, 16))
    return done.select("id", F.array_join("image_urls", ",").alias("urls"), "image_url")


@query("""select id, case when id % 3 = 0 then id % 90 || ' min drive' when id % 3 = 1 then id % 40 || ' km radius' else 'city' end as label,
  case when id % 3 = 0 then id % 90 || ' min drive (~' || cast(floor(id % 90 / 60.0 * 50 + 0.5) as int) || ' km)' when id % 3 = 1 then id % 40 || ' km radius' else 'city' end as scraped from properties""")
def f03_labels(t):
    minutes, radius = F.when(F.col("id") % 3 == 0, (F.col("id") % 90).cast("double")), F.when(F.col("id") % 3 < 2, (F.col("id") % 40).cast("double"))
    return t.properties.select("id", geo.filter_label(minutes, radius).alias("label"), geo.filter_label(minutes, radius, supports_travel=False).alias("scraped"))


# ---------------------------------------------------------------- rules and certificates

_BROKEN = {
    "title": "''", "price": "0", "surface": "-1", "land_surface": "0", "rooms": "0", "bedrooms": "-2", "bathrooms": "0", "dpe_consumption_kwh_m2": "-1", "ges_emission_kg_m2": "-0.5", "parking_spaces": "-1",
    "latitude": "90.5", "longitude": "-180.5", "city": "''", "url": "'no url'", "construction_year": "1799",
}
_SOUND = {"title": "title", "price": "price", "surface": "surface", "land_surface": "land_surface", "rooms": "rooms", "bedrooms": "bedrooms", "bathrooms": "2", "dpe_consumption_kwh_m2": "cast(null as double)", "ges_emission_kg_m2": "0.0", "parking_spaces": "0", "latitude": "latitude", "longitude": "longitude", "city": "city", "url": "'https://example.org/x'", "construction_year": "1800"}


def _rule_columns() -> list[str]:
    """Each rule is broken by the properties whose number leaves its place as remainder of 16, and every second one of those with rooms also breaks the price."""
    return [f"case when id % 16 = {k}{' or id % 32 = 20' if n == 'price' else ''} then {_BROKEN[n]} else {_SOUND[n]} end as {n}" for k, n in enumerate(_BROKEN)]


_RULES_SQL = " ".join(f"when id % 16 = {k} then '{n}'" for k, n in enumerate(_BROKEN))


@query(f"select id, case when id % 32 = 20 then 'price,rooms' {_RULES_SQL} else '' end as invalid from properties")
def p05_each_rule(t):
    rows = t.properties.selectExpr("id", *_rule_columns())
    return enrichment.validated(rows).select("id", F.array_join("invalid", ",").alias("invalid"))


@query("""select 'recent' as dataset, cast(number_ as varchar) as number_, coalesce(address, 'Adresse inconnue') as address, case when number_ % 3 = 0 then '75011' else nullif(regexp_extract(coalesce(address, ''), '\\b(\\d{5})\\b', 1), '') end as postal_code, department, dpe_class, consumption, emission,
    case when longitude is not null and number_ % 5 > 0 then latitude end as latitude, case when number_ % 5 > 0 then longitude end as longitude from (select * replace (case when number_ % 7 = 0 then null else address || ' 76190 Yvetot' end as address) from certificates) where number_ % 11 > 0
  union all select 'legacy', cast(number_ as varchar), address, null, department, dpe_class, consumption, null, latitude, longitude from certificates""")
def f13_certificate_lines(t):
    """Lines of both public datasets as certificates."""
    c = t.certificates
    number = F.col("number_").cast("string")
    spot = F.when(F.col("number_") % 5 > 0, F.concat(F.col("latitude").cast("double").cast("string"), F.lit(", "), F.coalesce(F.col("longitude").cast("double").cast("string"), F.lit("x")))).otherwise("48.5")
    recent = c.select(F.when(F.col("number_") % 11 > 0, number).alias("numero_dpe"), F.when(F.col("number_") % 7 > 0, F.concat("address", F.lit(" 76190 Yvetot"))).alias("adresse_complete_brut"), F.lit(None).cast("string").alias("adresse_ban"), F.when(F.col("number_") % 3 == 0, "75011").alias("code_postal_ban"),
                      F.col("department").alias("code_departement_ban"), F.col("dpe_class").alias("etiquette_dpe"), F.col("consumption").alias("conso_5_usages_par_m2_ep"), F.col("emission").alias("emission_ges_5_usages_par_m2"), spot.alias("_geopoint"))
    legacy = c.select(number.alias("numero_dpe"), F.col("address").alias("geo_adresse"), F.col("department").alias("tv016_departement_code"), F.col("dpe_class").alias("classe_consommation_energie"), F.col("consumption").alias("consommation_energie"), F.col("emission").alias("emission_lost"), "latitude", "longitude")
    both = certificates.mapped(recent, certificates.RECENT, "recent").unionByName(certificates.mapped(legacy, certificates.LEGACY, "legacy"))
    return both.select("dataset", "number_", "address", "postal_code", "department", "dpe_class", "consumption", "emission", "latitude", "longitude")


# ---------------------------------------------------------------- criteria and preferences

_FURNISHED = """furnished as (select *, case when id % 5 = 0 then null else cast(id % 4 as int) end as bathrooms, cast(id % 3 as int) as parking_spaces, case when id % 7 = 0 then null else cast(1950 + id % 60 as int) end as construction_year,
  case id % 4 when 0 then '' when 1 then 'Travaux à prévoir' when 2 then 'Bon état' when 3 then 'À RÉNOVER' end as property_condition, case id % 5 when 0 then null when 1 then 'Gaz' when 2 then ' gaz naturel' when 3 then 'Fioul' else '  ' end as heating,
  case id % 3 when 0 then null when 1 then 'Sud' else 'sud-ouest ' end as orientation, case id % 6 when 0 then null when 1 then 'Garage' when 2 then ' garage ,Jardin' when 3 then 'Jardin clos' when 4 then 'Cave,Garage double' else '' end as highlight_text from properties)"""
CRITERIA = {"land_surface": 5, "bedrooms": 7, "bathrooms": 11, "parking_spaces": 3, "construction_year": 13, "highlights": 17, "condition": 19, "heating": 8, "orientation": 6, "ancien": 9}


def _furnished(t: Tables) -> DataFrame:
    i = F.col("id")
    pick = lambda n, *values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (i % n + 1).cast("int"))
    said = pick(6, None, "Garage", " garage ,Jardin", "Jardin clos", "Cave,Garage double", "")
    return t.properties.withColumns({
        "bathrooms": F.when(i % 5 > 0, (i % 4).cast("int")), "parking_spaces": (i % 3).cast("int"), "construction_year": F.when(i % 7 > 0, (1950 + i % 60).cast("int")), "property_condition": pick(4, "", "Travaux à prévoir", "Bon état", "À RÉNOVER"),
        "heating": pick(5, None, "Gaz", " gaz naturel", "Fioul", "  "), "orientation": pick(3, None, "Sud", "sud-ouest "), "highlights": F.when(said == "", F.array().cast("array<string>")).otherwise(F.split(said, ",")),
    })


def _likeness(c: str) -> str:
    if c == "highlights":
        items = lambda s: f"case when {s}.highlight_text = '' then [] else list_transform(string_split({s}.highlight_text, ','), lambda x: lower(trim(x))) end"
        return f"case when coalesce(len({items('t')}), 0) = 0 then null when coalesce(len({items('p')}), 0) = 0 then 0.0 else len(list_filter({items('t')}, lambda w: len(list_filter({items('p')}, lambda o: contains(o, w) or contains(w, o))) > 0)) / cast(len({items('t')}) as double) end"
    if c == "condition":
        said = lambda s: f"regexp_matches({s}.property_condition, '(?i)travaux|rafraîchir|rénov')"
        return f"case when p.property_condition <> '' and t.property_condition <> '' then cast({said('p')} = {said('t')} as int)::double end"
    if c in ("heating", "orientation"):
        own = lambda s: f"case when {s}.{c} <> '' then lower(trim({s}.{c})) end"
        return f"case when {own('p')} is null or {own('t')} is null then null when {own('p')} = {own('t')} then 1.0 when contains({own('p')}, {own('t')}) or contains({own('t')}, {own('p')}) then 0.8 else 0.0 end"
    if c == "ancien":
        return "cast(p.is_new_property = t.is_new_property as int)::double"
    return C._similar_sql(c)


def _criteria_sql() -> str:
    train = C._TRAIN.replace("properties", "furnished")
    one = {c: f"greatest(0, least(100, 100 * case when d_{c} is null then m_{c} else greatest(0, m_{c} - d_{c} * 0.5) end))" for c in CRITERIA}
    each = ", ".join(f"cast(floor(case when m_{c} is not null then {one[c]} end * 10000 + 0.5) as bigint) as c_{c}" for c in CRITERIA)
    gained = " + ".join(f"case when m_{c} is null then 0 else {one[c]} * {w} end" for c, w in CRITERIA.items())
    total = " + ".join(f"case when m_{c} is null then 0 else {w} end" for c, w in CRITERIA.items())
    side = lambda how, mark: ", ".join(f"{how}({_likeness(c)}) as {mark}_{c}" for c in CRITERIA)
    return f"""{_FURNISHED}, likes as ({train.format('like')}), dislikes as ({train.format('dislike')}), a as (select p.id, {side('avg', 'm')} from furnished p cross join likes t group by p.id), b as (select p.id, {side('max', 'd')} from furnished p cross join dislikes t group by p.id)
      select id, {each}, cast(floor(({gained}) / cast(nullif({total}, 0) as double) * 10000 + 0.5) as bigint) as score from a left join b using (id)"""


def _trained(t: Tables, kind: str) -> DataFrame:
    own = t.reactions.withColumns({"archived_at": F.lit(None).cast("timestamp"), "created_at": F.col("event_id")})
    return learning.training_rows(_furnished(t), own, kind)


@query(f"with {_criteria_sql()}")
def f34_criteria(t):
    """The ten criteria that homes of the given tables don't have by themselves."""
    scored = learning.score(_furnished(t), _trained(t, "like"), _trained(t, "dislike"), CRITERIA)
    names = [f"c_{c}" for c in CRITERIA]
    return rounded(scored.select("id", *names, "score"), *names, "score", digits=4)


def _preferences_sql() -> str:
    over = lambda c: f"case when {c} > 0 then {c} end"
    milli = lambda x: f"cast(floor(({x}) * 1000 + 0.5) as bigint)"
    columns = []
    for c in ("surface", "land_surface"):
        columns += [f"{milli(f'min({over(c)}) * cast(0.9 as double)')} as min_{c}", f"{milli(f'quantile_cont({over(c)}, 0.5)')} as ideal_{c}"]
    for c in ("rooms", "bedrooms", "bathrooms", "parking_spaces"):
        columns += [f"{milli(f'min({over(c)})')} as min_{c}", f"{milli(f'quantile_cont({over(c)}, 0.5)')} as ideal_{c}"]
    columns.append(f"cast(floor(quantile_cont({over('construction_year')}, 0.5) + 0.5) as int) as ideal_construction_year")
    columns.append("count(*) filter (property_condition <> '' and not regexp_matches(property_condition, '(?i)travaux|rafraîchir|rénov')) / cast(nullif(count(*) filter (property_condition <> ''), 0) as double) >= 0.7 as avoid_renovation")
    rank = "(case dpe_class when 'A' then 7 when 'B' then 6 when 'C' then 5 when 'D' then 4 when 'E' then 3 when 'F' then 2 when 'G' then 1 end)"
    columns.append(f"(select letter from (values ('A', 7), ('B', 6), ('C', 5), ('D', 4), ('E', 3), ('F', 2), ('G', 1)) v(letter, r) order by abs(r - (select quantile_cont({rank}, 0.5) from l)), r desc limit 1) as ideal_dpe_class")
    text = lambda c: f"(select v from (select lower(trim({c})) as v, count(*) as n, min(id) as f from l where trim({c}) <> '' group by 1) order by n desc, f limit 1) as ideal_{c}"
    return f"{_FURNISHED}, l as ({C._TRAIN.replace('properties', 'furnished').format('like')}) select {', '.join(columns)}, {text('heating')}, {text('orientation')} from l"


@query(f"with {_preferences_sql()}")
def l01_a23_all_preferences(t):
    """What likes have in common beyond l01: land, bedrooms, baths, parking, year, class, heating, orientation, renovation."""
    p = learning.all_preferences(_trained(t, "like"))
    names = [f"{k}_{c}" for c in ("surface", "land_surface", "rooms", "bedrooms", "bathrooms", "parking_spaces") for k in ("min", "ideal")]
    milli: list[Column] = [S.half_up(F.col(n) * 1000).alias(n) for n in names]
    return p.select(*milli, "ideal_construction_year", "avoid_renovation", "ideal_dpe_class", "ideal_heating", "ideal_orientation")

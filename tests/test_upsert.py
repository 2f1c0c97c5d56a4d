"""Upsert and reconcile against plain versions that take one row after the other."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foyer.functions.scalars import agency, canonical_type
from foyer.operators import reconcile, upsert
from foyer.operators.matching import keyed

LISTING = "pos long, source string, external_id string, url string, title string, price long, surface double, rooms int, bedrooms int, land_surface double, is_new_property boolean, postal_code string, property_type string, city string, description string, image_urls array<string>, scraped_at timestamp_ntz"
PUBLICATION = "id long, property_id long, " + LISTING.partition(", ")[2] + ", agency_slug string, agency_ref string, is_active boolean"
PROPERTY = "id long, property_key string, first_price long, has_price_drop boolean, title string, price long, surface double, rooms int, bedrooms int, land_surface double, is_new_property boolean, postal_code string, property_type string, city string, first_seen_at timestamp_ntz, address_enriched_at timestamp_ntz"
FIELDS = ("price", "surface", "rooms", "bedrooms", "land_surface", "is_new_property", "postal_code", "property_type")


def home(r):
    return {
        "price": r.choice([200_000, 202_000, 203_900, 207_000, 230_000]),
        "surface": r.choice([None, 90.0, 91.5, 93.0, 120.0]),
        "rooms": r.choice([None, 4, 5, 6]),
        "bedrooms": r.choice([None, 2, 3]),
        "land_surface": r.choice([None, 500.0, 520.0]),
        "is_new_property": r.choice([None, False]),
        "postal_code": r.choice(["76170", "76170", "75001", None, ""]),
        "property_type": r.choice([None, "Maison", "house", "Villa"]),
    }


def tables(spark, seed, n_new=60, n_known=25):
    r = random.Random(seed)
    import datetime

    day = lambda k: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=k)
    ads = lambda k: {"source": r.choice(["bienici", "seloger"]), "external_id": r.choice(["ag1-", "iad-france-", ""]) + str(k), "url": f"https://e.org/{k}", "title": f"t{k % 3}", "city": "X", "description": None, "image_urls": r.choice([None, [], ["a"], ["a", "b"]]), "scraped_at": day(k)}
    properties, publications = [], []
    for k in range(n_known):
        own = home(r)
        for _ in range(r.randint(0, 2)):
            publications.append({"id": len(publications) + 1, "property_id": k + 1, **ads(len(publications)), **{**own, **({} if r.random() < 0.6 else home(r))}, "agency_ref": None, "is_active": r.random() < 0.8})
        properties.append({"id": k + 1, "property_key": "", "first_price": own["price"] + 1000, "has_price_drop": True, "title": "p", "city": "X", "first_seen_at": day(r.randint(0, 9)), "address_enriched_at": day(3), **own})
    listings = []
    for k in range(n_new):
        if r.random() < 0.3 and publications:
            p = r.choice(publications)
            listings.append({"pos": k, **{n: p[n] for n in LISTING.replace(",", "").split()[2::2]}, "price": p["price"] - r.choice([0, 0, 5000])})
        else:
            listings.append({"pos": k, **ads(1000 + r.randint(0, n_new)), **home(r)})
    rows = lambda data, kind: spark.createDataFrame([[x.get(n) for n in kind.replace("array<string>", "a").replace(",", "").split()[::2]] for x in data], kind)
    props, pubs, new = rows(properties, PROPERTY), rows(publications, PUBLICATION), rows(listings, LISTING)
    pubs = pubs.withColumn("agency_slug", agency(F.col("external_id"))[0])
    props = reconcile.refreshed_keys(props, pubs).dropDuplicates(["property_key"])
    pubs = pubs.join(props.select(F.col("id").alias("property_id")), "property_id", "left_semi").select(*pubs.columns)
    return new, props.cache(), pubs.cache()


def plain_kind(spark):
    values = [None, "Maison", "house", "Villa"]
    return dict(spark.createDataFrame([(v,) for v in values], "v string").select("v", canonical_type(F.col("v"))).collect())


def match(a, b, kind):
    if not a["postal_code"] or a["postal_code"] != b["postal_code"]:
        return False
    total = 0.0
    for name, weight in (("price", 0.25), ("surface", 0.25), ("rooms", 0.1), ("bedrooms", 0.1), ("land_surface", 0.15)):
        x, y = a[name], b[name]
        if x is None or y is None:
            total += 0.75 * weight
            continue
        gap = abs(x - y)
        rel = gap / max(x, y)
        if not {"price": rel <= 0.02, "surface": gap <= 2 or rel <= 0.02, "rooms": gap <= 1, "bedrooms": gap <= 1, "land_surface": rel <= 0.05}[name]:
            return False
        total += weight
    x, y = kind[a["property_type"]], kind[b["property_type"]]
    if x and y and x != y:
        return False
    return total + 0.15 * (1 if x and y else 0.75) >= 0.85


def plain_outcomes(new, props, pubs, kind):
    by_key = {p["property_key"]: p["id"] for p in props}
    latest = {}
    for x in new:  # the last value in the place of the first
        latest[x["source"], x["external_id"]] = {**x, "pos": latest.get((x["source"], x["external_id"]), x)["pos"]}
    found, pending = {}, []
    for x in latest.values():
        known = next((p for p in pubs if (p["source"], p["external_id"]) == (x["source"], x["external_id"])), None) or next((p for p in sorted(pubs, key=lambda p: p["id"]) if p["url"] == x["url"]), None)
        if known:
            differs = any(x[n] != known[n] for n in (*FIELDS, "title", "city", "description")) or bool(x["image_urls"]) and x["image_urls"] != known["image_urls"]
            found[x["pos"]] = ("updated" if differs or not known["is_active"] else "skipped", known["property_id"], None)
            continue
        at = next((p for p in pending if p[0]["property_key"] == x["property_key"]), None) or next((p for p in pending if any(match(x, y, kind) for y in p)), None)
        if at:
            at.append(x)
            found[x["pos"]] = ("linked", None, at[0]["pos"])
            continue
        owner = by_key.get(x["property_key"])
        if owner is None:
            town = [(p, [q for q in pubs if q["property_id"] == p["id"]]) for p in sorted(props, key=lambda p: p["id"]) if x["postal_code"] and p["postal_code"] == x["postal_code"]]

            def fits(p, own, only):
                kinds = next((q["property_type"] for q in sorted(own, key=lambda q: q["id"]) if q["property_type"]), None)
                rows = [{n: q[n] if q[n] is not None else (kinds if n == "property_type" else p[n]) for n in FIELDS} for q in own if only is None or (q["source"] == "bienici" and q["agency_slug"] == only)]
                if not own and only is None:
                    rows = [{**{n: p[n] for n in FIELDS}, "property_type": None}]
                return any(match(x, y, kind) for y in rows)

            if x["source"] == "bienici" and x["agency_slug"]:
                owner = next((p["id"] for p, own in town if fits(p, own, x["agency_slug"])), None)
            if owner is None:
                owner = next((p["id"] for p, own in town if fits(p, own, None)), None)
        if owner is not None:
            found[x["pos"]] = ("linked", owner, None)
        else:
            pending.append([x])
            found[x["pos"]] = ("inserted", None, x["pos"])
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_and_tables(spark, seed):
    new, props, pubs = tables(spark, seed)
    kind = plain_kind(spark)
    rows = [r.asDict() for r in keyed(new).withColumn("agency_slug", agency(F.col("external_id"))[0]).orderBy("pos").collect()]
    known, stored = [r.asDict() for r in props.collect()], [r.asDict() for r in pubs.collect()]
    want = plain_outcomes(rows, known, stored, kind)
    after, published, found = upsert.upsert(new, props, pubs)
    got = {r.pos: r for r in found.collect()}
    assert {p: r.outcome for p, r in got.items()} == {p: w[0] for p, w in want.items()}
    assert {p: r.created_by for p, r in got.items()} == {p: w[2] for p, w in want.items()}
    assert all(got[p].property_id == w[1] for p, w in want.items() if w[1] is not None)
    totals = upsert.counts(found).first().asDict()
    assert totals == {"found": len(want), **{o: sum(w[0] == o for w in want.values()) for o in upsert.OUTCOMES}}
    price = {p["id"]: (p["price"], p["first_price"]) for p in known}
    last = {}
    for x in rows:
        last[x["source"], x["external_id"]] = {**x, "pos": last.get((x["source"], x["external_id"]), x)["pos"]}
    listed = {x["pos"]: x for x in last.values()}
    fell = {w[1] for p, w in want.items() if w[1] is not None and w[0] in ("updated", "linked") and price[w[1]][0] != listed[p]["price"] < price[w[1]][1]}
    assert {r.property_id for r in upsert.dropped(found).collect()} <= fell

    ids = [r.id for r in after.collect()]
    made = {w[2] for w in want.values() if w[2] is not None}
    assert len(ids) == len(set(ids)) == len(known) + len(made)
    pub_ids = [r.id for r in published.collect()]
    assert len(pub_ids) == len(set(pub_ids)) == len(stored) + sum(w[0] in ("inserted", "linked") for w in want.values())
    own = {(r.source, r.external_id): r for r in published.collect()}
    for p, w in want.items():
        x = listed[p]
        row = own.get((x["source"], x["external_id"])) or next(r for r in published.collect() if r.url == x["url"])
        assert row.is_active and row.scraped_at == x["scraped_at"] and row.property_id == got[p].property_id
    for pos in made:
        members = [listed[p] for p in sorted(want) if want[p][2] == pos]
        row = next(r for r in after.collect() if r.id == got[pos].property_id)
        assert row.property_key == listed[pos]["property_key"] and row.first_price == members[-1]["price"]


def test_a_batch_without_rows_and_empty_tables(spark):
    new, props, pubs = tables(spark, 4, n_new=20)
    assert upsert.counts(upsert.outcomes(new.limit(0), props, pubs)).first().found == 0
    after, published, found = upsert.upsert(new, props.limit(0), pubs.limit(0))
    assert {r.outcome for r in found.collect()} <= {"inserted", "linked"} and after.count() > 0 and published.count() == found.count()


@pytest.mark.parametrize("seed", [5])
def test_reconcile(spark, seed):
    _, props, pubs = tables(spark, seed, n_known=40)
    without = props.join(pubs.select(F.col("property_id").alias("id")), "id", "left_anti")
    more = without.withColumn("id", F.col("id") + 100)  # equal fingerprints
    props = props.unionByName(more).cache()
    kind = plain_kind(spark)
    reactions = props.filter("id % 3 = 0").select((F.col("id") + 1000).alias("id"), F.col("id").alias("property_id"), F.when(F.col("id") % 2 == 0, "like").otherwise("dislike").alias("type"), F.lit(None).cast("timestamp_ntz").alias("archived_at"), F.col("first_seen_at").alias("created_at"))
    done = reconcile.reconcile(props, pubs, reactions)
    homes = {p.id: p.asDict() for p in reconcile.refreshed_keys(props, pubs).collect()}
    ads = [p.asDict() for p in pubs.collect()]

    def merged(groups):
        for group in groups:
            stay, *gone = sorted(group, key=lambda i: (homes[i]["first_seen_at"], i))
            for i in gone:
                for a in ads:
                    if a["property_id"] == i:
                        a["property_id"] = stay
                homes[stay]["first_price"] = min(homes[stay]["first_price"], homes.pop(i)["first_price"])

    by_key = {}
    for i, p in homes.items():
        by_key.setdefault(p["property_key"], []).append(i)
    merged([g for g in by_key.values() if len(g) > 1])
    strict_left = len(homes)
    rows = {}
    for i, p in homes.items():
        own = sorted((a for a in ads if a["property_id"] == i), key=lambda a: a["id"])
        rows[i] = [{**a, "postal_code": a["postal_code"] if a["postal_code"] is not None else p["postal_code"]} for a in own] or [{**p, "property_type": None}]
    block = {i: next((a["postal_code"] for a in r if a["postal_code"]), None) for i, r in rows.items()}
    parent = {i: i for i in homes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in homes:
        for j in homes:
            if i < j and block[i] and block[i] == block[j] and any(match(a, b, kind) for a in rows[i] for b in rows[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in homes:
        groups.setdefault(root(i), []).append(i)
    merged([g for g in groups.values() if len(g) > 1])
    found = {p.id: p.first_price for p in done.properties.collect()}
    assert found == {i: p["first_price"] for i, p in homes.items()}
    assert Counter(p.property_id for p in done.publications.collect()) == Counter(a["property_id"] for a in ads)
    totals = done.counts().first()
    assert (totals.merged, totals.fuzzy_merged, totals.unique) == (len(props.collect()) - strict_left, strict_left - len(homes), len(homes)) and totals.merged
    assert {r.property_id for r in done.reactions.collect()} <= set(found)
    scoped = reconcile.reconcile(props, pubs, reactions, spark.createDataFrame([("75001",)], "postal_code string"))
    assert {p.id for p in scoped.properties.collect()} >= {p.id for p in props.collect() if p.postal_code != "75001"}

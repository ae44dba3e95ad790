"""Queries that SQL can't express, against plain Python over the smallest tables."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from tidewater.functions import rules as R
from tidewater.functions import text as T
from tidewater.operators import resolve, state
from tidewater.plans import registry
from tidewater.plans.q_joins import deals
from tidewater.plans.q_text import _FILING

SUFFIX = re.compile(r"\b(inc|corp|llc|ltd|plc|gmbh|therapeutics|biosciences|pharmaceuticals|pharma)\b")


def plain(name):
    return " ".join(SUFFIX.sub("", re.sub("[,.]", "", (name or "").lower())).split())


def similar(a, b):
    if not a or not b:
        return False
    one = lambda x, y: len(x) >= 6 and y.startswith(x[:6]) or len(x) >= 8 and x[:8] in y
    return a == b or one(a, b) or one(b, a)


def rich(detail):
    return sum(v is not None and v != "" for v in json.loads(detail).values())


def fuzzy(rows):
    top = sorted(rows, key=lambda r: (-r.at.timestamp(), r.id))[:500]
    dead = set()
    for i, a in enumerate(top):
        for b in top[i + 1 :]:
            if a.id in dead or b.id in dead:
                continue
            ca, cb, qa, qb, ta, tb = (plain(x) for x in (a.company, b.company, a.acquirer, b.acquirer, a.acquired, b.acquired))
            days = abs(math.floor((a.at.timestamp() - b.at.timestamp()) / 86400))
            swapped = ta and tb and similar(ca, tb) and similar(cb, ta)
            buyer = qa and qb and (similar(ca, qb) or similar(cb, qa)) and days <= 30
            if swapped or buyer or similar(ta, tb) and similar(qa, qb):
                dead.add(b.id if rich(a.detail) >= rich(b.detail) else a.id)
    return dead


def test_fuzzy_deals(spark, sf):
    rows = deals(spark, sf).collect()
    dead = fuzzy(rows)
    assert dead and {r.id for r in registry.QUERIES["D17_F7_fuzzy_deals"](spark, sf).collect()} == dead


def test_deal_dedup(spark, sf):
    rows = deals(spark, sf).collect()
    want = {(i, "fuzzy") for i in fuzzy(rows)}
    left = {}
    for r in rows:
        if (r.id, "fuzzy") not in want:
            left.setdefault(r.company, []).append(r)
    for group in left.values():
        best = min(group, key=lambda r: (-rich(r.detail), -r.at.timestamp(), r.id))
        want |= {(r.id, "near") for r in group if r.id != best.id and abs(math.floor((best.at.timestamp() - r.at.timestamp()) / 86400)) <= 7}
    assert {(r.id, r.why) for r in registry.QUERIES["L13_deal_dedup"](spark, sf).collect()} == want


def first_name(text, filer, patterns, cut=False):
    for p in patterns:
        m = re.search(p.replace(r"\z", r"\Z"), text)
        if not m:
            continue
        name = " ".join(m[1].split())
        name = re.sub(r"\s*(Inc\.|Corp\.|LLC|Ltd\.).*$", r"\1", name).strip() if cut else name[:80]
        if 3 <= len(name) <= 80 and not name.lower().startswith(filer.lower()[:10]):
            return name
    return ""


def kind_of(text):
    compound = bool(re.search(R.COMPOUND, text))
    best = {}
    for name, each in R.TRANSACTIONS:
        best[name] = sum(w for w, patterns, needs in each if (needs is None or needs == compound) and all(re.search(p, text, re.I) for p in patterns))
    top = max(best.values())
    return "acquisition" if top == 0 else next(k for k, v in best.items() if v == top)


def test_deal_details(spark, sf):
    texts = {r.id: (r.t, r.filer) for r in spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS id", f"{_FILING} AS t", "'Filer ' || o_custkey AS filer").collect()}
    for r in registry.QUERIES["I24_I26_deal_details"](spark, sf).collect():
        text, filer = texts[r.id]
        kind = kind_of(text)
        money = re.search(r"(?i)\$\s*(\d[\d.,]*)\s*(million|billion|M|B)\b", text)
        value = f"${money[1].replace(',', '')}{'B' if money[2].lower()[0] == 'b' else 'M'}" if money else None
        parent = first_name(text, filer, R.PARENT) if kind == "merger" else ""
        target = first_name(text, filer, R.TARGET, cut=True) if kind in ("merger", "acquisition", "partnership") and not parent else ""
        seller = first_name(text, filer, R.SELLER) if kind == "product_acquisition" or kind == "partnership" and not target else ""
        acquired = filer if parent else target or seller
        if kind == "ipo":
            acquired = ""
        elif not acquired:
            acquired = first_name(text[:2000], filer, R.COUNTERPARTY)
        assert (r.transaction_type, r.deal_value, r.acquirer_name, r.acquired_name) == (kind, value, parent or filer, acquired), text
        found = [m[1] for m in (re.search(p, text) for p in R.ASSET) if m and m[1]]
        assert r.acquired_asset == (found[0] if found and kind != "ipo" else None)
        assert filer in r.deal_summary and (not value or value in r.deal_summary or kind == "none")


def clients_of(name, clients):
    """The client of a name by the three layers, all pairs."""
    legal, industry = re.compile(f"(?i){R.CLIENT_LEGAL}$"), re.compile(f"(?i){R.CLIENT_INDUSTRY}$")

    def bare(x):
        x = legal.sub("", x.strip().lower()).strip()
        x = re.sub(r"[,.\s]+$", "", x).strip()
        return re.sub(r"[,.\s]+$", "", industry.sub("", x).strip()).strip()

    def inside(kw, words, text):
        return bool(kw and words) and all(re.search(rf"\b{re.escape(k)}\b", text) if len(k) <= 4 else k in words for k in kw)

    active = [c for c in clients if c[2]]
    layers = (
        [c for c in active if c[0].strip().lower() == name.strip().lower()], [c for c in active if bare(c[0]) == bare(name) != ""],
        [c for c in active if bare(c[0]) and bare(name) and (inside(bare(c[0]).split(), bare(name).split(), bare(name)) or inside(bare(name).split(), bare(c[0]).split(), bare(c[0])))],
    )
    for hits in layers:
        if hits:
            return min(hits, key=lambda c: (c[1], c[0]))[0]
    return None


def test_clients_against_all_pairs(spark):
    names = ["Rho", "rho labs", "Rho-Labs Inc", "Alpha (Beta) Co", "Beta Alpha", "X & Y Bio", "Y X", "A.B. Chem", "chem a.b.", "Zeta", "Rhoda", "& co", "Deltaforce One", "One Deltaforce LLC", "Del ta"]
    clients = [("Rho", 3, True), ("Alpha Beta Pharma", 2, True), ("X Y Therapeutics", 5, True), ("Chem A.B.", 4, True), ("Deltaforce", 1, True), ("Zeta", 9, False), ("&", 7, True), ("One", 8, True)]
    got = {r.name: r.client for r in resolve.match_clients(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(clients, "name string, rank int, is_active boolean")).collect()}
    assert got == {n: clients_of(n, clients) for n in names if clients_of(n, clients)}


def test_contacts_in_turn(spark):
    """The fold over all updates does what one update after another does."""
    kinds = "linkedin_url string, original_title string, original_company string, current_title string, current_company string, current_location string, job_history array<struct<role: string, company: string>>, last_change_type string, last_enrichment_date date"
    contacts = spark.createDataFrame([("u1", "CRA", "Old", "Lead", "Old", "X", [], None, None), ("u2", "", "", "A", "B", "X", None, None, None), ("u3", "A", "B", "A", "B", None, None, "kept", None)], kinds)
    turns = [[("U1", "Head", "New", "X"), ("u2", "A", "B", "Z")], [("u1", "Chief", "New", None), ("u2", "C", "B", "Z")], [("u1", "Chief", "new ", "Y")]]
    want = contacts
    for t in turns:
        want = state.update_contacts(want, spark.createDataFrame(t, "linkedin_url string, title string, company string, location string"), "2026-01-01")
    rows = [(*u, i) for i, t in enumerate(turns) for u in t]
    every = spark.createDataFrame(rows, "linkedin_url string, title string, company string, location string, n int").withColumn("received_at", F.timestamp_seconds("n")).drop("n")
    got = state.update_contacts_in_turn(contacts, every, "2026-01-01")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_has_a_brute_force_version(name):
    assert name in {"D17_F7_fuzzy_deals", "L13_deal_dedup", "I24_I26_deal_details"}

"""Findings of the fourth review."""

import ast
import importlib
from pathlib import Path

import duckdb
from oracle import rows_of
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.plans import registry

c = F.col


def test_url_rules_of_odd_pages(spark, tmp_path):
    """the rule of company pages was gone; without an id it is null, as in the SQL."""
    rows = [(0, "http://a.ORG/x"), (1, None), (2, ""), (3, "http://a.com/?u=b.org"), (-1, "http://organ.com"), (-3, "x.org\n"), (None, "http://c.org"), (3, "http://a.com/?u=b.org"), (2**62, "http://é.Org")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    df = registry.QUERIES["C25_C28_url_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    r = con.execute(registry.SQL["C25_C28_url_rules"])
    want = rows_of([d[0] for d in r.description], r.fetchall())
    assert len(want) == len(rows) and rows_of(df.columns, df.collect()) == want


def test_company_pages(spark):
    """as in the form that takes a company's url; what lies below its page is none."""
    base = "https://www.linkedin.com/company/"
    good = [base + "acme", base + "acme/", base.upper() + "ACME", base + "a b", base + "é"]
    bad = [base, base + "/", base + "acme//", base + "acme/jobs", base + "acme?x=1", base + "acme#x", base + "acme/\n", " " + base + "acme", "http" + base[5:] + "acme", base.replace("www.", "") + "acme", base.replace(".", "x") + "acme", "x\n" + base + "acme", "", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    assert [r.u for r in df.filter(T.company_url(c("u"))).collect()] == good
    assert df.filter(~T.company_url(c("u"))).count() == len(bad)


def test_names_of_modules_are_there():
    """a function was removed that a query still used; found only when it ran."""
    missing = []
    for path in Path(registry.__file__).parent.parent.rglob("*.py"):
        nodes, modules = list(ast.walk(ast.parse(path.read_text()))), {}
        for n in nodes:
            if isinstance(n, ast.ImportFrom) and (n.module or "").startswith("tidewater"):
                source = importlib.import_module(n.module)
                for a in n.names:
                    if not hasattr(source, a.name):
                        importlib.import_module(f"{n.module}.{a.name}")
                    found = getattr(source, a.name)
                    if type(found) is type(ast):
                        modules[a.asname or a.name] = found
        used = [n for n in nodes if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in modules]
        missing += [f"{path.name}: {n.value.id}.{n.attr}" for n in used if not hasattr(modules[n.value.id], n.attr)]
    assert not missing

"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from siftwell.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert sum(got.values()) > 0
        return
    found = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert got == rows(found.columns, found.fetchall())


def test_names_of_both_agree():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= 70


def test_entry_works_without_the_corpus_folders(tmp_path):
    """The corpus subpackage and its pipeline may be left out: a copy without them imports and has the other queries."""
    root = Path(__file__).parent.parent
    code = (
        "import sys, shutil; from pathlib import Path\n"
        f"root, new = Path({str(root)!r}), Path({str(tmp_path)!r})\n"
        "shutil.copy(root / '__spark_entry__.py', new)\n"
        "shutil.copytree(root / 'siftwell', new / 'siftwell', ignore=shutil.ignore_patterns('llm', '__pycache__'))\n"
        "sys.path.insert(0, str(new))\n"
        "import __spark_entry__ as e\n"
        "assert e.__file__.startswith(str(new)) and 'pipe_1_screen' in e.queries() and 'pipe_1_screen' in e.oracle_sql()\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert done.returncode == 0, done.stderr


def test_plans_prune_and_push_down(spark, sf):
    """The scan reads what a query needs and filters there; a screen needs no shuffle."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    known = plan(QUERIES["join_1_known_new"](spark, sf))
    assert "o_totalprice" not in known and "o_orderpriority" not in known
    screen = plan(QUERIES["pipe_1_screen"](spark, sf))
    assert "Exchange" not in screen and "n_chars" not in screen and "EvalPython" not in screen
    top = plan(QUERIES["ord_2_keyset_page"](spark, sf))
    assert "TakeOrderedAndProject" in top


def test_html_to_text_of_entities_that_are_cut(spark, tmp_path):
    """Pages whose titles end within an entity: what is left of it stays, as the SQL says."""
    titles = ["a&amp;b", "a&amp", "a&am", "a &copy", "&amp;&amp;&amp", "&amp;amp;middot;", "x&copyfoo;", "&quot", "&middot;&quot;&copy;"]
    pages = [(i, f"<h1>{t} The</h1><p>{t}</p><script>a()</script>\n{t}") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    name, con = "txt_1_html_to_text", duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df, found = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())


def test_array_jobs_of_empty_and_very_long_texts(spark, tmp_path):
    """Documents without a text give no job, as the SQL says; a text of over 20 million characters stays whole."""
    texts = ["a", "", None, " ", "", None, "\n", "long " * 4_200_000, "b", "long " * 4_200_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source").write.parquet(f"{tmp_path}/documents.parquet")
    name, con = "src_3_array_jobs", duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df, found = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    want = rows(found.columns, found.fetchall())
    assert sum(want.values()) == 6 and rows(df.columns, df.collect()) == want

"""Plan-level checks over every registered query, plus the oracle gate."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from promptforge.plans.oracle_sql import ORACLES
from promptforge.plans.queries import QUERIES
from tests.conftest import SF0001
from tools.check import TABLES, digest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, fn in sorted(QUERIES.items()):
        out[name] = fn(spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_python_udf_in_any_plan(plans):
    bad = {n: [x for x in PY_NODES if x in p] for n, p in plans.items()}
    assert not {n: v for n, v in bad.items() if v}


def library_files():
    """Modules of the library without the optional corpus operators."""
    for d, _, files in os.walk(os.path.join(ROOT, "promptforge")):
        if os.path.relpath(d, ROOT).split(os.sep)[1:2] != ["llm"]:
            yield from (os.path.join(d, f) for f in files if f.endswith(".py"))


def test_library_never_pulls_data_to_the_driver():
    pat = re.compile(r"\.(collect|toPandas|toLocalIterator|rdd)\b|localCheckpoint")
    hits = []
    for f in library_files():
        for i, line in enumerate(open(f), 1):
            # the one exception: names and first lines of result files, one row a file
            if pat.search(line) and "# one row a file" not in line:
                hits.append(f"{f}:{i}: {line.strip()}")
    assert not hits


def test_nothing_else_imports_the_corpus_operators():
    assert not [f for f in library_files() if "promptforge.llm" in open(f).read()]


def test_unpartitioned_windows_only_on_bounded_tables():
    """Single-group windows (no key, or a constant key) are allowed only over
    per-partition offset tables and top-k results (rows.py)."""
    hits = []
    for f in library_files():
        if os.path.basename(f) != "rows.py" and re.search(r"Window\.(orderBy|rowsBetween)|partitionBy\(F\.lit", open(f).read()):
            hits.append(f)
    assert not hits


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["prompt_id", "best_iter", "best_paraphrase", "best_sum"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_oracle_gate_sf0001(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    bad = []
    for name, fn in sorted(QUERIES.items()):
        df = fn(spark, SF0001)
        s = digest(df.columns, [tuple(r) for r in df.collect()])
        cur = con.execute(ORACLES[name])
        d = digest([c[0] for c in cur.description], cur.fetchall())
        if s[0] != d[0] or s[2] != d[2]:
            bad.append(name)
    assert not bad


def _plan(df):
    import contextlib
    import io as _io
    df.write.format("noop").mode("overwrite").save()  # let AQE settle the final plan
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_best_of_is_partial_before_shuffle_and_pruned(spark):
    p = _plan(E.queries()["best_paraphrase"](spark, SF0001))
    assert "partial_max(struct(" in p
    # only the five lineitem columns the candidates need are read
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_quantity:double," \
           "l_discount:double>" in p


def test_sampling_dedups_map_side_and_is_top_k(spark):
    p = _plan(E.queries()["sample_new_prompts"](spark, SF0001))
    assert "partial_min(struct(" in p and "TakeOrderedAndProject" in p and "LeftAnti" in p


def test_filters_reach_the_scan(spark):
    p = _plan(E.queries()["new_prompts_anti"](spark, SF0001))
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in p


@pytest.mark.parametrize("name,exchanges,scans", [("history_rows", 2, 1), ("annotation_rows", 4, 3), ("qca_parse", 0, 1), ("req_icl", 12, 6)])
def test_exchanges_and_scans(spark, name, exchanges, scans):
    p = _plan(QUERIES[name](spark, SF0001))
    p = p[p.index("== Final Plan =="):] if "== Final Plan ==" in p else p
    p = p.split("== Initial Plan ==")[0]
    hashes = len(set(re.findall(r"\((\d+)\) Exchange\n[^\n]*\n[^\n]*\nArguments: hashpartitioning", p)))
    assert hashes <= exchanges
    assert len(set(re.findall(r"\((\d+)\) Scan parquet", p))) <= scans

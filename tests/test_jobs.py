"""The jobs over growing copies of small tables."""

import datetime
import math
import os
import subprocess
import sys
import tempfile
from pathlib import Path

import pytest

from jobs import common, panel_update, queries, text_release

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-jobs-")


def orders(spark, years, persons=40, status="P"):
    rows = [(y * 1000 + k, k % persons, status if k % 3 else "O", 10.0 * k, datetime.datetime(y, 1 + k % 12, 3), "5-LOW" if k % 2 else "1-URGENT") for y in years for k in range(90)]
    return spark.createDataFrame(rows, ORDERS)


def rows_of(spark, out):
    return sorted(map(tuple, panel_update.panel_of(spark, out).collect()), key=str)


def stamps(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_panel_grows_by_new_years_only(spark, folder):
    source, out, whole = (f"{folder}/{n}" for n in ("orders", "out", "whole"))
    orders(spark, (1997, 1998)).write.parquet(source)
    assert panel_update.run(spark, source, out) == {"read": 180, "written": 80, "mark": 1998}
    before = stamps(f"{out}/panel")
    assert panel_update.run(spark, source, out) == {"read": 0, "written": 0, "mark": 1998}
    orders(spark, (1999, 2000)).write.mode("append").parquet(source)
    orders(spark, (1998,)).write.mode("append").parquet(source)  # late rows of a year that was taken are not
    assert panel_update.run(spark, source, out) == {"read": 180, "written": 80, "mark": 2000}
    after = stamps(f"{out}/panel")
    assert before.items() <= after.items() and len(after) > len(before)
    orders(spark, range(1997, 2001)).write.parquet(f"{folder}/all")
    panel_update.run(spark, f"{folder}/all", whole)
    assert rows_of(spark, out) == rows_of(spark, whole) and len(rows_of(spark, out)) == 160
    assert [(m.number, m.asof, m.first_year) for m in panel_update.marks(spark, out)] == [(2, 2000, 1999), (1, 1998, 1900)]
    # year by year is the same as well
    for year in range(1997, 2001):
        panel_update.run(spark, f"{folder}/all", f"{folder}/steps", through=year)
    assert rows_of(spark, f"{folder}/steps") == rows_of(spark, whole)


def test_a_run_that_died_is_made_good(spark, folder, monkeypatch):
    source, out, whole = (f"{folder}/{n}" for n in ("orders", "out", "whole"))
    orders(spark, range(1997, 2000)).write.parquet(source)
    panel_update.run(spark, source, whole)
    panel_update.run(spark, source, out, through=1997)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(panel_update.panel, "carry", dies)
        with pytest.raises(RuntimeError):
            panel_update.run(spark, source, out)
    assert panel_update.marks(spark, out)[0].asof == 1997
    panel_update.run(spark, source, out)
    assert rows_of(spark, out) == rows_of(spark, whole)


def test_corrected_years_are_taken_again(spark, folder):
    source, out, whole = (f"{folder}/{n}" for n in ("orders", "out", "whole"))
    orders(spark, range(1996, 2001)).write.parquet(source)
    for year in (1996, 1998, 2000):
        panel_update.run(spark, source, out, through=year)
    corrected = f"{folder}/corrected"
    orders(spark, (1996, 1998, 1999, 2000)).unionByName(orders(spark, (1997,), status="F")).write.parquet(corrected)
    assert panel_update.run(spark, corrected, out, redo_from=1997)["written"] == 160
    panel_update.run(spark, corrected, whole)
    assert rows_of(spark, out) == rows_of(spark, whole)
    # the state of 1998 is of before the correction and never used again
    mark = panel_update.base_of(panel_update.marks(spark, out), 1999)
    assert (mark.number, mark.asof) == (1, 1996)
    panel_update.run(spark, corrected, out, redo_from=1999)
    assert rows_of(spark, out) == rows_of(spark, whole)


def test_filter_reaches_the_scan_and_nothing_is_nothing(spark, folder, capfd):
    source = f"{folder}/orders"
    orders(spark, (1997,)).write.parquet(source)
    panel_update.new_rows(spark, source, 1996, 1998).explain("formatted")
    plan = capfd.readouterr().out
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    orders(spark, (1997,)).limit(0).write.parquet(f"{folder}/none")
    assert panel_update.run(spark, f"{folder}/none", f"{folder}/out") == {"read": 0, "written": 0, "mark": None}
    assert panel_update.panel_of(spark, f"{folder}/out").collect() == []
    with pytest.raises(ValueError):
        Path(f"{folder}/bad.yaml").write_text("coeds: [20]")
        common.parameters(spark, panel_update.Parameters, f"{folder}/bad.yaml")


def documents(spark, ids, lang="de"):
    return spark.createDataFrame([(i, "wort " * (i % 37) or None, lang, f"s{i % 7}", 0) for i in ids], DOCS)


def export(spark, out):
    return sorted(map(tuple, spark.read.parquet(f"{out}/export").select("section", *text_release.LONG).collect()), key=str)


def test_text_release_measures_new_files_only(spark, folder):
    source, labels, out = f"{folder}/documents", f"{folder}/labels", f"{folder}/out"
    one = lambda place, src=source: text_release.run(spark, src, labels, f"{folder}/{place}", f"{folder}/{place}-check")
    spark.createDataFrame([(i, i % 2, int(i % 19 == 0)) for i in range(60)] + [(3, None, None), (None, 1, 1)], LABELS).write.parquet(labels)
    documents(spark, range(60)).coalesce(1).write.parquet(source)
    got = one("out")
    assert (got["read"], got["without_id"]) == (60, 0)
    first = export(spark, out)
    assert one("out")["read"] == 0 and export(spark, out) == first
    documents(spark, range(60, 100)).coalesce(1).write.mode("append").parquet(source)
    documents(spark, range(200, 203), "en").unionByName(documents(spark, (5, 61))).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(None, "x", "de", "s1", 0), (700, "x", None, None, None)], DOCS).coalesce(1).write.mode("append").parquet(source)
    got = one("out")
    assert (got["read"], got["without_id"]) == (47, 1)
    one("whole")
    assert export(spark, out) == export(spark, f"{folder}/whole") != first
    # a single file is a source too
    part = next(Path(source).glob("*.parquet"))
    assert one("file", str(part))["read"] > 0


def test_no_withheld_cell_can_be_worked_out(spark, folder):
    source, labels, out = f"{folder}/documents", f"{folder}/labels", f"{folder}/out"
    rows = [(i, "w " * (5 if i < 40 else 50 if i < 70 else 500 if i < 73 else 5000), "en", f"s{i % 2 if i < 70 else 9}", 0) for i in range(90)]
    spark.createDataFrame(rows, DOCS).write.parquet(source)
    spark.createDataFrame([(1, 1, 1)], LABELS).write.parquet(labels)
    text_release.run(spark, source, labels, out, f"{folder}/check", text_release.Parameters(least=5))
    told = {(r.section, r.cell): (r.value, r.status) for r in spark.read.parquet(f"{out}/export").collect() if r.section in ("lengths", "ratings")}
    assert told["lengths", "100+"] == (None, "withheld") and told["lengths", "1000+"] == (None, "complement") and told["lengths", "1+"] == (40, "reported")
    assert told["ratings", "quality 1, toxic 1"] == (None, "withheld") and told["ratings", "quality __MISSING__, toxic __MISSING__"] == (None, "complement")
    inner = {(r.section, r.cell): r.value for r in spark.read.parquet(f"{out}/internal").collect()}
    assert inner["lengths", "100+"] == 3 and inner["sources", "s9"] == 20


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_job_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    for name, f in queries.queries().items():
        sql = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in sql.description]
        got = f(spark, DATA)
        assert sorted(names) == sorted(got.columns)
        assert sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=str) == sorted((tuple(map(plain, r)) for r in sql.fetchall()), key=str), name


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("job", ["panel_update", "text_release"])
def test_command_lines(folder, job):
    own = {"panel_update": ["--source", f"{DATA}/orders.parquet", "--through", "1999"], "text_release": ["--documents", f"{DATA}/documents.parquet", "--labels", f"{DATA}/labels.parquet", "--checkpoint", f"{folder}/check"]}[job]
    call = [sys.executable, "-m", f"jobs.{job}", *own, "--out", f"{folder}/out", "--config", f"{ROOT}/jobs/{job}.yaml"]
    done = subprocess.run(call, cwd=ROOT, env=os.environ | {"SPARK_LOCAL_DIRS": folder}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    said = [line for line in done.stderr.splitlines() if f"jobs.{job}" in line]
    assert any("wrote" in line for line in said) and any("read" in line or "measured" in line for line in said)


def test_jobs_import_nothing_of_the_corpus_part():
    code = "import sys, jobs.queries; assert not [m for m in sys.modules if m.startswith(('tessera.llm', 'corpus_pipeline'))]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0

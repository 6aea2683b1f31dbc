"""Invariants of the pipelines, writers, and the plans at scale."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cohortloom import config
from cohortloom.operators import joins
from cohortloom.plans import admission_features, funnel
from cohortloom.registry import base, relational, report  # noqa: F401
from cohortloom.registry.base import data_for
from cohortloom.session import TableStore, shared_dir
from cohortloom.sources import sinks

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def data(spark):
    return data_for(spark, FOLDER)


def test_steps_only_lose_rows(data):
    rows = funnel.funnel_counts(data.steps).collect()
    counts = [r.n_remaining for r in rows]
    assert counts == sorted(counts, reverse=True) and len(counts) == 7
    assert all(a - b == r.n_excluded for a, b, r in zip(counts, counts[1:], rows[1:]))


def test_wide_table_shape(data):
    assert len(data.wide.columns) == 72 and len(set(data.wide.columns)) == 72
    assert data.wide.select("hadm_id").distinct().count() == data.wide.count()


def test_components_add_up(data):
    added = sum((F.col(c) for c in config.SCORE_COMPONENTS[1:]), F.col(config.SCORE_COMPONENTS[0]))
    assert data.final.filter(added != F.col("total_score")).count() == 0
    span = data.final.agg(F.min("total_score"), F.max("total_score")).first()
    assert 0 <= span[0] <= span[1] <= config.SCORE_MAX


def test_partition_count_does_not_change_results(spark, data):
    seen = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        table = admission_features.admission_table(data.src, data.steps["step7"])
        seen.append(sorted(tuple(map(str, r)) for r in table.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_lost_table_is_written_again(spark, data):
    from cohortloom.registry.base import Data

    own = Data(spark, FOLDER)
    n = own.steps["step7"].count()
    own.store.root = own.store.root + "-moved"  # as if the files had gone
    assert own.steps["step7"].count() == n


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_every_document_is_in_exactly_one_note(spark, scale):
    from pyspark.sql import functions as F

    from cohortloom.sources.overlay import overlay_sources

    folder = f"/root/testdata/sf{scale}"
    notes = overlay_sources(spark, folder).table("discharge").filter("note_id > 0")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert notes.count() == docs.count()
    whole = docs.join(notes.withColumnRenamed("text", "note"), docs.doc_id * 10 + 1 == notes.note_id)
    assert whole.filter(F.startswith("note", "text")).count() == docs.count()


def test_notes_are_read_once(data):
    """The feature table starts from stored note facts; no plan reads a note text again."""
    from cohortloom.plans import admission_features as features

    reads = []
    src = SimpleNamespace(table=lambda name, *c: reads.append(name) or data.src.table(name, *c))
    features.admission_table(src, data.steps["step7"], data.steps.notes)
    assert "discharge" not in reads and "inputevents" in reads


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from cohortloom.operators import bootstrap as boot
from cohortloom.session import build_session
spark = build_session("local[2]", "foreign", **{{"spark.sql.shuffle.partitions": "2"}})
rows = spark.range(200).select("id", (F.col("id") % 7).alias("s"), (F.col("id") * 37 % 101).alias("y"))
print("REPLICATES", boot.rank_replicates(rows, "id", "s", "y", 20, 42).count())
"""


def test_python_tasks_need_no_copy_of_the_package(tmp_path):
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert "REPLICATES 20" in done.stdout, done.stderr[-2000:]


def test_swap_keeps_the_name(spark, tmp_path):
    """A table is replaced by a frame that reads it, with a new column."""
    folder = str(tmp_path)
    spark.sql("DROP TABLE IF EXISTS swap_me")
    sinks.swap_table(spark.range(3).selectExpr("id", "id * 2 AS a"), "swap_me", folder)
    sinks.swap_table(spark.table("swap_me").selectExpr("id", "a + 1 AS a", "id AS b"), "swap_me", folder)
    assert [tuple(r) for r in spark.table("swap_me").orderBy("id").select("id", "a", "b").collect()] == [
        (0, 1, 0), (1, 3, 1), (2, 5, 2)]
    spark.sql("DROP TABLE swap_me")


def test_text_is_dropped_before_a_shuffled_join(spark, data):
    notes = data.table("discharge")
    keys = data.table("admissions", "hadm_id")  # a join's output: size unknown
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        out = joins.extract_for_keys(notes, keys, "hadm_id", admission_features.note_facts)
        assert "text" not in out.columns
        assert out.count() == notes.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_replace_columns_has_no_duplicates(spark):
    base = spark.createDataFrame([(1, 2, 3)], "k int, a int, b int")
    update = spark.createDataFrame([(1, 9, 8)], "k int, b int, c int")
    out = sinks.replace_columns(base, update, "k")
    assert sorted(out.columns) == ["a", "b", "c", "k"] and out.first().b == 9


def test_swap_table_reads_itself(spark, tmp_path):
    name = "swap_me"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    first = str(tmp_path / "v0")
    spark.range(5).write.parquet(first)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{first}'")
    sinks.swap_table(spark.table(name).withColumn("x", F.lit(1)), name, str(tmp_path))
    assert spark.table(name).count() == 5 and "x" in spark.table(name).columns
    spark.sql(f"DROP TABLE {name}")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 1.5)], "s string, i int, d double")
    sinks.write_csv(df, str(tmp_path / "t"))
    back = sinks.read_csv(spark, str(tmp_path / "t"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect()) or back.count() == 2


def fake_session(settings, master):
    context = SimpleNamespace(master=master, applicationId="x")
    return SimpleNamespace(conf=settings, sparkContext=context)


def test_shared_dir_is_read_from_the_session(spark):
    named = fake_session({"spark.checkpoint.dir": "/shared/folder/"}, "yarn")
    assert shared_dir(named) == "/shared/folder"
    with pytest.raises(RuntimeError):
        shared_dir(fake_session({}, "yarn"))
    assert TableStore(spark).root.startswith(shared_dir(spark))


def test_event_scan_is_pruned_and_filtered(spark, tmp_path):
    from cohortloom.sources.tables import Sources

    events = spark.createDataFrame(
        [(1, 221794, None, 1.0)], "stay_id long, itemid int, starttime timestamp_ntz, amount double")
    events.withColumn("extra", F.lit("x")).write.parquet(str(tmp_path / "inputevents"))
    src = Sources.from_folder(spark, str(tmp_path))
    stays = spark.createDataFrame([(1, 10)], "stay_id long, hadm_id long")
    plan = funnel.step6(stays, src)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "In(itemid" in scan and "extra" not in scan and "amount" not in scan


def test_versions_replace_a_table_that_is_read(spark):
    table = sinks.Versions(spark, "kept")
    for number in list(table.numbers()):
        spark.sql(f"DROP TABLE {table.database}.{table.numbers()[number]}")
    first = table.write(spark.range(3).selectExpr("id", "id * 2 AS a"))
    start = table.current()
    second = table.write(table.read().selectExpr("id", "a + 1 AS a", "id AS b"))
    assert [tuple(r) for r in second.orderBy("id").collect()] == [(0, 1, 0), (1, 3, 1), (2, 5, 2)]
    assert [tuple(r) for r in first.orderBy("id").collect()] == [(0, 0), (1, 2), (2, 4)]
    broken = table.read().withColumn("a", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        table.write(broken)
    assert table.current() == start + 1 and table.read().count() == 3
    for _ in range(3):
        table.write(table.read().withColumn("a", F.col("a") + 1))
    assert len(table.numbers()) == 2 and table.current() == max(table.numbers())
    assert table.read().agg(F.sum("a")).first()[0] == 1 + 3 + 5 + 9
    assert table.read(min(table.numbers())).agg(F.sum("a")).first()[0] == 1 + 3 + 5 + 6


def test_changed_sources_are_read_again(spark, tmp_path):
    import shutil

    from cohortloom.sources.overlay import BASE_TABLES

    folder = str(tmp_path / "tables")
    os.mkdir(folder)
    for name in BASE_TABLES:
        shutil.copy(f"{FOLDER}/{name}.parquet", folder)
    before = base.data_for(spark, folder)
    assert base.data_for(spark, folder) is before
    rows = base.QUERIES["load_cohort"](spark, folder).count()
    name = "events" if "events" in BASE_TABLES else BASE_TABLES[0]
    less = spark.read.parquet(f"{FOLDER}/{name}.parquet").toPandas().head(40)
    less.to_parquet(f"{folder}/{name}.parquet")
    after = base.data_for(spark, folder)
    assert after is not before and after.key != before.key
    assert after.table is not None and base.QUERIES["load_cohort"](spark, folder).count() <= rows
    assert list(k for k in base._DATA if k[1] == folder) == [(spark.sparkContext.applicationId, folder)]


def test_sources_of_admissions_keep_their_rows(spark, tmp_path):
    from cohortloom.sources.overlay import overlay_sources
    from cohortloom.sources.tables import SCHEMAS

    folder = str(tmp_path)
    order_days = [(k if k % 11 else None, k % 7, f"1996-01-{k % 28 + 1:02d} 00:00:00") for k in range(1, 60)]
    orders = spark.createDataFrame(order_days + order_days[:5], "o_orderkey bigint, o_custkey bigint, d string")
    orders.selectExpr("o_orderkey", "o_custkey", "CAST(d AS TIMESTAMP_NTZ) AS o_orderdate", "1 AS o_unused"
                      ).write.parquet(f"{folder}/orders.parquet")
    lines = [(k if k % 13 else None, 7 * k + n, k % 5, n, float(k % 50)) for k in range(1, 60) for n in range(1, 5)]
    spark.createDataFrame(
        lines + lines[:9], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double"
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, f"text {k}") for k in range(9)], "doc_id bigint, text string"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k,) for k in range(7)], "c_custkey bigint").write.parquet(f"{folder}/customer.parquet")

    src = overlay_sources(spark, folder)
    keys = spark.createDataFrame([(k,) for k in (2, 3, 3, 5, 22, 40, None)], "hadm_id bigint")
    near = src.of_admissions(keys, TableStore(spark, f"{folder}/kept").save)
    stays = src.table("icustays").join(keys.distinct(), "hadm_id", "left_semi").select("stay_id").distinct()
    ed = src.table("edstays").join(keys.distinct(), "hadm_id", "left_semi").select("stay_id").distinct()

    def rows(of, name):
        frame = of.table(name)
        if name in ("discharge", "patients"):
            pass
        elif "hadm_id" in SCHEMAS[name]:
            frame = frame.join(keys.distinct(), "hadm_id", "left_semi")
        else:
            frame = frame.join(ed if name in ("triage", "ed_vitalsign") else stays, "stay_id", "left_semi")
        return sorted(map(str, frame.collect()))

    for name in SCHEMAS:
        assert rows(near, name) == rows(src, name), name
    assert rows(near, "chemistry") and rows(near, "inputevents")
    for name in ("chemistry", "inputevents", "vitalsign", "charlson"):
        assert near.table(name).count() < src.table(name).count()
        assert not any(f.endswith("/lineitem.parquet") or "/lineitem.parquet/" in f
                       for f in near.table(name).inputFiles())


def exchange_keys(df):
    """The columns that the plan's exchanges deal rows by, without their numbers."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scan_deals_no_table_by_admission_again(data, no_broadcast):
    """The views over orders and lineitem share one exchange of each, made when they were stored."""
    keys = exchange_keys(relational.scan_sources(data))
    assert "stay_id" in keys
    # the one left deals the documents that notes are made of
    assert [k for k in keys if k in ("l_orderkey", "o_orderkey", "hadm_id")] == ["hadm_id"]


def test_dealt_tables_hold_the_same_rows(spark, tmp_path, no_broadcast):
    """Null keys and repeated rows too, in every view, with more parts than keys in some."""
    from cohortloom.sources.overlay import overlay_sources
    from cohortloom.sources.tables import SCHEMAS

    folder = str(tmp_path)
    order_days = [(k if k % 11 else None, k % 7, f"1996-01-{k % 28 + 1:02d} 00:00:00") for k in range(1, 40)]
    spark.createDataFrame(order_days + order_days[:5], "o_orderkey bigint, o_custkey bigint, d string").selectExpr(
        "o_orderkey", "o_custkey", "CAST(d AS TIMESTAMP_NTZ) AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    lines = [(k if k % 13 else None, 7 * k + n, k % 5, n, float(k % 50)) for k in range(1, 40) for n in range(1, 5)]
    spark.createDataFrame(
        lines + lines[:9], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double"
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, f"text {k}") for k in range(9)], "doc_id bigint, text string"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k,) for k in range(7)], "c_custkey bigint").write.parquet(f"{folder}/customer.parquet")
    src = overlay_sources(spark, folder)
    dealt = src.by_admission(TableStore(spark, f"{folder}/kept", 50).save)
    for name in SCHEMAS:
        assert sorted(map(str, dealt.table(name).collect())) == sorted(map(str, src.table(name).collect())), name
    assert exchange_keys(src.table("inputevents")) and not exchange_keys(dealt.table("inputevents"))


def test_steps_and_features_meet_without_exchange(data, no_broadcast):
    """Stored steps lie by admission like the tables they meet, before the reduction and after it."""
    step1, step7 = data.steps["step1"], data.steps["step7"]
    assert not exchange_keys(funnel.step3(step1, data.dealt))
    labs = admission_features.first_labs(data.near, step7.select("hadm_id").distinct())
    assert not exchange_keys(labs) and labs.count() == step7.count()
    assert exchange_keys(funnel.step3(step1, data.src))

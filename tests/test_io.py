"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill.operators import segment as S
from pagemill.operators.schedule import STATE_SCHEMA, upsert_items
from pagemill.session import scratch_path, scratch_root
from pagemill.sources import readers as R
from pagemill.sources import sinks as K
from pagemill.sources import state as V
from pagemill.streaming import flows as T


def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scratch_is_the_shared_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_seed_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('research_id,research_name\n1,"Fire, ""x"" & more"\n2,Plain\n2,Plain\n')
    assert rows(R.read_seed(spark, str(tmp_path))) == [(1, 'Fire, "x" & more'), (2, "Plain"), (2, "Plain")]


def test_list_json_over_several_lines(spark, tmp_path):
    doc = {"prizes": [{"category": "c", "year": "1999", "laureates": [{"id": "1", "surname": "S"}, {"id": "2"}]}, {"category": "d"}]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=2))
    got = R.explode_list(R.read_nested_json(spark, str(tmp_path))).select("category", "year", "id", "surname")
    assert rows(got) == [("c", "1999", "1", "S"), ("c", "1999", "2", None)]


def test_list_json_of_one_line_each(spark, tmp_path):
    doc = {"prizes": [{"category": "c", "year": "1999", "laureates": [{"id": "1"}]}]}
    (tmp_path / "p.json").write_text("\n" + json.dumps(doc) + "\n" + json.dumps(doc) + "\n")
    assert R.explode_list(R.read_nested_json(spark, str(tmp_path))).count() == 2
    (tmp_path / "q.json").write_text(json.dumps(doc, indent=2))
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_nested_json(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("value, names", [("[[]]", None), ('""', None), ('[{"name":"U","city":"C"}]', ["U"]), (None, None)])
def test_detail_with_mixed_affiliations(spark, value, names):
    prize = "{}" if value is None else '{"affiliations": ' + value + "}"
    df = spark.createDataFrame([(1, '{"laureates": [{"gender": "f", "prizes": [' + prize + "]}]}"), (2, "{}")], "id int, doc string")
    got = {r.id: r for r in R.first_detail(df, "doc", keep=["id"]).collect()}
    assert got[1].gender == "f" and got[2].gender is None
    found = got[1].affiliations
    assert (found and [a.name for a in found]) == names


def test_export_is_one_row_per_file(spark, tmp_path):
    (tmp_path / "a.html").write_text("<div>\n1</div>\n")
    (tmp_path / "b.html").write_text("<div>2</div>")
    got = R.read_export(spark, str(tmp_path)).select(F.substring_index("file_id", "/", -1), "html")
    assert rows(got) == [("a.html", "<div>\n1</div>\n"), ("b.html", "<div>2</div>")]


def test_attachments_meet_their_texts(spark, tmp_path):
    (tmp_path / "7.pdf").write_bytes(b"12345")
    (tmp_path / "8.pdf").write_bytes(b"1")
    (tmp_path / "9.pdf").write_bytes(b"")
    texts = spark.createDataFrame([("7", "seven")], "record_id string, text string")
    got = R.attach_text(R.attachments(spark, str(tmp_path), "*.pdf"), texts).select("file_name", "n_bytes", "text")
    assert rows(got) == [("7.pdf", 5, "seven"), ("8.pdf", 1, None)]


def test_json_keeps_missing_fields(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    plain, compat = scratch_path(spark, "json"), scratch_path(spark, "json")
    K.write_json(df, plain)
    K.write_json(df, compat, compat=True)
    assert sorted(r.value for r in spark.read.text(plain).collect()) == ['{"i":1,"s":null}', '{"i":2,"s":"x"}']
    assert sorted(r.value for r in spark.read.text(compat).collect()) == ['{"i":1,"s":""}', '{"i":2,"s":"x"}']


def test_missing_work_table_is_empty(spark):
    got = R.read_work_table(spark, scratch_path(spark, "none"), STATE_SCHEMA)
    assert got.count() == 0 and "domain" in got.columns
    assert R.latest_version(spark, scratch_path(spark, "none")) is None


@pytest.fixture()
def landed(spark):
    """Requests in four files; the same item comes again in later files."""
    path = scratch_path(spark, "landed")
    for part in range(4):
        spark.range(50).select(
            F.concat(F.lit("d"), ((F.col("id") * 7 + part * 20) % 90).cast("string")).alias("domain"),
            (F.col("id") + part).cast("decimal(12,2)").alias("price"),
            (F.col("id") * 100.0).alias("wait_s"),
            (F.lit(part * 1000) + F.col("id")).alias("seq"),
        ).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_upsert_equals_batches(spark, landed):
    schema = spark.read.parquet(landed).schema
    root, checkpoint = scratch_path(spark, "state"), scratch_path(spark, "ck")

    def run(checkpoint=checkpoint):
        return T.stream_upsert(T.read_landed(spark, landed, schema, files_per_batch=1), root, checkpoint, now(), order=["seq"])

    assert run() == 3
    once = upsert_items(spark.createDataFrame([], STATE_SCHEMA), spark.read.parquet(landed), now(), order=["seq"])
    got = rows(V.read_state(spark, root, STATE_SCHEMA))
    assert [r[0] for r in got] == [r[0] for r in rows(once)]
    # Nothing new has landed: the next run changes nothing.
    assert run() == 3
    # More lands: only that is folded in.
    more = spark.createDataFrame([("d0", 1, 5.0, 9), ("fresh", 2, 6.0, 9)], "domain string, price int, wait_s double, seq long")
    more = more.select("domain", F.col("price").cast("decimal(12,2)").alias("price"), "wait_s", "seq")
    more.coalesce(1).write.mode("append").parquet(landed)
    assert run() == 4
    latest = {r.domain: r for r in V.read_state(spark, root, STATE_SCHEMA).collect()}
    assert len(latest) == len(got) + 1 and latest["d0"].price == 1
    # A lost checkpoint goes on from the newest state: all versions stay, and so do all items.
    assert run(scratch_path(spark, "ck")) == 9
    again = V.read_state(spark, root, STATE_SCHEMA)
    assert {r.domain for r in again.collect()} == set(latest)
    assert {r.domain: tuple(r) for r in V.read_state(spark, root, STATE_SCHEMA, 4).collect()} == {k: tuple(r) for k, r in latest.items()}


def test_stream_without_input(spark, landed):
    schema = spark.read.parquet(landed).schema
    empty = T.read_landed(spark, landed, schema, glob="*.nothing")
    assert T.stream_upsert(empty, scratch_path(spark, "state"), scratch_path(spark, "ck"), now(), ["seq"]) is None


def put(state, incoming):
    return state.join(incoming, "k", "left_anti").unionByName(incoming)


def test_a_fold_rewrites_touched_buckets_only(spark):
    root, schema = scratch_path(spark, "state"), "k bigint, v string"
    whole = spark.range(20_000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    assert V.create_state(whole, root, "k", buckets=128) == 0
    one_in_a_hundred = whole.where("k % 10000 < 3").withColumn("v", F.lit("new"))
    assert V.fold(one_in_a_hundred, root, "k", schema, put) == 1
    before, after = V.read_manifest(spark, root, 0), V.read_manifest(spark, root, 1)
    changed = {b for b in after.folders if after.folders[b] != before.folders[b]}
    assert len(before.folders) == len(after.folders) == 128 and 0 < len(changed) <= 6
    assert rows(V.read_state(spark, root, schema)) == rows(put(whole, one_in_a_hundred))
    assert rows(V.read_state(spark, root, schema, 0)) == rows(whole)
    # Only what the kept version names is left, and it is whole.
    assert V.expire(spark, root, keep=1) == [1]
    assert rows(V.read_state(spark, root, schema)) == rows(put(whole, one_in_a_hundred))
    assert len(V._files(spark, f"{root}/data/*/__bucket=*")) == 128


def test_folds_that_run_again_or_at_once(spark):
    root, schema = scratch_path(spark, "state"), "k bigint, v string"

    def some(v, *keys):
        return spark.createDataFrame([(k, v) for k in keys], schema)

    assert V.fold(some("a", 1, 2), root, "k", schema, put, buckets=4, writer="s", batch=0) == 0
    assert V.fold(some("b", 2), root, "k", schema, put, writer="s", batch=1) == 1
    # The batch before runs again: nothing changes.  So it is when nothing comes in.
    assert V.fold(some("b", 2), root, "k", schema, put, writer="s", batch=1) == 1
    assert V.fold(some("c"), root, "k", schema, put, writer="s", batch=2) == 1
    assert rows(V.read_state(spark, root, schema)) == [(1, "a"), (2, "b")]

    def slow(state, incoming):
        V.fold(some("other", 7), root, "k", schema, put)
        return put(state, incoming)

    with pytest.raises(ValueError, match="another run"):
        V.fold(some("late", 8), root, "k", schema, slow)
    assert rows(V.read_state(spark, root, schema)) == [(1, "a"), (2, "b"), (7, "other")]
    # Null keys have a bucket as well; a combination may leave rows out.
    V.fold(some("none", None), root, "k", schema, put)
    V.fold(some("x", 1), root, "k", schema, lambda state, incoming: state.join(incoming, "k", "left_anti"))
    assert rows(V.read_state(spark, root, schema)) == [(2, "b"), (7, "other"), (None, "none")]


def test_frontier_over_several_runs(spark):
    pages, seen, out, ck = (scratch_path(spark, n) for n in ("pages", "seen", "out", "ck"))

    def land(*links):
        spark.createDataFrame([(x,) for x in links], "link string").coalesce(1).write.mode("append").parquet(pages)

    def run(ck=ck):
        source = T.read_landed(spark, pages, "link string", files_per_batch=1)
        T.stream_frontier(source, lambda batch: batch, seen, out, ck, "link", "link string", buckets=4)
        return sorted(r.link for r in spark.read.parquet(f"{out}/*").collect())

    land("a", "b", "a", None)
    land("b", "c")
    assert run() == ["a", "b", "c"]
    land("c", "d", "a")
    assert run() == ["a", "b", "c", "d"]
    # All pages are read again, and nothing is new.
    assert run(scratch_path(spark, "ck")) == ["a", "b", "c", "d"]


def test_stream_dedup_equals_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    path = scratch_path(spark, "events")
    events.repartition(5, "event_id").write.parquet(path)
    source = T.read_landed(spark, path, events.schema, files_per_batch=1).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "out")
    T.stream_rows(T.stream_dedup(source, ["user_id", "event_type"], "ts", "60 days"), lambda df: df.select("user_id", "event_type"), out, scratch_path(spark, "ck"))
    assert rows(spark.read.parquet(out)) == rows(events.select("user_id", "event_type").distinct())


def test_stream_records_resumes(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path, out, ck = (scratch_path(spark, n) for n in ("pages", "out", "ck"))
    from pagemill.operators.extract import extract_links

    def run():
        T.stream_records(T.read_landed(spark, path, pages.schema), extract_links, out, ck)

    pages.where("page_id < 20").write.mode("append").parquet(path)
    run()
    pages.where("page_id >= 20").write.mode("append").parquet(path)
    run()
    assert rows(T.read_stream_records(spark, out)) == rows(extract_links(pages))


def test_stream_outcomes_counts_each_batch(spark):
    """One row of counts a batch, also for a batch without records."""
    from pagemill.operators.records import route_outcome

    path, out, metrics, ck = (scratch_path(spark, n) for n in ("landed", "out", "metrics", "ck"))
    table = spark.range(10).select("id", (F.col("id") % 3).alias("r"))

    def to_routed(batch):
        return route_outcome(batch.where("id < 8"), F.col("r") == 0, {"one": F.col("r") == 1})

    def run(checkpoint):
        T.stream_outcomes(T.read_landed(spark, path, table.schema), to_routed, out, metrics, checkpoint)
        return [tuple(r) for r in T.read_outcome_metrics(spark, metrics).select("batch", "records", "success", "failures").orderBy("batch").collect()]

    table.where("id < 5").write.parquet(path)
    assert run(ck) == [(0, 5, 2, 3)]
    assert run(ck) == [(0, 5, 2, 3)]
    table.where("id in (5, 6, 7)").write.mode("append").parquet(path)
    assert run(ck) == [(0, 5, 2, 3), (1, 3, 1, 2)]
    table.where("id >= 8").write.mode("append").parquet(path)
    assert run(ck)[2] == (2, 0, 0, 0)
    assert T.read_stream_records(spark, out).count() == 8


def test_filters_and_columns_reach_the_scan(spark, sf):
    from pagemill.plans.catalogue import QUERIES

    def plan(name):
        return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    assert "EqualTo(o_orderstatus,O)" in plan("open_work_items")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("lexicon_sentiment")
    for name in ("take_while_section", "label_value_pivot", "news_documents", "lexicon_sentiment"):
        # Row-local: no shuffle but the one that deals out a single small file.
        assert plan(name).replace("RoundRobinPartitioning", "").count("hashpartitioning") == 0, name


def test_no_query_has_a_cross_join(spark, sf):
    from pagemill.plans.catalogue import QUERIES

    for name, build in QUERIES.items():
        if name.startswith("stream_"):
            continue
        plan = build(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        if name not in ("stop_at_first_gap", "fellow_summaries"):  # one-row side by construction
            assert "BroadcastNestedLoopJoin" not in plan, name


def test_long_islands_do_not_collect(spark):
    """Last values of an island are aggregates that combine before the shuffle."""
    df = spark.range(100).select(F.lit("k").alias("k"), "id", (F.col("id") % 7).alias("v"))
    plan = S.last_in_segment(df, ["k"], ["id"], {"v": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "collect" not in plan


def test_outcomes_are_counted_on_the_way(spark):
    from pyspark.sql import Observation

    from pagemill.operators.records import observe_outcomes

    seen = Observation("routed")
    df = spark.createDataFrame([("success",), ("failures",), ("success",)], "outcome string")
    path = scratch_path(spark, "observed")
    K.write_routed(observe_outcomes(df.withColumn("i", F.lit(1)), seen), path)
    assert seen.get == {"records": 3, "success": 2, "failures": 1}
    assert rows(spark.read.json(path).groupBy("outcome").count()) == [("failures", 1), ("success", 2)]


@pytest.mark.parametrize("name", ["stream_pages", "stream_dedup_links", "stream_upsert", "stream_records"])
def test_streams_of_tables_in_several_files(spark, sf, name):
    from pagemill.plans.catalogue import QUERIES

    root = scratch_path(spark, "tables")
    for table in ("pages", "events", "orders", "customer", "part"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(f"{root}/{table}.parquet")
    found = rows(QUERIES[name](spark, root))
    assert found and found == rows(QUERIES[name](spark, sf))

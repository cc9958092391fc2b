"""Validation rules, routing, and the two streams."""

import json
import re

import pytest
from pyspark.sql import functions as F

from accountlens.registry import queries
from accountlens.sources import staging, store, tables, versions
from accountlens.streaming import ingest

CASES = [
    (None, ingest.NO_DATA), ("", ingest.NO_DATA), ('{"type":"call",', ingest.NO_DATA), ("{}", ingest.NO_DATA), ("null", ingest.NO_DATA),
    ("[]", ingest.NO_DATA), ("not json", ingest.NO_DATA), ('[{"type":"call"}]', ingest.NO_TYPE),
    ('{"company":"a"}', ingest.NO_TYPE),
    ('{"type":"purchased","purchased":1}', ingest.NO_COMPANY),
    ('{"type":"provisioned"}', ingest.NO_COMPANY),
    ('{"type":"purchased","company":"a"}', ingest.NO_PURCHASED),
    ('{"type":"provisioned","company":"a","purchased":1}', ingest.NO_PROVISIONED),
    ('{"type":"purchased","company":null,"purchased":null}', None),
    ('{"type":"load"}', None), ('{"type":null}', None), ('{"type":"brand_new","user":"u"}', None),
]


def bodies(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "body string")


def test_first_broken_rule(spark):
    out = ingest.validate_events(bodies(spark, [c for c, _ in CASES])).collect()
    assert [(r["body"], r["error"]) for r in out] == CASES


@pytest.mark.parametrize(
    "body,target,error",
    [
        ('{"type":"purchased","company":"a","purchased":2}', "company_events", None),
        ('{"type":"provisioned","company":"a","provisioned":null}', "company_events", None),
        ('{"type":null}', "user_events", None),
        ('{"type":"brand_new"}', "user_events", None),
        ('{"type":"call","timestamp":"2024-01-01T00:00:00Z","rating":"4"}', "user_events", None),
        ('{"type":"call","rating":"lots"}', "rejects", "Error adding event: invalid value for rating"),
        ('{"type":"call","timestamp":"soon"}', "rejects", "Error adding event: invalid value for timestamp"),
        ('{"type":"call","purchased":1}', "rejects", "Error adding event: no such field: purchased"),
        ('{"type":"purchased"}', "rejects", ingest.NO_COMPANY),
    ],
)
def test_routing(spark, body, target, error):
    row = ingest.route_events(bodies(spark, [body])).first()
    assert (row["target"], row["error"]) == (target, error)


def test_body_is_parsed_once_however_often_its_fields_are_used(spark):
    routed = ingest.route_events(bodies(spark, ["{}"]))
    plan = ingest.typed_events(routed, "user_events")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_tuple") == 1
    assert len(re.findall("(?i)json_?object_?keys", plan)) == 1


def write_bodies(spark, sf_dir, path, files):
    staged = staging.event_bodies(staging.stg_events(spark, sf_dir))
    staged.repartition(files, "event_id").write.parquet(path)
    return spark.readStream.schema(staged.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_stream_equals_batch(spark, sf_dir, tmp_path):
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    store.create_event_tables(spark, root)
    stream = write_bodies(spark, sf_dir, str(tmp_path / "in"), 3)
    query = ingest.start_ingest(stream, root, checkpoint)
    query.awaitTermination()
    routed = ingest.route_events(staging.event_bodies(staging.stg_events(spark, sf_dir)))
    for table, read in (("user_events", tables.user_events), ("company_events", tables.company_events)):
        stored = read(spark, f"{root}/{table}").drop("event_date")
        want = ingest.typed_events(routed, table)
        assert stored.exceptAll(want).count() == want.exceptAll(stored).count() == 0 < want.count()
    rejected = tables.rejected_events(spark, f"{root}/rejects")
    want = ingest.rejects(routed)
    assert rejected.exceptAll(want).count() == want.exceptAll(rejected).count() == 0 < want.count()


def replay_last_batch(checkpoint):
    """Forget that the last micro-batch was committed, as after a crash."""
    commits = [p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()]
    last = max(commits, key=lambda p: int(p.name))
    for path in (last, last.with_name(f".{last.name}.crc")):
        path.unlink(missing_ok=True)


def test_replayed_batches_change_nothing(spark, sf_dir, tmp_path):
    root, path = str(tmp_path / "store"), str(tmp_path / "totals")
    store.create_event_tables(spark, root)
    source = str(tmp_path / "in")
    stream = write_bodies(spark, sf_dir, source, 3)

    def run():
        ingested = ingest.start_ingest(stream, root, str(tmp_path / "c1"))
        ingested.awaitTermination()
        summed = ingest.start_company_totals(stream, path)
        summed.awaitTermination()
        counts = [
            tables.user_events(spark, f"{root}/user_events").count(),
            tables.company_events(spark, f"{root}/company_events").count(),
            tables.rejected_events(spark, f"{root}/rejects").count(),
        ]
        return counts, sorted(map(tuple, ingest.running_sums(spark, path).collect())), len(ingested.recentProgress)

    first = run()
    for checkpoint in ("c1", "totals/checkpoint"):
        replay_last_batch(tmp_path / checkpoint)
    again = run()
    assert again[2] >= 1
    assert again[:2] == first[:2]
    assert sum(first[0]) == spark.read.parquet(source).count()


def test_a_new_checkpoint_adds_to_what_an_older_stream_stored(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"type":"load"}\n{}\n')
    root = str(tmp_path / "store")
    store.create_event_tables(spark, root)
    for checkpoint in ("c1", "c2"):
        stream = tables.event_body_stream(spark, str(tmp_path / "in"))
        ingest.start_ingest(stream, root, str(tmp_path / checkpoint)).awaitTermination()
    assert tables.user_events(spark, f"{root}/user_events").count() == 2
    assert tables.rejected_events(spark, f"{root}/rejects").count() == 2


def test_totals_stream_equals_batch_over_several_batches(spark, sf_dir, tmp_path):
    sums = {}
    for row in staging.event_bodies(staging.stg_events(spark, sf_dir)).collect():
        event = json.loads(row["body"])
        if event.get("type") in ("purchased", "provisioned") and "company" in event and event["type"] in event:
            side = sums.setdefault(event["company"], {"purchased": 0, "provisioned": 0})
            side[event["type"]] += event[event["type"]] or 0
    unknown, without_total, *_ = sorted(sums)

    name = F.col("company")
    companies = staging.companies(spark, sf_dir).where(name != unknown).select(
        name.alias("id"),
        name.alias("name"),
        F.when(name != without_total, F.lit(1000)).cast("long").alias("boxes_bought"),
        F.lit(None).cast("long").alias("boxes_prov"),
    )
    stream = write_bodies(spark, sf_dir, str(tmp_path / "in"), 4)
    path = str(tmp_path / "totals")
    query = ingest.start_company_totals(stream, path)
    query.awaitTermination()
    assert len(query.recentProgress) >= 4

    want = {
        n: ((0 if n == without_total else 1000) + s["purchased"], s["provisioned"])
        for n, s in sums.items()
        if n != unknown
    }
    got = {r["company"]: (r["boxes_bought"], r["boxes_prov"]) for r in ingest.current_totals(spark, path, companies).collect()}
    assert got == want
    skipped = ingest.add_sums(companies, ingest.running_sums(spark, path))[1].collect()
    assert [r["company"] for r in skipped] == [unknown]
    documents = {r["name"]: (r["boxes_bought"], r["boxes_prov"]) for r in ingest.companies_now(spark, path, companies).collect()}
    assert {n: documents[n] for n in want} == want
    assert len(documents) == companies.count()


def test_bodies_from_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"type":"load"}', "", '{"type":"purchased","company":"a","purchased":3}', "oops"]
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    (tmp_path / "in" / "b.txt").write_text('{"type":"purchased","company":"a","purchased":4}\n')
    folder, root = str(tmp_path / "in"), str(tmp_path / "store")
    assert tables.event_bodies(spark, folder).count() == 5
    store.create_event_tables(spark, root)
    stream = tables.event_body_stream(spark, folder, files_per_batch=1)
    ingest.start_ingest(stream, root, str(tmp_path / "c1")).awaitTermination()
    assert tables.user_events(spark, f"{root}/user_events").count() == 1
    assert tables.company_events(spark, f"{root}/company_events").agg(F.sum("purchased")).first()[0] == 7
    assert tables.rejected_events(spark, f"{root}/rejects").count() == 2
    path = str(tmp_path / "totals")
    ingest.start_company_totals(stream, path).awaitTermination()
    assert [tuple(r) for r in ingest.running_sums(spark, path).collect()] == [("a", 7, 0)]


def purchase(company, n):
    return json.dumps({"type": "purchased", "company": company, "purchased": n})


def test_totals_of_known_companies_and_readers_of_older_sums(spark, tmp_path, caplog):
    (tmp_path / "in").mkdir()
    folder, source = str(tmp_path / "totals"), str(tmp_path / "in")
    names = ["a"]

    def run(name, lines):
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        companies = lambda: spark.createDataFrame([(n,) for n in names], "name string")
        ingest.start_company_totals(tables.event_body_stream(spark, source, 1), folder, companies).awaitTermination()
        return {r["company"]: r["purchased"] for r in ingest.running_sums(spark, folder).collect()}

    with caplog.at_level("WARNING"):
        assert run("1.txt", [purchase("a", 3), purchase("b", 4), purchase("a", 1)]) == {"a": 4}
    assert "companies without a document: b" in caplog.text
    open_reader = ingest.running_sums(spark, folder)
    names.append("b")
    caplog.clear()
    assert run("2.txt", [purchase("b", 10), purchase("a", 10)]) == {"a": 14, "b": 10}
    assert "without a document" not in caplog.text
    # Who has begun to read sees the sums as they were; a replayed batch adds nothing.
    assert [tuple(r) for r in open_reader.collect()] == [("a", 4, 0)]
    replay_last_batch(tmp_path / "totals" / "checkpoint")
    assert run("3.txt", [purchase("a", 100)]) == {"a": 114, "b": 10}
    manifest = versions.current(spark, folder)
    assert len(manifest.parts("sums")) == 1 and len(manifest.folded["sums"]) == 1


def test_compaction_between_micro_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root = str(tmp_path / "store")
    for i in range(5):
        stamp = f"2024-01-0{i + 1}T10:00:00.25+02:00"
        (tmp_path / "in" / f"{i}.txt").write_text(json.dumps({"type": "call", "user": f"u{i}", "timestamp": stamp, "call_duration": i}) + "\n" + purchase("a", i) + "\nbad\n")
    store.create_event_tables(spark, root)
    stream = tables.event_body_stream(spark, str(tmp_path / "in"), 1)
    ingest.start_ingest(stream, root, str(tmp_path / "c"), compact_every=2).awaitTermination()
    manifest = versions.current(spark, root)
    assert [len(manifest.parts(t)) for t in ("user_events", "company_events", "rejects")] == [2, 2, 5]
    (spans,) = manifest.folded["user_events"].values()
    assert spans == [[0, 3]]
    before = manifest.version
    replay_last_batch(tmp_path / "c")
    ingest.start_ingest(stream, root, str(tmp_path / "c"), compact_every=2).awaitTermination()
    rows = tables.user_events(spark, f"{root}/user_events").orderBy("user").collect()
    assert [(r["user"], str(r["timestamp"]), r["call_duration"]) for r in rows] == [(f"u{i}", f"2024-01-0{i + 1} 08:00:00.250000", i) for i in range(5)]
    assert tables.company_events(spark, f"{root}/company_events").agg(F.sum("purchased")).first()[0] == 10
    assert tables.rejected_events(spark, f"{root}/rejects").count() == 5 and versions.current(spark, root).version > before


class _Seen(Exception):
    pass


def test_whole_bodies_are_written_by_all_tasks(spark, sf_dir, monkeypatch):
    """Files follow the rows, and some of them are a micro-batch."""
    asked = []

    def seen(spark, path, files_per_batch):
        asked.append((len(spark.read.text(path).inputFiles()), spark.read.text(path).count(), files_per_batch))
        raise _Seen

    monkeypatch.setattr(queries, "BODIES_PER_FILE", 500, raising=False)
    monkeypatch.setattr(queries.tables, "event_body_stream", seen)
    with pytest.raises(_Seen):
        queries.QUERIES["ingest_whole_bodies"](spark, sf_dir)
    files, rows, batch = asked[0]
    assert rows == queries.staging.whole_bodies(spark, sf_dir).count()
    assert files >= rows / 500 and 1 < batch and -(-files // batch) in (3, 4)

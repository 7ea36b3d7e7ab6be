from __future__ import annotations

import csv
import os
from datetime import datetime

import pytest

from parcelmart.operators import quality, runlog
from parcelmart.plans.pipeline import load_and_refresh
from parcelmart.operators.keys import DuplicateKeyError
from parcelmart.plans.warehouse import layer_row_counts, read_marts, read_raw, refresh_marts, staging_from_raw
from parcelmart.schemas import RAW_COLUMNS
from parcelmart.sources import sinks
from parcelmart.sources import testdata as td
from parcelmart.sources.knowledge_files import read_gold_jsonl, read_markdown
from parcelmart.sources.raw_csv import load_raw
from parcelmart.streaming.event_tail import delivered, tail_events

NOW = datetime(2024, 1, 1)


def log(spark, *rows):
    return spark.createDataFrame([(*r, NOW) for r in rows], runlog.EVENT_SCHEMA)


EVENTS = (
    (1, 7, "run.queued", "{}"), (2, 7, "run.started", "{}"), (3, 8, "run.started", "{}"),
    (4, 7, "assistant.delta", '{"content": "Hello "}'), (5, 7, "assistant.delta", "{}"),
    (1500, 7, "assistant.delta", '{"content": "world"}'), (1501, 7, "run.completed", "{}"), (1502, 7, "node.started", "{}"),
)


def test_pages_status_and_answer(spark):
    events = log(spark, *EVENTS)
    assert [r.sequence for r in runlog.events_after(events, 7, 2, 3).collect()] == [4, 5, 1500]
    cursors = spark.createDataFrame([(7, 4), (8, 0), (9, 0)], "run_id bigint, cursor bigint")
    assert sorted(r.sequence for r in runlog.pages_after(events, cursors, 2).collect()) == [3, 5, 1500]
    assert {r.run_id: r.status for r in runlog.run_status(events).collect()} == {7: "completed", 8: "running"}
    assert [tuple(r) for r in runlog.assemble_answer(events).collect()] == [(7, "Hello world")]


def test_stream_delivers_once_and_stops_at_the_end_of_a_run(spark, tmp_path):
    source, target = str(tmp_path / "log"), str(tmp_path / "out")
    log(spark, *EVENTS[:6]).write.mode("append").parquet(source)
    tail_events(spark, source, target, cursor=1).awaitTermination()
    assert sorted(r.sequence for r in delivered(spark, target).collect()) == [2, 3, 4, 5, 1500]
    tail_events(spark, source, target, cursor=1).awaitTermination()
    assert delivered(spark, target).count() == 5
    log(spark, *EVENTS[6:]).write.mode("append").parquet(source)
    tail_events(spark, source, target, cursor=1).awaitTermination()
    assert delivered(spark, target).filter("run_id = 7").count() == 5
    log(spark, (1600, 7, "run.started", "{}"), (1601, 8, "run.failed", "{}")).write.mode("append").parquet(source)
    tail_events(spark, source, target, cursor=1).awaitTermination()
    found = sorted(r.sequence for r in delivered(spark, target).collect())
    assert found == [2, 3, 4, 5, 1500, 1501, 1601]


def test_stream_of_one_run_in_small_batches(spark, tmp_path):
    source, target = str(tmp_path / "log"), str(tmp_path / "out")
    for row in EVENTS:
        log(spark, row).coalesce(1).write.mode("append").parquet(source)
    tail_events(spark, source, target, run_id=8, files_per_batch=1).awaitTermination()
    assert [r.sequence for r in delivered(spark, target).collect()] == [3]


RAW = {
    "customers": [("c1", "u1", "01310", "sao paulo", "SP"), ("c2", "u2", "", "rio", "RJ")],
    "geolocation": [("01310", "-23.5", "-46.6", "sao paulo", "SP")],
    "orders": [
        ("o1", "c1", "delivered", "2018-07-01 10:00:00", "2018-07-01 11:00:00", "2018-07-02 00:00:00", "2018-07-12 10:00:00", "2018-07-10 00:00:00"),
        ("o2", "c9", "canceled", "2018-08-01 10:00:00", "", "", "", ""),
    ],
    "order_items": [("o1", "1", "p1", "s1", "2018-07-05 00:00:00", "10.50", "2.00"), ("o1", "2", "p2", "s2", "2018-07-05 00:00:00", "1", "1")],
    "order_payments": [("o1", "1", "", "2", "14.50")],
    "order_reviews": [("r1", "o1", "2", "bad, late", 'line one\nline "two"', "2018-07-13 00:00:00", "2018-07-14 00:00:00"), ("r2", "o1", "3", "", "", "2018-07-15 00:00:00", "")],
    "products": [("p1", "brinquedos", "1", "1", "1", "100", "1", "1", "1"), ("p2", "", "", "", "", "", "", "", "")],
    "sellers": [("s1", "1", "x", "SP"), ("s2", "2", "y", "RJ")],
    "category_translation": [("brinquedos", "toys")],
}
FILES = {
    "category_translation": "product_category_name_translation.csv",
    **{t: f"shop_{t}_dataset.csv" for t in RAW if t != "category_translation"},
}


def write_raw(folder, skip=()):
    for table, rows in RAW.items():
        if table not in skip:
            with open(os.path.join(folder, FILES[table]), "w", newline="", encoding="utf-8") as out:
                writer = csv.writer(out, quoting=csv.QUOTE_ALL if table == "order_reviews" else csv.QUOTE_MINIMAL)
                writer.writerow(RAW_COLUMNS[table])
                writer.writerows(rows)


def test_csv_to_marts(spark, tmp_path):
    source, out = tmp_path / "csv", str(tmp_path / "lake")
    source.mkdir()
    write_raw(source)
    counts, marts = load_and_refresh(spark, str(source), out)
    assert counts == {t: len(rows) for t, rows in RAW.items()}
    row = marts.orders.filter("order_id = 'o1'").first()
    assert row.review_messages == 'line one\nline "two"' and float(row.review_score) == 2.5 and row.is_late
    assert sorted(r.category for r in marts.category_orders.collect()) == ["toys", "unknown"]
    assert marts.payments.first().payment_type == "unknown"
    raw = read_raw(spark, out)
    report = {r.check_name: r.value for r in quality.dq_report(raw, staging_from_raw(raw).orders).collect()}
    assert len(report) == 24
    assert report["orphan_customer_orders"] == 1 and report["multi_seller_orders"] == 1
    assert report["product_category_missing"] == 1 and report["payment_vs_items_abs_diff_over_1"] == 0
    layers = layer_row_counts(raw, marts, staging_from_raw(raw).orders).collect()
    assert len(layers) == 17
    load_and_refresh(spark, str(source), out)
    assert read_marts(spark, out).orders.count() == 2


def test_missing_file_fails_before_anything_is_replaced(spark, tmp_path):
    write_raw(tmp_path, skip=("sellers",))
    with pytest.raises(FileNotFoundError, match="sellers"):
        load_raw(spark, str(tmp_path), str(tmp_path / "lake"))
    assert not (tmp_path / "lake").exists()


def test_quality_on_empty_and_duplicate_tables(spark):
    from parcelmart.schemas import raw_schema

    raw = {t: spark.createDataFrame([], raw_schema(t)) for t in RAW_COLUMNS}
    assert {r.value for r in quality.dq_key_integrity(raw).collect()} == {0}
    raw["orders"] = spark.createDataFrame([("o", "c", *[None] * 6)] * 3, raw_schema("orders"))
    found = {r.check_name: r.value for r in quality.dq_key_integrity(raw).collect()}
    assert found["duplicate_order_ids"] == 2 and found["orphan_customer_orders"] == 3


def test_markdown_gold_and_sinks(spark, tmp_path):
    (tmp_path / "b.md").write_text("# Zwei\nx", encoding="utf-8")
    (tmp_path / "a.md").write_text("eins", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no", encoding="utf-8")
    assert [(r.filename, r.stem, r.text) for r in read_markdown(spark, str(tmp_path)).orderBy("filename").collect()] == [
        ("a.md", "a", "eins"), ("b.md", "b", "# Zwei\nx")
    ]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        read_markdown(spark, str(tmp_path / "none"))
    (tmp_path / "gold.jsonl").write_text('{"id":"g1","query":"q","gold_titles":["a","b"]}\n', encoding="utf-8")
    assert tuple(read_gold_jsonl(spark, str(tmp_path / "gold.jsonl")).first()) == ("g1", "q", ["a", "b"])
    events = log(spark, *EVENTS)
    for _ in range(2):
        sinks.write_event_log(events, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 2 * len(EVENTS)
    for fmt in ("json", "parquet"):
        sinks.write_metric_report(events, str(tmp_path / fmt), fmt)
        assert getattr(spark.read, fmt)(str(tmp_path / fmt)).count() == len(EVENTS)
    with pytest.raises(ValueError):
        sinks.write_metric_report(events, str(tmp_path / "x"), "html")


def test_only_the_exact_files_of_one_folder_are_loaded(spark, tmp_path):
    source = tmp_path / "csv"
    source.mkdir()
    write_raw(source)
    (source / "orders_by_customers.csv").write_text("x\n1\n", encoding="utf-8")
    (source / "old").mkdir()
    write_raw(source / "old")
    counts = load_raw(spark, str(source), str(tmp_path / "lake"))
    assert counts == {t: len(rows) for t, rows in RAW.items()}
    (source / "sellers.csv").write_text(",".join(RAW_COLUMNS["sellers"]) + "\n", encoding="utf-8")
    with pytest.raises(ValueError, match="sellers"):
        load_raw(spark, str(source), str(tmp_path / "lake"))


def test_swapped_columns_are_an_error(spark, tmp_path):
    write_raw(tmp_path)
    names = RAW_COLUMNS["sellers"]
    (tmp_path / FILES["sellers"]).write_text(",".join([names[1], names[0], *names[2:]]) + "\n1,s1,x,SP\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        load_raw(spark, str(tmp_path), str(tmp_path / "lake"))


def test_a_failed_refresh_leaves_the_marts_and_empty_tables_work(spark, tmp_path):
    source, out = tmp_path / "csv", str(tmp_path / "lake")
    source.mkdir()
    write_raw(source)
    _, marts = load_and_refresh(spark, str(source), out)
    raw = read_raw(spark, out)
    twice = {**raw, "orders": raw["orders"].unionByName(raw["orders"])}
    with pytest.raises(DuplicateKeyError):
        refresh_marts(spark, staging_from_raw(twice), out)
    assert read_marts(spark, out).orders.count() == 2 and read_marts(spark, out).seller_orders.count() == 2
    empty = {**raw, "order_payments": raw["order_payments"].limit(0), "order_reviews": raw["order_reviews"].limit(0)}
    refresh_marts(spark, staging_from_raw(empty), out)
    again = read_marts(spark, out)
    assert again.payments.count() == 0 and again.reviews.count() == 0 and again.orders.count() == 2


def test_trace_and_status_of_a_cancelled_run(spark):
    events = log(spark, (1, 7, "run.started", "{}"), (2, 7, "run.cancelled", '{"why": "x"}'))
    status = runlog.run_status(events)
    assert status.first().status == "cancelled"
    steps = spark.createDataFrame([(7, 1, "plan", 5)], "run_id bigint, step_id bigint, node_name string, ms int")
    calls = spark.createDataFrame([(7, 1, NOW, "t", "a")], "run_id bigint, call_id bigint, started_at timestamp_ntz, tool_name string, arguments string")
    rows = runlog.run_trace(status, steps, calls, events, 7).collect()
    assert [r.section for r in rows] == [1, 2, 3, 4, 4]
    assert '"ms":5' in rows[1].detail and '"arguments":"a"' in rows[2].detail and "why" in rows[4].detail


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from parcelmart.session import shared_folder

    conf = SimpleNamespace(get=lambda name, default=None: default)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")), "x")


def test_exported_tables_are_compressed(spark, folder):
    """The CSV copy of the RAW tables was most of what a load wrote."""
    import glob

    from parcelmart.registry import sources
    from parcelmart.schemas import RAW_COLUMNS

    root = sources.csv_folder(spark, folder)
    for table in RAW_COLUMNS:
        files = glob.glob(f"{root}/{table}/part-*")
        assert files and all(f.endswith(".csv.gz") for f in files)


def test_gold_of_passages_of_any_length(spark, tmp_path):
    """Three words or more meet by an inner word, one or two by a part of a word, none by every document; NULL has no gold."""
    passages = ["one two three", "wo three", "hre", "e f", "x", "", " ", "\n", "three  four", None, "absent", "zwölf", " five"]
    texts = ["one two three", "two three four five", "zwölfte\nthree  four", "", "x"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    known = spark.createDataFrame([(f"d{i}", f"t{i}", text) for i, text in enumerate(texts)] + [("d9", "t9", None)],
                                  "document_id string, title string, plain string")
    gold = {r.query_id: sorted(r.gold_titles) for r in td.x_gold(spark, str(tmp_path), known).collect()}
    expected = {i: [f"t{j}" for j, text in enumerate(texts) if p in text] for i, p in enumerate(passages) if p is not None}
    assert gold == {i: titles for i, titles in expected.items() if titles} and len(gold) == 11

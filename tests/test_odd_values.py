"""Queries against their SQL on tables of values that the given ones lack."""

import duckdb
import pytest
from oracle import assert_same

from chronolith.plans import catalog
from chronolith.sources import sinks

catalog.load()


@pytest.fixture
def same(spark, tmp_path):
    """Compares a query with its SQL on a table of its own."""

    def run(query, name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        c = duckdb.connect()
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        return assert_same(catalog.QUERIES[query](spark, str(tmp_path)), c, catalog.ORACLES[query])

    return run


def test_first_letters_and_last_signs_of_phrases(same):
    wide = [chr(c) for c in range(0x80, 0x10000) if len(chr(c).upper()) > 1]
    ends = [f"ab{a}{b}" for a in (".", " ,", "!", " ", "") for b in ("\u0085", "\u2028", "\xa0", "\r", "\n", "")]
    long = [("x" * 70 + ", " + "y" * 90 + e * 2)[:170] for e in (" ,\u2028", ",\u0085 z", ". ")]
    texts = [f"{c}eit und mehr" for c in [*wide, "é", "ǆ", "ı", "i"]] + [*wide, *ends, *long, None, "", "...", "ß"]
    assert same("phrases", "documents", list(enumerate(texts)), "doc_id long, text string") == len(texts)


def test_rundown_after_a_day(same):
    at = [0, 86_399, 86_400, 90_000, 3_000_000]
    rows = [(10 * a + i, a, p) for i, a in enumerate(at) for p in ("1-URGENT", "5-LOW")]
    assert same("rundown_lines", "orders", rows, "o_orderkey long, o_custkey long, o_orderpriority string") == len(rows)


EVENTS = [(i, u, t) for i, u in enumerate([0, 12_342, 12_343, 17_279, 17_280, 90_000, -1, -20_000]) for t in ("view", "error", "click")]


def test_steps_after_a_day(same):
    assert same("step_lines", "events", EVENTS, "event_id long, user_id long, event_type string") == len(EVENTS)


def test_timeline_after_a_day(same):
    assert same("timeline_lines", "events", EVENTS, "event_id long, user_id long, event_type string") == 16


def test_hours_of_recordings_go_on(spark):
    steps = spark.createDataFrame([(1, 90_000.0, 360_000.5, 0.5, 0.25, False)], "index long, start double, end double, change double, activity double, dead boolean")
    assert sinks.step_lines(steps).first()["value"] == "| 1 | 25:00:00 | 100:00:00 | 0.5 | 0.2500 | útil |"

"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_stream_result_equals_batch_result(spark):
    """The applied stream holds the admissions of the batch query."""
    from millrace.operators import admit
    from millrace.plans.fixtures import Inputs
    from millrace.plans.queries import WORDS
    x = Inputs(spark, SF_DIR)
    applied = QUERIES["intent_apply"](spark, SF_DIR).select("company", "title").collect()
    batch = admit.append_admitted(x.board(), admit.admit(x.board(), x.incoming(), WORDS),
                                  "2024-01-31 12:00:00").select("company", "title").collect()
    assert sorted(map(tuple, applied)) == sorted(map(tuple, batch))


def test_entry(spark):
    assert entry.entry(spark).columns == ["outcome", "n"]


@pytest.mark.parametrize("folder", [True, False])
def test_messages_arrive_from_a_file_and_from_a_folder_of_files(spark, tmp_path, folder):
    pages = spark.createDataFrame([(n, f"http://a.example/{n % 3 and 'de' or 'en'}/{n}", "<p>x</p>") for n in range(12)],
                                  "page_id long, url string, html string").repartition(3)
    out = tmp_path / "pages.parquet"
    if folder:
        pages.write.parquet(str(out))
    else:
        pages.coalesce(1).write.parquet(str(tmp_path / "one"))
        next((tmp_path / "one").glob("part-*.parquet")).rename(out)
    left = {f"thread-{n:08d}" for n in (4, 10)}
    for name in ("ledger_stream", "ledger_entries"):
        assert {r["thread_id"] for r in QUERIES[name](spark, str(tmp_path)).select("thread_id").collect()} == left
    recent = QUERIES["ledger_recent"](spark, str(tmp_path))
    assert {r["thread_id"] for r in recent.collect()} == {f"thread-{n:08d}" for n in range(0, 12, 2)}


def test_intent_files_are_written_by_all_tasks(spark):
    from pathlib import Path

    from millrace.plans.fixtures import Inputs
    files = list(Path(Inputs(spark, "/root/testdata/sf0.01").outbox()).glob("name=*/part-*"))
    assert len(files) > 60 and len({f.parent for f in files}) == len(files)
    assert len({f.name[:10] for f in files}) >= 6


def test_token_lookup_joins_its_postings_once(spark, monkeypatch):
    from millrace.plans.fixtures import Inputs
    made, given = [], Inputs._sql

    def seen(self, text, **frames):
        made.append(given(self, text, **frames))
        return made[-1]

    monkeypatch.setattr(Inputs, "_sql", seen)
    QUERIES["token_lookup"](spark, SF_DIR)
    from_tables = [f for f in made if any("customer.parquet" in n for n in f.inputFiles())]
    assert len(from_tables) == 1

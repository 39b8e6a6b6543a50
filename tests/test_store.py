"""The store's runs: whole or not at all, named by content, from several writers."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from indicant.operators.store import TABLES, Store

SCHEMA = "kind string, source_value string, ioc_type string, value string, is_warning boolean, warning_list string, description string"
NOW = "2024-01-01 00:00:00"


def rows(spark, *values, source="s"):
    return spark.createDataFrame([("file", source, "domains", v, False, None, None) for v in values], SCHEMA)


def sizes(db):
    return {name: db._read(name).count() for name in TABLES} | {"joined": db.iocs_per_run().count()}


def test_a_run_that_fails_has_added_nothing_and_can_be_made_again(spark, tmp_path, monkeypatch):
    db = Store(spark, str(tmp_path / "db"))
    db.persist(rows(spark, "a"), NOW)
    before = sizes(db)
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            db.persist(rows(spark, "b", "c"), NOW)
    assert sizes(db) == before
    db.persist(rows(spark, "b", "c"), NOW)
    assert sizes(db) == {"sightings": 1, "runs": 2, "iocs": 3, "run_iocs": 3, "joined": 3}
    assert db.vacuum(0) == 1 and sizes(db)["joined"] == 3


def test_runs_of_one_source_and_moment_are_told_apart_by_content(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"))
    one, two = db.persist(rows(spark, "a", "b"), NOW), db.persist(rows(spark, "b", "c"), NOW)
    assert one != two and db.persist(rows(spark, "b", "a", "a"), NOW) == one
    assert sizes(db) == {"sightings": 1, "runs": 2, "iocs": 3, "run_iocs": 4, "joined": 4}


def test_writers_at_once_and_compaction(spark, tmp_path):
    path = str(tmp_path / "db")
    parts = [rows(spark, "a", "b"), rows(spark, "b", "c", source="t"), rows(spark, "a", "b")]
    with ThreadPoolExecutor(3) as pool:
        names = list(pool.map(lambda df: Store(spark, path).persist(df, NOW), parts))
    db = Store(spark, path)
    whole = {"sightings": 2, "runs": 2, "iocs": 3, "run_iocs": 4, "joined": 4}
    assert names[0] == names[2] and sizes(db) == whole
    reading = db.iocs_per_run()
    db.compact()
    assert len(db.batches()) == 1 and sizes(db) == whole and reading.count() == 4
    assert db.compact() is None
    db.persist(rows(spark, "d"), NOW)
    db.vacuum(0)
    assert sizes(db) == {"sightings": 2, "runs": 3, "iocs": 4, "run_iocs": 5, "joined": 5}
    db.persist(rows(spark, "a", "b"), NOW)
    assert sizes(db)["joined"] == 5


def test_an_empty_store_and_an_empty_run(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"))
    assert sizes(db) == dict.fromkeys([*TABLES, "joined"], 0) and db.vacuum(0) == 0
    db.persist(rows(spark), NOW)
    assert sizes(db) == dict.fromkeys([*TABLES, "joined"], 0) and len(db.batches()) == 1


def test_a_stored_run_is_the_same_batch_and_is_not_written_once_more(spark, tmp_path, monkeypatch):
    plain, stored = Store(spark, str(tmp_path / "plain")), Store(spark, str(tmp_path / "stored"))
    both = rows(spark, "a", "b").union(rows(spark, "b", "c", source="t"))
    both.write.parquet(str(tmp_path / "rows"))
    staged = []
    monkeypatch.setattr(Store, "_delete", lambda self, name, delete=Store._delete: (staged.extend(p.name for p in (tmp_path / "stored" / name).iterdir()), delete(self, name)))
    names = [stored.persist(spark.read.parquet(str(tmp_path / "rows")), NOW, stored=True) for _ in range(2)]
    monkeypatch.undo()
    assert staged == ["sources"] * 2 and names == [plain.persist(both.union(both), NOW)] * 2
    assert sizes(stored) == sizes(plain) == {"sightings": 2, "runs": 2, "iocs": 3, "run_iocs": 4, "joined": 4}
    assert {name: plain._read(name).exceptAll(stored._read(name)).count() for name in TABLES} == dict.fromkeys(TABLES, 0)


def test_links_meet_the_iocs_only_where_some_lack_theirs(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"))
    assert db.known_links()[0].count() == db.known_links()[1] == 0
    db.persist(rows(spark, "a", "b"), NOW)
    db.persist(rows(spark, "b", "c"), NOW)
    links, n = db.known_links()
    assert n == 3 and links.count() == 4 and "Join" not in links._jdf.queryExecution().optimizedPlan().toString()
    held = {name: db._read(name) for name in TABLES}
    db._publish("x", db._write(held | {"iocs": held["iocs"].filter("value <> 'b'")}), list(db.batches()))
    links, n = db.known_links()
    assert n == 2 and links.count() == 2 == db.linked().count()

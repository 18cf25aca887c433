"""Versioned tables: whole versions to readers, merges that touch their keys' buckets only."""

import json

import pytest

from tessera.operators.tables import Conflict, KeyedTable, Manifests

SCHEMA = "id long, v string"


def rows(df):
    return {r.id: r.v for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 16)
    t.replace(spark.range(2000).selectExpr("id", "concat('row ', id) AS v"))
    return t


def test_merge_inserts_replaces_and_deletes(spark, table):
    want = rows(table.read())
    table.merge(spark.createDataFrame([(3, "x"), (9000, "y"), (4, "kept")], SCHEMA), spark.createDataFrame([(7,), (4,), (123456,)], "id long"))
    want |= {3: "x", 9000: "y", 4: "kept"}
    del want[7]
    assert rows(table.read()) == want and len(want) == table.read().count()


def test_cost_of_a_merge_follows_its_keys(spark, table):
    store, before = table.manifests.store, table.version()
    whole = store.size("data")
    table.merge(spark.createDataFrame([(3, "x")], SCHEMA))
    after = table.version()
    changed = {b for b in after.says["parts"] if after.says["parts"][b] != before.says["parts"].get(b)}
    assert len(changed) == 1
    assert store.size("data") - whole < whole / 8
    read = {p.split("/data/")[1].split("/")[1] for p in table.lookup(spark.createDataFrame([(3,)], "id long")).inputFiles()}
    assert len(read) == 1


def test_a_reader_keeps_its_version_while_others_publish(spark, table):
    pinned, other = table.read(table.version()), KeyedTable(spark.newSession(), table.root, SCHEMA, ["id"], 16)
    for k in range(3):
        other.merge(other.spark.createDataFrame([(k, "new")], SCHEMA))
    assert rows(pinned)[0] == "row 0" and rows(table.read())[0] == "new"
    again = KeyedTable(spark, table.root, SCHEMA, ["id"], 16)  # as after a restart
    assert again.version().number == 4 and rows(again.read(1))[2] == "row 2"


def test_of_two_writers_one_wins_and_the_other_starts_from_it(spark, table, tmp_path):
    first = table.version()
    table.merge(spark.createDataFrame([(1, "a")], SCHEMA))
    with pytest.raises(Conflict):
        table.manifests.publish(first, {"parts": {}})
    m, seen = Manifests(spark, str(tmp_path / "m")), []

    def change(before):
        if not seen:
            seen.append(before.number)
            Manifests(spark, m.root).publish(before, {"by": "other"})
        return {"by": "me", "after": before.number}

    assert m.update(change).says == {"by": "me", "after": 1} and m.numbers() == [1, 2]
    names = m.store.names("manifests")
    assert names == ["000000000001.json", "000000000002.json"] and json.loads(m.store.read("manifests/" + names[0])) == {"by": "other"}


def test_a_merge_that_fails_leaves_the_version_as_it_was(spark, table):
    want = rows(table.read())
    with pytest.raises(Exception, match="broken"):
        table.merge(spark.createDataFrame([(1, "a")], SCHEMA), fold=lambda stored, new: new.selectExpr("id", "raise_error('broken') AS v"))
    assert table.version().number == 1 and rows(table.read()) == want


def test_the_same_tag_merges_once_and_fold_adds_up(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "s"), "id long, n long", ["id"], 4)
    add = lambda old, new: old.unionByName(new).groupBy("id").sum("n").toDF("id", "n")
    batch = spark.createDataFrame([(1, 2), (2, 5)], "id long, n long")
    for tag in ("b0", "b0", "b1"):
        t.merge(batch, tag=tag, fold=add)
    assert {r.id: r.n for r in t.read().collect()} == {1: 4, 2: 10} and t.version().number == 2


def test_old_versions_go_with_what_only_they_name(spark, table):
    for k in range(3):
        table.merge(spark.createDataFrame([(k, "new")], SCHEMA))
    want = rows(table.read())
    assert table.expire(keep=2) == [1, 2] and table.manifests.numbers() == [3, 4]
    assert rows(table.read()) == want and len(rows(table.read(3))) == 2000


def test_empty_tables(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "e"), SCHEMA, ["id"])
    assert t.read().count() == 0 and t.merge().number == 0
    assert t.merge(gone=spark.createDataFrame([(1,)], "id long")).number == 1 and t.read().count() == 0
    assert t.replace(spark.createDataFrame([], SCHEMA)).number == 2 and t.read().count() == 0
    assert t.expire() == []

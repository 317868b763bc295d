import zlib

import pytest

from ledgerlake.llm import sharding as s
from tests.llm.util import documents, frame


def placed(spark, rows):
    found = s.records(frame(spark, rows))
    sizes = s.slot_bytes(found)
    return s.place(found, s.balanced(sizes, 4), sizes).collect()


def test_records_and_places(spark):
    rows = documents()
    found = placed(spark, rows)
    raw = lambda t: (t or "").encode()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((repr(i), len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in rows)
    for shard in {r.shard for r in found}:
        mine = sorted(r.position for r in found if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert placed(spark, []) == []


def test_balance_and_rebalance(spark, tmp_path):
    rows = spark.range(20000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 50 AS int)) AS text")
    found = s.records(rows, slots=256)
    sizes = s.slot_bytes(found)
    first = s.balanced(sizes, 8)
    loads = [r.b for r in first.join(sizes, "virtual_slot").groupBy("shard").agg({"bytes": "sum"}).toDF("shard", "b").collect()]
    assert len(loads) == 8 and max(loads) < 1.01 * min(loads)
    s.store_map(first, str(tmp_path / "map"))
    second = s.rebalanced(s.load_map(spark, str(tmp_path / "map")), sizes, 9)
    s.store_map(second, str(tmp_path / "map"))
    both = s.load_map(spark, str(tmp_path / "map"), 1).alias("a").join(s.load_map(spark, str(tmp_path / "map")).alias("b"), "virtual_slot").selectExpr("a.shard x", "b.shard y", "b.version v").collect()
    assert len(both) == 256 and {r.v for r in both} == {2} and {r.y for r in both} == set(range(9))
    assert sum(r.x != r.y for r in both) < 256 * 0.2
    grown = [r.b for r in second.join(sizes, "virtual_slot").groupBy("shard").agg({"bytes": "sum"}).toDF("shard", "b").collect()]
    assert max(grown) < 1.1 * min(grown)


def test_query_stores_its_map(spark, tmp_path, monkeypatch):
    stored, store = [], s.store_map
    monkeypatch.setattr(s, "store_map", lambda m, path: (stored.append(path), store(m, path)))
    for name, rows in (("full", documents()), ("none", [])):
        frame(spark, rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        found = s.op7_sharding(spark, str(tmp_path / name)).collect()
        slots = {r.virtual_slot: r.shard for r in s.load_map(spark, stored[-1], 1).collect()}
        assert len(found) == len(rows) and all(slots[r.virtual_slot] == r.shard for r in found)
    assert len(stored) == 2


def test_place_by_an_older_map(spark):
    old, new = (s.records(spark.range(a, b).selectExpr("id AS doc_id", "'t' AS text")) for a, b in ((0, 50), (50, 100)))
    slot_map = s.balanced(s.slot_bytes(old, s.SLOTS), 4)
    assert slot_map.count() == s.SLOTS
    found = s.place(new, slot_map, s.slot_bytes(new, s.SLOTS)).collect()
    assert sorted(r.doc_id for r in found) == list(range(50, 100)) and all(r.shard in range(4) for r in found)
    with pytest.raises(Exception, match="no shard for slot"):
        s.place(new, slot_map.limit(1), s.slot_bytes(new)).collect()


def test_null_and_equal_ids(spark):
    rows = spark.range(400).selectExpr("CAST(if(id % 2 = 0, null, 7) AS long) AS doc_id", "repeat('x', CAST(id AS int)) AS text")
    found = s.records(rows).collect()
    assert len({r.virtual_slot for r in found if r.doc_id is None}) > 150 and len({r.virtual_slot for r in found if r.doc_id is not None}) == 1

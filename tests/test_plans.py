import os

import pytest
from pyspark.sql import functions as F

from ledgerlake import queries
from ledgerlake.functions import columns as c
from ledgerlake.functions import decoding
from ledgerlake.operators import state
from ledgerlake.plans import filters, history
from ledgerlake import samples as blobs

SF = "/root/testdata/sf0.001"


def test_filters():
    with pytest.raises(filters.BadRequest):
        filters.pairs("no colon")
    assert filters.skip_set(["a::b", "bad", "::x"]) == [("a", "b")]
    assert [filters.limit_of(x) for x in (None, 5, 5000)] == [100, 5, 1000]


def test_sort_is_checked(spark):
    with pytest.raises(filters.BadRequest):
        history.get_actions(spark.range(1), sort="up")


def test_columns(spark):
    row = spark.sql("SELECT 6138663591592764928L AS n, -3617168760277827584L AS t, 0L AS z").select(c.name_text(F.col("n")), c.name_text(F.col("t")), c.name_text(F.col("z")), c.name_value(F.lit("eosio.token")), c.name_value(F.lit("zzzzzzzzzzzzz")), c.symbol_code_text(F.lit(5459781).cast("long")), c.symbol_code_value(F.lit("EOS"))).first()
    assert tuple(row) == ("eosio.token", "transfer", "", 6138663591592764928, None, "EOS", 5459781)
    parsed = spark.createDataFrame([(x,) for x in ("1.0000 EOS", "-0.5 WAX", "42 SYS", "garbage", "1.0 lowercase", "1." + "0" * 19 + " X", None)], "t string").select(c.parse_asset(F.col("t")).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in parsed] == [(10000, 4, "EOS"), (-5, 1, "WAX"), (42, 0, "SYS"), None, None, None, None]
    shown = spark.createDataFrame([(10000, 4, "EOS"), (-5, 4, "EOS"), (42, 0, "SYS"), (42, 250, "BAD")], "a long, p int, c string").select(c.asset_text(F.col("a"), F.col("p"), F.col("c"))).collect()
    assert [r[0] for r in shown] == ["1.0000 EOS", "-0.0005 EOS", "42 SYS", "42 BAD"]


def test_sql_functions(spark):
    import json

    decoding.register(spark)
    spark.createDataFrame([(json.dumps(blobs.TOKEN_ABI), "accounts", bytearray(blobs.asset(1)), bytearray(34)), (None, "x", bytearray(b""), None)], "abi string, t string, d binary, k binary").createOrReplaceTempView("coded")
    found = spark.sql("SELECT decode_row(abi, t, d) AS d, public_key_text(k) AS k FROM coded").collect()
    assert sorted((r.d or "", r.k or "") for r in found) == [("", ""), ('{"balance":"0.0001 ORE"}', "PUB_K1_11111111111111111111111111111111149Mr2R")]


def test_as_of_edges(spark):
    probes = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1), (None, 1)], "k string, p long")
    versions = spark.createDataFrame([("a", 2, "v2"), ("a", 4, None)], "k string, p long, v string")
    fallback = spark.createDataFrame([("a", "fa"), ("b", "fb")], "k string, v string")
    found = {(r.k, r.p): r.found for r in state.as_of(probes, versions, "k", "p", "v", fallback).collect()}
    assert found == {("a", 1): "fa", ("a", 5): None, ("b", 1): "fb", (None, 1): None}


def test_ranges_copy_no_versions(spark, monkeypatch):
    """Each part of a hot key has the version in force for each of its probes; versions are not copied to all parts."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(state, "PART_ROWS", 10)
    probes = [("a", p) for p in range(400)] + [("b", 3), ("b", 900), (None, 1)]
    versions = [("a", p, None if p % 7 == 0 else f"v{p}") for p in range(5, 250)] + [("b", 4, "vb"), ("c", 1, "unused"), ("a", None, "fallback")]
    df = spark.createDataFrame(probes, "k string, p long")
    dealt, met = state.ranges(df, "k", F.col("p"), 8)
    known = [tuple(r) for r in met(spark.createDataFrame(versions, "k string, p long, v string"), "p", "v").select("k", "_part", "p", "v").collect()]
    rows = [tuple(r) for r in dealt.select("k", "_part", "p").collect()]
    last = lambda found: max(found, key=lambda x: -1 if x[0] is None else x[0], default=(None, None))[1]
    for k, part, p in rows:
        here = [(q, v) for j, at, q, v in known if (j, at) == (k, part) and (q is None or q <= p)]
        assert last(here) == last([(q, v) for j, q, v in versions if j == k and (q is None or q <= p)]), (k, p)
    assert sorted(map(repr, ((k, p) for k, _, p in rows))) == sorted(map(repr, probes))
    assert {part for k, part, _ in rows if k == "a"} == set(range(8)) and len(known) <= 247 + 7


def test_top_k_plan(spark):
    """Pages are top-k, and equality filters reach the scan."""
    plan = queries.QUERIES["q2_transaction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    found = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    order = [[x[0] for x in result.description].index(x) for x in found.columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    expected = sorted(repr([plain(r[k]) for k in order]) for r in result.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in found.collect()) == expected


def test_versions_grow_with_files_and_rows(spark):
    """No file number or row wraps a version; what does not fit is an error."""
    from ledgerlake.sources.feed import FRAME_BITS

    places = [(f << FRAME_BITS | k, d, r) for f in (0, 127, 128, 256, 2_000_000) for k in (0, 999) for d, r in ((0, 0), (0, 70_000), (1, 0), (5, 4_000_000))]
    frame = spark.createDataFrame(places, "arrival_ordinal long, delta_idx long, row_idx long")
    made = [r.v for r in frame.coalesce(1).select(state.version(F.col("arrival_ordinal"), state.row_sequence(F.col("delta_idx"), F.col("row_idx"))).alias("v")).collect()]
    assert made == sorted(set(made)) and made[0] >= 0
    for bad in ((1 << 35, 0, 0), (0, 64, 0), (0, 0, 1 << 22), (-1, 0, 0)):
        with pytest.raises(Exception, match="beyond"):
            spark.createDataFrame([bad], frame.schema).select(state.version(F.col("arrival_ordinal"), state.row_sequence(F.col("delta_idx"), F.col("row_idx")))).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["t13_ingest_deltas", "t14_ingest_tokens", "t7_ingest_actions"])
def test_blocks_are_decoded_once(spark, name):
    """The decoded blocks are kept, and dealt to all tasks even of a file that one task reads."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    kept = queries._held[0]
    assert kept.storageLevel.useDisk and "InMemoryTableScan" in plan and kept.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_document_versions_of_large_ids(spark, tmp_path):
    """Event ids beyond a row's 22 bits, and beyond a sequence's 28, give the version that the SQL states."""
    import duckdb

    ids = [0, 59, (1 << 22) - 1, 1 << 22, 5_999_999, (1 << 28) - 1, (1 << 28) + 7, (1 << 33) + 12345, None]
    spark.createDataFrame([(e, u) for e in ids for u in (0, 1, 89_999, None)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    found = [tuple(r) for r in queries.QUERIES["t16_doc_version"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(repr, found)) == sorted(map(repr, con.sql(queries.ORACLE_SQL["t16_doc_version"]).fetchall()))


def test_forks_across_runs(spark):

    heights = [10, 11, 12, 11, 12, 13, 14, 13, 15, 15]
    rows = spark.createDataFrame(list(enumerate(heights)), "arrival_ordinal long, block_num long")
    expected = [(k, heights[k], heights[k - 1]) for k in range(1, len(heights)) if heights[k] <= heights[k - 1]]
    for bits in (0, 1, 2, 14):
        assert [tuple(r) for r in state.forks(rows, run_bits=bits).orderBy("arrival_ordinal").collect()] == expected

import json
import threading
import urllib.error
import urllib.request

import pytest

from ledgerlake.operators import ingest, state
from ledgerlake.__main__ import standing_of
from ledgerlake.serve import Service, server
from ledgerlake.sources import config, feed
from ledgerlake.streaming import runner
from ledgerlake.streaming.store import Store
from ledgerlake import samples as blobs
from ledgerlake.codec import keys
from tests.test_ingest import whole_block


def balance(num, amount, present=True):
    return blobs.frame(num, blobs.signed_block(num), [], [blobs.delta("contract_row", [(present, blobs.contract_row("coin.vault", "ada", "accounts", 5, blobs.asset(amount)))])])


@pytest.fixture
def setup(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    code = blobs.frame(41, blobs.signed_block(999), [], [blobs.delta("account", [(True, blobs.account_row("coin.vault", blobs.packed_abi(blobs.TOKEN_ABI)))])])
    feed.write_frames(str(tmp_path / "feed" / "0001"), [code, whole_block(42), balance(43, 20000)])
    feed.write_frames(str(tmp_path / "feed" / "0002"), [balance(44, 30000), whole_block(45, 1003)])
    feed.register(spark)
    text = f'feed = "{tmp_path}/feed"\nwarehouse = "{tmp_path}/tables"\n[chain]\nname = "test"\n[indexer]\nmax_files_per_trigger = 1\n'
    (tmp_path / "c.toml").write_text(text)
    return config.load(str(tmp_path / "c.toml"))


def rows(df):
    return sorted(map(repr, df.select(*sorted(set(df.columns) - {"batch", "_version", "_op"})).collect()))


def test_batch_source(spark, setup):
    read = lambda **o: [r.block_num for r in spark.read.format("block_feed").options(**o).load(setup.feed).orderBy("arrival_ordinal").collect()]
    assert read() == [41, 42, 43, 44, 45] and read(startBlock="43", stopBlock="44") == [43, 44] and read(irreversibleOnly="true") == [41, 42, 43, 44, 45][:0]
    (r,) = spark.read.format("block_feed").options(startBlock="42", stopBlock="42", fetchTraces="false").load(setup.feed).collect()
    assert r.traces is None and r.deltas is not None and r.prev_id == "4d" * 32


def test_stream_equals_batch_and_resumes(spark, setup):
    runner.start(spark, setup, bounded=True).awaitTermination()
    store = Store(spark, setup.table("").rstrip("/"))
    whole = ingest.block_tables(spark.read.format("block_feed").load(setup.feed))
    for kind in ("action", "block", "delta", "abi", "perm", "token"):
        assert rows(store.log(kind)) == rows(whole[kind]), kind
    assert store.table("action").count() == 1 and store.table("block").count() == 5
    for kind in ("perm", "token"):
        assert rows(store.table(kind)) == rows(state.latest(whole[kind], ingest.KEYS[kind])), kind
    assert [r.amount for r in store.table("token").collect()] == [71.25] and store.confirmed() == 0
    feed.write_frames(f"{setup.feed}/0003", [balance(46, 1, present=False)])
    runner.start(spark, setup, bounded=True).awaitTermination()
    assert store.table("token").count() == 0 and store.confirmed() == 1
    # a batch that runs again replaces itself
    raw = spark.read.format("block_feed").options(startBlock="46").load(setup.feed)
    runner.write_batch(store, raw, 1)
    assert store.log("delta").where("block_num = 46").count() == 1
    before = rows(store.table("perm"))
    store.compact("perm")
    store.compact("token")
    assert rows(store.table("perm")) == before and store.table("token").count() == 0
    # an unconfirmed batch is not seen
    store.append("perm", spark.read.parquet(f"{store.path('perm')}/batch=-1"), 9)
    assert rows(store.table("perm")) == before


def test_unbounded_takes_some_files_at_a_time(spark, setup):
    query = runner.start(spark, setup)
    query.processAllAvailable()
    query.stop()
    store = Store(spark, setup.table("").rstrip("/"))
    assert store.confirmed() == 1 and store.table("block").count() == 5
    feed.write_frames(f"{setup.feed}/0003", [balance(46, 1, present=False)])
    query = runner.start(spark, setup)
    query.processAllAvailable()
    query.stop()
    assert store.table("token").count() == 0 and store.table("block").count() == 6


def test_service(spark, setup):
    runner.start(spark, setup, bounded=True).awaitTermination()
    store = Store(spark, setup.table("").rstrip("/"))
    http = server(Service(store.table, spark.sql("SELECT 50L AS head, 40L AS lib")), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def ask(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", data=None if body is None else json.dumps(body).encode())
        try:
            return 200, json.load(urllib.request.urlopen(request))
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    status, found = ask("/v2/history/get_actions?account=ada&filter=coin.vault:transfer&transfer.memo=RENT&limit=5")
    assert status == 200 and found["lib"] == 40 and found["total"] == {"value": 1, "relation": "eq"} and found["actions"][0]["notified"] == ["coin.vault", "ada", "ben"]
    assert ask("/v2/history/get_actions?sort=up")[0] == 400 and ask("/v2/history/get_actions?filter=x")[0] == 400 and ask("/nothing")[0] == 404
    assert ask(f"/v2/history/get_transaction?id={'5E' * 32}")[1]["executed"] and not ask("/v2/history/get_transaction?id=00")[1]["executed"]
    assert len(ask("/v2/history/get_deltas?code=coin.vault&present=true")[1]["deltas"]) == 4
    assert ask("/v2/history/get_abi_snapshot?contract=other&block=41")[1]["present"] is False and ask("/v2/history/get_abi_snapshot?contract=other")[1]["abi"]["actions"][0]["name"] == "transfer"
    assert ask("/v2/history/get_creator?account=x")[0] == 404 and ask("/v2/history/get_created_accounts?account=x")[1]["accounts"] == []
    bare = blobs.PUBLIC_KEY[1:]
    key = "ORE" + keys.base58(bare + keys.checksum(bare))
    assert ask(f"/v2/state/get_key_accounts?public_key={key}")[1]["account_names"] == ["ben"] == ask("/v1/history/get_key_accounts", {"public_key": key})[1]["account_names"]
    assert ask("/v1/history/get_controlled_accounts", {"controlling_account": "cleo"})[1]["controlled_accounts"] == ["ben"]
    account = ask("/v2/state/get_account?account=ada")[1]
    assert account["total_actions"] == 1 and account["tokens"][0]["contract"] == "coin.vault" and account["permissions"] == []
    assert ask("/v1/history/get_actions", {"account_name": "ben"})[1]["actions"][0]["account_action_seq"] == 0
    assert ask("/v1/history/get_transaction", {"id": "5e" * 32})[1]["traces"][0]["receipt_sequence"] == 5150 and ask("/v1/history/get_transaction", {"id": "0"})[0] == 404
    assert ask("/v2/health")[1]["health"]["lag"] == 5 and ask("/")[1]["engine"] == "spark"
    http.shutdown()


def test_config(tmp_path):
    (tmp_path / "bad.toml").write_text('feed = "a"\nwarehouse = "b"\n[indexer]\nstart = 1\n')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "bad.toml"))


def test_head_and_lib(spark, tmp_path):
    """The chain's word is asked each time; without it nothing counts as irreversible."""
    store = Store(spark, str(tmp_path / "store"))
    store.confirm(0, 70, 5)
    answers = [{"head": 50, "lib": 40}, {"head": 52, "lib": 41}, None]
    service = Service(store.table, lambda: standing_of(store, answers.pop(0)))
    assert [service.lib(), service.lib(), service.lib()] == [40, 41, 0]
    assert standing_of(store, None).first().asDict() == {"head": 70, "lib": 0}

import random
import re

from ledgerlake.llm import decontaminate as d
from tests.llm.util import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        it = words(item)
        size = min(10, len(it))
        windows = {tuple(it[k : k + size]) for k in range(len(it) - size + 1)} if it else set()
        for k in range(len(w) - size + 1):
            if size and tuple(w[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found.add(name)
    return len(w), len(hit), sorted(found)


def data():
    rng = random.Random(3)
    items = [(str(k), prose(50 + k, n, 60)) for k, n in enumerate((40, 25, 10, 9, 3, 1, 12))] + [("nul", None), ("e", ""), ("again", prose(50, 40, 60))]
    texts = [None, "", "--", "É!é"]
    for k in range(60):
        parts = [prose(900 + k, 30, 60)]
        for _ in range(rng.randrange(3)):
            item = words(rng.choice(items[:7])[1])
            a = rng.randrange(len(item))
            parts.append(" ".join(item[a : a + rng.randrange(1, 20)]).upper())
        texts.append(" ; ".join(parts))
    return items, texts


def test_scan(spark):
    items, texts = data()
    items = [(n, t) for n, t in items]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for most in (d.MAX_BROADCAST_WORDS, 30):
        for r in d.scan(docs, bench, most=most).collect():
            n, hit, names = brute(r.text, items)
            s = r["_scan"]
            assert (s.n_words, sum(x.end - x.start for x in s.spans), s["items"]) == (n, hit, names), r.text
    assert d.scan(docs.limit(0), bench).count() == 0 and d.scan(docs, bench.limit(0)).where("size(_scan.spans) > 0").count() == 0


def test_clean(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    texts = ["Before it: " + item.title() + "! After.", item, "clean text, stays; as it is\n", None, "ÄÖ " * 30 + item + " 中文"]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    two = bench.union(spark.createDataFrame([(2, "other words of another item here and now to be long")], "item_id int, text string"))
    many = {r.doc_id: r.text for r in d.clean(docs, two, max_coverage=0.9, most=5).collect()}
    found = {r.doc_id: r.text for r in d.clean(docs, bench, max_coverage=0.9).collect()}
    assert found == many == {0: "Before it: ! After.", 2: texts[2], 3: None, 4: "ÄÖ " * 30 + " 中文"}
    assert {r.doc_id: r.text for r in d.clean(docs, bench, max_span=20).collect()} == dict(enumerate(texts))
    assert d.clean(docs, bench).columns == docs.columns


def test_items_of_one_id_and_groups(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    items = spark.createDataFrame([("1", passage), ("1", passage), ("2", "w3 w4 w5"), (None, passage)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "before " + passage + " after"), (2, None), (3, "x " * 20000 + passage)], "doc_id long, text string")
    whole = [tuple(r) for r in d.scan(docs, items).orderBy("doc_id").select("_scan").collect()]
    split = [tuple(r) for r in d.scan(docs, items, most=30).orderBy("doc_id").select("_scan").collect()]
    assert whole == split and whole[0][0]["items"] == ["", "1", "2"] and [(s.start, s.end) for s in whole[2][0]["spans"]] == [(20000, 20030)]

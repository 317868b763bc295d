import re

import pytest

from ledgerlake.llm import quality_rules as q
from tests.llm.util import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows: dict[tuple, list[int]] = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    hit = {p for places in windows.values() if len(places) > 1 for k in places for p in range(k, k + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_measures(spark):
    found = q.judge(q.measure(frame(spark).select("doc_id", "text"))).collect()
    expected = sorted((repr(i), *brute(t)) for i, t in documents())
    assert sorted((repr(r.doc_id), *(r[c] for c in q.BASE_COLUMNS), r.base_failed) for r in found) == expected


def test_filter_keeps_columns_and_rows(spark):
    docs = frame(spark)
    found = q.quality_filter(docs)
    assert found.schema == docs.schema
    texts = {r.text for r in found.collect()}
    assert documents()[5][1] in texts and documents()[10][1] in texts
    for bad in ("spam " * 80, "line\n" * 30, "&&& ### " * 40, "SHOUT!! " * 50, "one", None):
        assert bad not in texts
    assert q.quality_filter(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule,text,kept", [("n_words", "a b", True), ("n_words", "a", False)])
def test_a_rule_of_ones_own(spark, rule, text, kept):
    rules = (q.Rule("two", rule, None, 2, None),)
    row = q.measure(spark.createDataFrame([(text,)], "text string")).select(q.compiled(rules).alias("k")).first()
    assert row.k is kept

import corpus_pipeline as p
from ledgerlake.llm import quality_rules
from tests.llm.test_near_dedup import brute
from tests.llm.util import edited, prose


def test_stages(spark, tmp_path):
    item = prose(77, 30)
    base = prose(1, 150)
    texts = [base, edited(base, 1, 2), base, "junk " * 60, prose(2, 120) + " " + item, item + " end", "short", None, prose(3, 100) + " write to ann@x.org soon", prose(4, 90)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in p.STAGES:
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.asDict() for r in d.collect()})
        if name != p.STAGES[-1][0]:
            assert d.columns == list(p.COLUMNS)
    assert set(seen[0]) == {0, 1, 2, 4, 5, 8, 9}
    rows = [(k, texts[k]) for k in sorted(seen[0])]
    assert set(seen[1]) == {int(i) for i, _, _, kept in brute(rows, 5) if kept} == {0, 4, 5, 8, 9}
    assert set(seen[2]) == {0, 4, 8, 9} and seen[2][4]["text"] == prose(2, 120) + " " and seen[2][0]["text"] == base
    assert "ann@x.org" not in seen[3][8]["text"] and "@x.org soon" in seen[3][8]["text"] and seen[3][9]["text"] == texts[9]
    assert set(seen[4]) == {0, 4, 8, 9} and all(r["n_tokens"] > 0 for r in seen[4].values())
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).collect()} == {0, 4, 8, 9}
    assert quality_rules.RULES

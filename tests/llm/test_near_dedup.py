import os
import random
import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import components as c
from ledgerlake.llm import near_dedup as n
from ledgerlake.llm.components import components
from tests.llm.util import documents, edited, frame, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        label = least.get(find(i)) if sets[i] else doc
        out.append((repr(doc), len(sets[i]), repr(label), doc == label))
    return sorted(out)


def found(df, k):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in n.groups(df, words=k).collect())


def test_edge_cases(spark):
    for k in (4, 5):
        assert found(frame(spark), k) == brute(documents(), k)
    assert n.groups(frame(spark).limit(0)).count() == 0


def families():
    """Copies, near copies and a passage that most texts share."""
    rng, passage = random.Random(5), prose(99, 60)
    texts = [prose(1000 + k, rng.randrange(30, 150)) + (" " + passage if k % 2 else "") for k in range(150)]
    for k in range(8):
        base = prose(2000 + k, 100)
        texts += [base.upper(), base] + [edited(base, 10 * k + j, rng.randrange(1, 6)) for j in range(12)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_brute_force(spark, monkeypatch):
    rows = families()
    assert found(frame(spark, rows), 4) == brute(rows, 4)
    # small buckets count as large: the recursion gives the same
    monkeypatch.setattr(n, "SMALL", 4)
    monkeypatch.setattr(n, "BLOCK", 6)
    assert found(frame(spark, rows), 4) == brute(rows, 4)


def test_deduplicate(spark):
    docs = frame(spark, families())
    kept = n.deduplicate(docs)
    expected = {int(d) for d, _, _, k in brute(families(), 5) if k}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == expected


def test_components(spark):
    chain = [(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (5, 5), (40, 39)]
    found = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(21)}, 30: 30, 31: 30, 39: 39, 40: 39}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(n_links, n_chains):
    """Copies that differ in the last word, and texts that only one of these links: a copy with a run of words of its own."""
    base = [f"b{k}" for k in range(100)]
    copies = [[*base[:-1], f"end{k}"] for k in range(n_links)]
    chained = [[*c[: 5 + k % 80], *(f"own{k}x{j}" for j in range(7)), *c[12 + k % 80 :]] for k, c in enumerate(copies[:n_chains])]
    return list(enumerate(" ".join(t) for t in copies + chained))


def components_of(rows, k):
    """By all pairs, as one product of incidence matrices in pieces."""
    sets = [shingles(t, k) for _, t in rows]
    places = {g: i for i, g in enumerate({g for s in sets for g in s})}
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, len(places), 8192):
        m = np.zeros((len(sets), 8192), dtype=np.float32)
        for i, s in enumerate(sets):
            for g in s:
                if start <= places[g] < start + 8192:
                    m[i, places[g] - start] = 1
        shared += m @ m.T
    size = shared.diagonal()
    linked = 100 * shared >= 80 * (size[:, None] + size[None, :] - shared)
    label = np.arange(len(sets))
    while True:
        least = np.where(linked, label[None, :], len(sets)).min(axis=1)
        if (least == label).all():
            return {rows[i][0]: rows[x][0] for i, x in enumerate(label.tolist())}
        label = least


def test_links_far_from_the_pivot(spark):
    # 40 open nodes are compared with all others, 1100 branch
    for n_chains in (40, 1100):
        rows = planted(1100, n_chains)
        assert {r.doc_id: r.component_id for r in n.groups(frame(spark, rows), words=4).collect()} == components_of(rows, 4)


def test_deduplicate_judges_rows(spark):
    copy, other = prose(70, 80), prose(71, 80)
    docs = spark.createDataFrame([(1, copy), (7, copy), (7, other), (None, copy), (None, ""), (3, None)], "doc_id long, text string")
    kept = sorted((repr(r.doc_id), r.text or "") for r in n.deduplicate(docs).collect())
    assert kept == sorted([("1", copy), ("7", other), ("None", ""), ("3", "")])


def written(monkeypatch):
    """The bytes of the files of each table that is written, by name, as the list grows."""
    made, real = [], n.materialise

    def write(df, name):
        out = real(df, name)
        made.append((name, sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())))
        return out

    monkeypatch.setattr(n, "materialise", write)
    return made


def test_only_asked_words_are_written(spark, monkeypatch):
    # words of their own, so that nothing but a few copies is ever compared
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(400)) for _ in range(500)]
    texts += [edited(t, k, 2) for k, t in enumerate(texts[:20])]
    rows, made = list(enumerate(texts)), written(monkeypatch)
    result = found(frame(spark, rows), 4)
    assert [r[2] for r in result] == [repr(int(r[0]) % 500) for r in result]
    assert sum(size for name, size in made if name in ("signed", "bodies")) < 0.2 * sum(map(len, texts))


def test_equal_rows_and_documents_that_change(spark, monkeypatch):
    base = prose(80, 90)
    rows = [(1, base)] * 30 + [(2, edited(base, 3, 1))] * 5 + [(None, edited(base, 4, 1))] * 3 + [(4, prose(81, 90))] * 2
    assert found(frame(spark, rows), 4) == brute(rows, 4)
    # another last word at each visit
    made = written(monkeypatch)
    end = F.udf(lambda t: f"{t} {uuid.uuid4().hex}").asNondeterministic()
    docs = frame(spark, families()).withColumn("text", end("text"))
    result = found(docs, 4)
    assert [name for name, _ in made].count("documents") == 1
    assert result == brute([(d, f"{t} end{k}") for k, (d, t) in enumerate(families())], 4)


def test_nodes_of_one_number(spark, monkeypatch):
    real, seeds = n._node, set()
    monkeypatch.setattr(n, "_node", lambda seed: seeds.add(seed) or (real(seed) if seed else F.lit(7).cast("long")))
    rows = families()
    assert found(frame(spark, rows), 4) == brute(rows, 4) and seeds == {0, 1}


def test_words_are_brought_in_parts(spark, monkeypatch):
    rows, parts, real = families(), [], n._slices
    monkeypatch.setattr(n, "SMALL", 4)
    monkeypatch.setattr(n, "BLOCK", 6)
    monkeypatch.setattr(n, "LEAST_ROWS", 400)
    monkeypatch.setattr(n, "_slices", lambda *a: parts.append(real(*a)) or parts[-1])
    assert found(frame(spark, rows), 4) == brute(rows, 4)
    assert max(map(len, parts)) > 1


def test_one_component_does_not_meet_again(spark):
    # links of other trees join 1, 2 and 3: bucket 8 is done, and three nodes of bucket 7 are open
    rows = spark.createDataFrame([(7, x) for x in range(1, 7)] + [(8, x) for x in range(1, 4)], "key long, node long")
    label = spark.createDataFrame([(2, 1), (3, 1), (1, 1)], "a long, b long")
    made = {(r.key, r.node, r.of, r.crowd, r.opens, r.open) for r in n._opened(rows, label).collect()}
    assert made == {(7, x, 1, 6, 3, 0) for x in (1, 2, 3)} | {(7, x, x, 6, 3, 1) for x in (4, 5, 6)}
    # of a dense bucket only nodes with a partner in another component get their words
    bucket = spark.createDataFrame([(7, 1, 100, 0, 0, 1), (7, 2, 100, 0, 0, 1), (8, 3, 100, 0, 0, 1), (8, 4, 100, 0, 0, 4), (8, 5, 100, -1, -1, 5)], "key long, node long, n long, s0 long, s1 long, of long")
    assert {(r.key, r.node) for r in n._alive(bucket, 80).collect()} == {(8, 3), (8, 4)}


def test_components_in_rounds(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(-k, -k - 1) for k in range(5, 40)]
    df = spark.createDataFrame(links, "a long, b long")
    one = {(r.node, r.label) for r in components(df).collect()}
    monkeypatch.setattr(c, "FEW", -1)
    assert {(r.node, r.label) for r in components(df).collect()} == one and (-5, -40) in one

"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one suffix automaton. A document's words
stream through it; at each word the automaton holds the longest run of words, ending
there, that occurs in some item. A run of ``window`` words or more is contaminated, and
so is a run that is a whole shorter item. ``scan`` reports the spans; ``clean`` removes
them from texts, or drops texts that they cover beyond a limit.

The automaton of a bounded benchmark travels with the tasks. Its words are counted
first: above ``MAX_BROADCAST_WORDS`` the items are dealt into groups below that bound,
and the documents visit one group after the other: what a visit found is written to the
shared folder before the next, so no task ever holds more than one group's automaton.

Defined results: null or empty texts, of documents and items, have no words and match
nothing; items of one id count as one, equal items of different ids as several; an empty benchmark leaves all documents clean;
columns of the given names are replaced and all others are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialise, on_workers, table
from .pyexec import struct_udf

WINDOW = 10
#: Words of benchmark text per automaton: 700 to 950 bytes a word in a worker, as measured.
MAX_BROADCAST_WORDS = 250_000
#: Word bytes stay, upper-case ASCII is lowered, all other ASCII separates.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
IS_WORD = np.frombuffer(NORMAL, dtype=np.uint8) != 0x20


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def word_spans(text: str) -> np.ndarray:
    """First and last-plus-one byte of each word, in the order of ``words_of``."""
    inside = np.concatenate([[False], IS_WORD[np.frombuffer(text.encode(), dtype=np.uint8)], [False]])
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


class SuffixAutomaton:
    """Generalised suffix automaton over items of words, in plain dictionaries and lists.

    ``short[s]`` lists the whole items of under ``window`` words that are suffixes of what
    state ``s`` stands for, as (length, item); ``items[s]`` has the items in which a state
    of ``window`` words or more occurs.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        ends: list[list[int]] = [[]]
        for k, (_, words) in enumerate(items):
            last = 0
            for word in words:
                last = self._extend(last, word, ends)
                ends[last].append(k)
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                at = 0
                for word in words:
                    at = self.next[at][word]
                whole.setdefault(at, []).append((len(words), k))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        found = [frozenset(x) for x in ends]
        for s in reversed(order):
            if self.length[self.link[s]] >= window:
                found[self.link[s]] |= found[s]
        self.items = [x if self.length[s] >= window else frozenset() for s, x in enumerate(found)]
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in order:
            self.short[s] = (*whole.get(s, ()), *self.short[self.link[s]])

    def _extend(self, last: int, word: bytes, ends: list[list[int]]) -> int:
        step = self.next[last].get(word)
        if step is not None and self.length[step] == self.length[last] + 1:
            return step
        if step is not None:
            return self._clone(last, step, word, ends)
        new = self._state(self.length[last] + 1, {}, ends)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            step = self.next[at][word]
            self.link[new] = step if self.length[step] == self.length[at] + 1 else self._clone(at, step, word, ends)
        return new

    def _state(self, length: int, edges: dict[bytes, int], ends: list[list[int]]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        ends.append([])
        return len(self.next) - 1

    def _clone(self, at: int, step: int, word: bytes, ends: list[list[int]]) -> int:
        """Split off the part of ``step`` that is one word longer than ``at``."""
        clone = self._state(self.length[at] + 1, dict(self.next[step]), ends)
        self.link[clone], self.link[step] = self.link[step], clone
        while at >= 0 and self.next[at].get(word) == step:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint ascending spans of contaminated words, and the items they come from."""
        follow, length, link, short, window = self.next, self.length, self.link, self.short, self.window
        known = follow[0]
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = run = 0
        for i, word in enumerate(words):
            if word not in known:
                state = run = 0
                continue
            while word not in follow[state]:
                state = link[state]
                run = length[state]
            state = follow[state][word]
            run += 1
            if run >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                items |= self.items[at]
                self._add(spans, i + 1 - run, i + 1)
            if short[state]:
                for size, item in short[state]:
                    if size <= run:
                        items.add(item)
                        self._add(spans, i + 1 - size, i + 1)
        return spans, items

    @staticmethod
    def _add(spans: list[tuple[int, int]], start: int, end: int) -> None:
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append((start, end))


SCAN = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
SCAN_DDL = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def item_groups(benchmark: DataFrame, most: int = MAX_BROADCAST_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in groups of at most ``most`` words (a single longer item is a group of its own).

    One group at a time is on the driver: rows arrive partition by partition.
    """
    group, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        words = words_of(row.t)
        if group and size + len(words) > most:
            yield group
            group, size = [], 0
        if words:
            group.append((row.i if row.i is not None else "", words))
            size += len(words)
    yield group


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, into: str = "_scan", most: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """``docs`` with a struct: n_words, the contaminated spans of words, and the ids of the items found."""
    on_workers(docs.sparkSession)
    text, out, written = f"`{text}`", docs, None
    groups = item_groups(benchmark, most)
    group, following = next(groups), next(groups, None)
    while True:
        shared = docs.sparkSession.sparkContext.broadcast(group)
        built: list[SuffixAutomaton] = []

        def run(texts: pa.Array, shared=shared, built=built) -> dict[str, list]:
            if not built:
                built.append(SuffixAutomaton(shared.value, window))
            sam = built[0]
            made = {f.name: [] for f in SCAN}
            for x in texts:
                words = words_of(x.as_py())
                spans, items = sam.scan(words)
                made["n_words"].append(len(words))
                made["spans"].append([{"start": a, "end": b} for a, b in spans])
                made["items"].append(sorted({sam.names[k] for k in items}))
            return made

        found, before = struct_udf(run, SCAN_DDL, SCAN)(F.col(text)), written
        out = out.withColumn(into, found) if before is None else out.withColumn("_more", found).withColumn(into, F.expr(_united(into, "_more"))).drop("_more")
        if following is None:
            return out
        out = written = materialise(out, "scan")
        if before is not None:
            drop_table(before)
        shared.unpersist()
        group, following = following, next(groups, None)


def _united(a: str, b: str) -> str:
    """SQL: the struct of two scans of one text."""
    return f"""named_struct('n_words', {a}.n_words, 'spans', aggregate(array_sort(concat({a}.spans, {b}.spans)), CAST(array() AS array<struct<start: bigint, end: bigint>>),
        (a, s) -> CASE WHEN size(a) > 0 AND a[size(a) - 1].end >= s.start
                       THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, s.end))))
                       ELSE concat(a, array(s)) END), 'items', array_sort(array_union({a}.items, {b}.items)))"""


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without spans of words, each from its first word's first byte to its last word's last."""
    places, raw, at, kept = word_spans(text), text.encode(), 0, []
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5, most: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """``docs`` without the spans of over ``max_span`` words, and without texts covered beyond ``max_coverage``.

    What stands around a removed span stays. A text of which more than ``max_coverage``
    of the words lie in such spans goes as a whole; clean texts stay as they are.
    """
    on_workers(docs.sparkSession)
    groups = item_groups(benchmark, most)
    first, single = next(groups), next(groups, None) is None
    shared = docs.sparkSession.sparkContext.broadcast(first if single else [])
    built: list[SuffixAutomaton] = []
    judged = docs if single else scan(docs, benchmark, text, window, "_scan", most)

    def run(texts: pa.Array, *scanned: pa.Array) -> dict[str, list]:
        made: dict[str, list] = {"gone": [], "cut": []}
        if not built and not scanned:
            built.append(SuffixAutomaton(shared.value, window))
        for k, x in enumerate(texts):
            x = x.as_py()
            if scanned:
                found = scanned[0][k].as_py()
                n, spans = found["n_words"], [(s["start"], s["end"]) for s in found["spans"]]
            else:
                words = words_of(x)
                n, spans = len(words), built[0].scan(words)[0]
            spans = [(a, b) for a, b in spans if b - a > max_span]
            gone = sum(b - a for a, b in spans) > max_coverage * n
            made["gone"].append(gone)
            made["cut"].append(_without(x, spans) if spans and not gone else None)
        return made

    cleaned = struct_udf(run, "gone boolean, cut string", pa.struct([("gone", pa.bool_()), ("cut", pa.string())]))
    inputs = [F.col(f"`{text}`")] if single else [F.col(f"`{text}`"), F.col("_scan")]
    found = judged.withColumn("_clean", cleaned(*inputs)).where("NOT _clean.gone")
    return found.withColumn(text, F.coalesce("_clean.cut", F.col(f"`{text}`"))).drop("_clean", "_scan")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(_scan.spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.select(
        "doc_id",
        F.col("_scan.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_scan.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def oracle() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS k, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d), ks WHERE i + k - 1 <= len(w)),
hit AS (SELECT rid, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
places AS (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hit),
n AS (SELECT rid, count(*) AS n_hit FROM places GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""

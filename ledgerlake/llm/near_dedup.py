"""Near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct shingles (runs of ``words`` words) as 64-bit hashes.
Documents with equal sets become one node at once. Each of ``TREES`` independent trees
sends a node down a path of minwise tokens: the first splits all nodes, and a bucket of
more than ``BLOCK`` nodes splits again by further ones. Buckets of at most BLOCK nodes are
compared exhaustively: up to ``SMALL`` nodes as screened pairs, which many buckets share,
and above by bringing the sets of the bucket together, which is cheaper where a bucket is
dense.

A large bucket is first compared with one pivot, which then leaves it, so the recursion
always ends: the node that by sketch is nearest to the bucket's centre, which is what two
of three central nodes have. The nearer the pivot is to the centre, the more of a group of
copies link to it; two nodes that only differ from the centre in different places are
linked only if both link to a pivot that is no further from it. The others branch by the minwise tokens of
what they do not share with its centre (see ``_face``): tokens that the whole bucket has in
common, be it a passage or a text copied with small changes, can not be chosen again.
After that the components of all links so far are made, over all trees: two nodes of one
component need not meet again, so a bucket within one component is done, and one with at
most half a BLOCK of nodes outside its largest compares these with all its nodes, in
blocks. So does, with all pairs of its parts as blocks, one of at most WIDE nodes.

A sketch of 128 bits screens pairs: a pair at the threshold passes with five standard
deviations to spare. Links are confirmed on the full sets. What travels for that are the
normalised words, compressed: a third of the bytes of the hashes, which the worker makes
again. Only nodes that a screened pair or a large bucket asks for have their words written,
by a second visit of the documents; all others leave a signature only. Screened pairs are confirmed in two turns, first one a node, then all whose ends
are not yet in one component; components therefore equal those of all confirmed links.

Recall of a pair at similarity 0.8 by level-one buckets alone is 1 - 0.2 ** TREES, over
0.99999; a link to the centre of a large bucket is found at the first level. Elsewhere in
large buckets nodes draw as many tokens as the least overlap of the differences of two
linked nodes asks for (see ``_face``): a tree keeps a pair with 0.75 or more at each
further level, so all trees together keep it with 0.9999 at the first and 0.999 at the second of these;
buckets of at most ``WIDE`` nodes have no further level and lose nothing.

Nothing but counts and checksums reaches the driver. Signatures, and the words that are
asked for, are written once to the shared folder, words are brought to a share of the rows
of a step at a time (see ``_slices``), every aggregation is partial first, and joins that may have a
hot key take the hottest aside (see ``spread_join``).

Defined results: null, empty or blank texts have no shingles, form a component of their
own each and stay; fewer words than ``words`` make one shingle of the whole sequence;
rows with equal doc_id and equal text share a component and are kept alike, rows with
equal doc_id and different texts are judged each by its text; a null doc_id
never names a component unless all its members are null, and ``deduplicate`` removes its
row otherwise; an empty table gives an empty table; other columns are kept by
``deduplicate``. Documents that the second visit finds changed are written whole first.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ByteMemo, drop_table, materialise, on_workers, release, table
from .components import components, spread_join
from .pyexec import struct_udf

TREES = 12
SMALL = 24
BLOCK = 256
#: Blocks' worth of nodes up to which a bucket is dealt into blocks instead of split again.
WIDE = 4
SKETCH_BITS = 128
#: Share of a node that its centre lacks, below which all differences from the centre decide the branch.
NEAR = 0.5
#: Least tokens that a near node goes on by, and a far one.
DRAWS = 3
FAR_DRAWS = 2
#: The chance that none of the drawn tokens of a node is among those in common with a partner.
MISS = 0.125
#: Sketch bits that may differ: a pair of similarity 0.8 differs in 12.8 with deviation 3.4.
MAX_SKETCH_DISTANCE = 30
#: Bytes that a worker remembers of hashes of words, and of sets.
WORD_CACHE = 16 << 20
SET_CACHE = 16 << 20
#: Hashes of a bucket that are in memory at once.
RANGE = 4_000_000
#: Rows to which words are brought at once: one in so many of the number of all nodes, and so many in any case.
SHARE = 4
LEAST_ROWS = 1 << 16
#: Least and most bits of a broadcast filter: at most a row an id, and a million rows of 64.
LEAST_FILTER_BITS = 1 << 21
FILTER_BITS = 1 << 26
#: Texts whose words are brought without a filter.
FEW_BODIES = 1 << 15
U64 = np.uint64


def odd_constants(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers, the SplitMix64 sequence from ``seed``."""
    x = (np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed)
    return _mix(x) | U64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


PATHS = odd_constants(TREES, 1)
BITS = odd_constants(SKETCH_BITS, 2)
PLACES = odd_constants(64, 3)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


class Shingles:
    """Sets of the shingles of texts, with caches of a fixed number of bytes."""

    def __init__(self, words: int):
        self.words = words
        self.hashes = ByteMemo(_digest, WORD_CACHE)
        self.sets = ByteMemo(lambda body: self.of(zstandard.decompress(body).split()), SET_CACHE)

    def of(self, parts: list[bytes]) -> np.ndarray:
        """The sorted distinct 64-bit hashes of the shingles of a list of words."""
        if not parts:
            return np.empty(0, dtype=U64)
        hashes, words = np.frombuffer(b"".join([self.hashes[w] for w in parts]), dtype=U64), self.words
        if len(hashes) < words:
            return np.frombuffer(_digest(hashes.tobytes()), dtype=U64)
        made = hashes[: len(hashes) - words + 1] * PLACES[0]
        for k in range(1, words):
            made = made + hashes[k : len(hashes) - words + 1 + k] * PLACES[k]
        return np.unique(_mix(made))

    def of_body(self, body: pa.Scalar) -> np.ndarray:
        """The set of a text by its compressed words."""
        return self.sets[body.as_py()]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def minima(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The minwise hash of a set under each multiplier; blocks bound the memory of long texts."""
    spread, least = _mix(shingles), None
    for k in range(0, len(spread), 1024):
        block = (spread[k : k + 1024, None] * multipliers[None, :]).min(axis=0)
        least = block if least is None else np.minimum(least, block)
    return least >> U64(32)


def sketch_of(least: np.ndarray) -> list[int]:
    """One bit of each minwise hash, as two numbers."""
    return np.packbits((least & U64(1)).astype(np.uint8)).view(np.int64).tolist()


SIGNED = pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("s0", pa.int64()), ("s1", pa.int64()), ("path", pa.list_(pa.int32()))])
SIGNED_DDL = "n long, digest binary, s0 long, s1 long, path array<int>"


def sign(text: Column, words: int) -> Column:
    """A struct per text: set size, digest of the set, sketch, minwise hashes along the paths."""
    shingles = Shingles(words)
    multipliers = np.concatenate([PATHS, BITS])

    def run(texts: pa.Array) -> dict[str, list]:
        made: dict[str, list] = {f.name: [] for f in SIGNED}
        for x in texts:
            found = shingles.of(words_of(x.as_py()))
            made["n"].append(len(found))
            if not len(found):
                for k in ("digest", "s0", "s1", "path"):
                    made[k].append(None)
                continue
            least = minima(found, multipliers)
            s0, s1 = sketch_of(least[len(PATHS) :])
            made["digest"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            made["s0"].append(s0)
            made["s1"].append(s1)
            made["path"].append(least[: len(PATHS)].astype(np.uint32).view(np.int32))
        return made

    return struct_udf(run, SIGNED_DDL, SIGNED)(text)


def _pack(text: Column | str) -> Column:
    """The words of each text, compressed."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=1, write_checksum=False)
        return pa.array([press.compress(b" ".join(words_of(x.as_py()))) for x in texts], type=pa.binary())

    return run(text)


def _linked(left: Column | str, right: Column | str, words: int, percent: int) -> Column:
    """Whether two texts are linked by their full sets, by their compressed words."""
    shingles = Shingles(words)

    @F.arrow_udf("boolean")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        made = []
        for a, b in zip(left, right, strict=True):
            x, y = shingles.of_body(a), shingles.of_body(b)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            made.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pa.array(made, type=pa.bool_())

    return run(left, right)


def _distance(a: str, b: str) -> str:
    return f"bit_count({a}s0 ^ {b}s0) + bit_count({a}s1 ^ {b}s1)"


def _may_link(a: str, b: str, percent: int) -> str:
    return f"(100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n) AND {_distance(a, b)} <= {MAX_SKETCH_DISTANCE})"


def _among(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """At least the rows whose ``name`` is in ``ids`` (one column of a written table).

    A bitmap of sixteen bits an id, but at least LEAST_FILTER_BITS and at most FILTER_BITS,
    keeps most other rows out of what follows; it may let some pass.
    """
    size = 1 << max(LEAST_FILTER_BITS.bit_length() - 1, min(FILTER_BITS.bit_length() - 1, (16 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    spots = ids.toDF("id").select(place(F.col("id")).alias("spot"))
    bitmap = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS int))")).alias("bits"))
    found = rows.withColumn("_spot", place(F.col(name)))
    kept = found.join(F.broadcast(bitmap), F.shiftright("_spot", 6) == F.col("word")).where("(shiftrightunsigned(bits, CAST(_spot & 63 AS int)) & 1) = 1")
    return kept.drop("_spot", "word", "bits")


class Changed(Exception):
    """A second visit of the documents does not find what the first did."""


def _packed(source: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, body): the compressed words of at least the nodes in ``ids`` (one column ``node``), once each; a written table."""
    ids = materialise(ids, "asked")
    bodies = materialise(_among(source, "node", ids).select("node", _pack("text").alias("body")), "bodies")
    times = ids.select("node", F.lit(1).alias("ask"), F.lit(0).alias("have")).unionByName(bodies.select("node", F.lit(0).alias("ask"), F.lit(1).alias("have")))
    times = times.groupBy("node").agg(F.sum("ask").alias("ask"), F.sum("have").alias("have"))
    missed, repeated = times.agg(F.max(F.expr("ask > 0 AND have = 0")), F.max(F.expr("have > 1"))).first()
    drop_table(ids)
    if missed:
        drop_table(bodies)
        raise Changed
    if repeated:
        # rows that are equal in id and text
        every, bodies = bodies, materialise(bodies.dropDuplicates(["node"]), "bodies")
        drop_table(every)
    return bodies


def _bodies(bodies: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(name, body_<name>): the words of at least the nodes in ``ids`` (one column of a written table).

    All of them where there are few: a filter costs three small jobs.
    """
    named = bodies.select(F.col("node").alias(name), F.col("body").alias(f"body_{name}"))
    return named if bodies.count() <= FEW_BODIES else _among(named, name, ids)


def _slices(rows: DataFrame, by: str, total: int) -> list[DataFrame]:
    """A written table in parts by a hash of ``by``, of about a SHARE-th of ``total`` rows each, or LEAST_ROWS.

    A node is in up to TREES buckets, so all rows of a step with their words may be many
    times the documents. Shuffles of a part are released before the next.
    """
    parts = max(-(-rows.count() // max(total // SHARE, LEAST_ROWS)), 1)
    return [rows.where(F.pmod(F.xxhash64(F.lit(parts), by), F.lit(parts)) == k) for k in range(parts)]


def _confirmed(pairs: DataFrame, bodies: DataFrame, total: int, words: int, percent: int) -> list[DataFrame]:
    """The pairs (a, b) of a written table, which goes, that are links by their full sets; written tables."""
    made = []
    for part in _slices(pairs, "a", total):
        both = part.join(_bodies(bodies, part.select("a"), "a"), "a").join(_bodies(bodies, part.select("b"), "b"), "b")
        made.append(materialise(both.select("a", "b", _linked("body_a", "body_b", words, percent).alias("linked")).where("linked").select("a", "b"), "links"))
        release(pairs.sparkSession)
    drop_table(pairs)
    return made


def _small_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All screened pairs of the nodes of each bucket of at most SMALL nodes."""
    members = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n", "s0", "s1"))).alias("m"))
    pairs = F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {SMALL}), y -> {_may_link('x.', 'y.', percent)}), y -> struct(x.node AS a, y.node AS b))))")
    return members.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _shared_counts(bodies: pa.ChunkedArray, sizes: np.ndarray, shingles: Shingles) -> np.ndarray:
    """The sizes of all intersections of the sets of a bucket, as products of incidence matrices.

    Sets enter by ranges of hashes, so that RANGE of them are in memory at once, and one whole set.
    """
    shared, ranges = np.zeros((len(sizes), len(sizes)), dtype=np.int64), -(-int(sizes.sum()) // RANGE)
    for r in range(ranges):
        ends = np.array([r * (1 << 64) // ranges, (r + 1) * (1 << 64) // ranges - 1], dtype=U64)
        parts = []
        for body in bodies:
            found = shingles.of_body(body)
            a, b = np.searchsorted(found, ends[0]), np.searchsorted(found, ends[1], "right")
            parts.append(found[a:b].copy() if ranges > 1 else found)
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        _, place, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        # what only one set has is in no intersection
        several = np.flatnonzero(times[place] > 1)
        _, place = np.unique(place[several], return_inverse=True)
        order = np.argsort(place, kind="stable")
        owner, place = owner[several][order], place[order]
        for k in range(0, int(place[-1]) + 1 if len(place) else 0, 8192):
            a, b = np.searchsorted(place, [k, k + 8192])
            matrix = np.zeros((len(sizes), 8192), dtype=np.float32)
            matrix[owner[a:b], place[a:b] - k] = 1
            shared += (matrix @ matrix.T).astype(np.int64)
    return shared


#: A row of a bucket.
BUCKET = ("key", "node", "n", "s0", "s1", "of")


def _alive(rows: DataFrame, percent: int) -> DataFrame:
    """(key, node, n): the nodes that have a screened partner in their bucket of at most BLOCK nodes, as a written table.

    Pairs of nodes that are in one component (``of``) already are left aside.
    """
    members = rows.groupBy("key").agg(F.collect_list(F.struct("node", "n", "s0", "s1", "of")).alias("m"))
    paired = F.expr(f"filter(m, x -> exists(m, y -> y.of <> x.of AND {_may_link('x.', 'y.', percent)}))")
    return materialise(members.select("key", F.explode(paired).alias("x")).select("key", F.col("x.node").alias("node"), F.col("x.n").alias("n")), "alive")


def _block_links(alive: DataFrame, bodies: DataFrame, total: int, words: int, percent: int) -> list[DataFrame]:
    """Confirmed links that connect the nodes of each bucket of ``alive``, which goes; written tables."""
    shingles = Shingles(words)

    def connect(bucket: pa.Table) -> pa.Table:
        nodes, size = bucket.column("node").to_pylist(), bucket.column("n").to_numpy()
        shared = _shared_counts(bucket.column("body_node"), size, shingles)
        linked = np.argwhere(np.triu(100 * shared >= percent * (size[:, None] + size[None, :] - shared), 1))
        root = list(range(len(nodes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        tree = []
        for x, y in linked.tolist():
            if (p := find(x)) != (q := find(y)):
                root[p] = q
                tree.append((nodes[x], nodes[y]))
        return pa.table({"a": pa.array([min(x) for x in tree], pa.int64()), "b": pa.array([max(x) for x in tree], pa.int64())})

    made = []
    for part in _slices(alive, "key", total):
        brought = part.join(_bodies(bodies, part.select("node"), "node"), "node")
        made.append(materialise(brought.groupBy("key").applyInArrow(connect, "a long, b long"), "links"))
        release(alive.sparkSession)
    drop_table(alive)
    return made


def _central(rows: DataFrame) -> DataFrame:
    """Three central nodes of each bucket: of each third of its nodes the one nearest to the majority of each sketch bit."""
    votes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("votes"), *[F.sum(F.expr(f"shiftrightunsigned(s0, {k}) & 1")).alias(f"v{k}") for k in range(64)])
    majority = votes.select("key", F.expr(" | ".join(f"shiftleft(CAST(2 * v{k} > votes AS bigint), {k})" for k in range(64))).alias("majority"))
    ranked = rows.join(majority, "key").select("key", F.struct(F.expr("bit_count(s0 ^ majority)").alias("off"), "node").alias("p"))
    thirds = ranked.groupBy("key").agg(*[F.expr(f"min(p) FILTER (WHERE pmod(xxhash64(p.node), 3) = {k})").alias(f"p{k}") for k in range(3)])
    ordered = thirds.select("key", F.expr("array_sort(array_compact(array(p0, p1, p2)))").alias("p"))
    return ordered.select("key", *[F.expr(f"get(p, {k}).node").alias(name) for k, name in enumerate(CENTRAL)])


CENTRAL = ("first", "second", "third")
CENTRE = pa.struct([("c0", pa.int64()), ("c1", pa.int64())])


def _centre(three: list[np.ndarray]) -> np.ndarray:
    """What two of three sets have; the first set where there are fewer, or no such tokens."""
    tokens, times = np.unique(np.concatenate(three), return_counts=True)
    return tokens[times > 1] if len(three) == 3 and (times > 1).any() else three[0]


def _centred(central: DataFrame, bodies: DataFrame, words: int) -> DataFrame:
    """key, the words of its three central nodes, and the sketch (c0, c1) of its centre."""
    shingles = Shingles(words)

    def run(*packed: pa.Array) -> dict[str, list]:
        made: dict[str, list] = {"c0": [], "c1": []}
        for three in zip(*packed, strict=True):
            sketch = sketch_of(minima(_centre([shingles.of_body(x) for x in three if x.is_valid]), BITS))
            for name, value in zip(made, sketch, strict=True):
                made[name].append(value)
        return made

    found = central
    for name in CENTRAL:
        found = found.join(_bodies(bodies, central.select(name), name), name, "left")
    names = [f"body_{name}" for name in CENTRAL]
    return found.withColumn("c", struct_udf(run, "c0 long, c1 long", CENTRE)(*names)).select("key", *names, "c.*")


FACED = pa.struct([("shared", pa.int64()), ("kids", pa.list_(pa.int64()))])


def _least(shingles: np.ndarray, seed: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` least hashes of a set under one multiplier, or all it has."""
    spread = (_mix(shingles) * seed) >> U64(32)
    return spread if count >= len(spread) else np.partition(spread, count - 1)[:count]


def _face(words: int, percent: int) -> Column:
    """Tokens shared with the pivot, and the buckets to go on to.

    The centre is what two of the three central nodes have: by the rest of the pivot all
    others would differ. Of two linked nodes each has all but a share of 1 - ``percent`` of
    its tokens in common with the other, so of the tokens that the centre lacks as well all
    but that much: far nodes, which have many of those, go on by some of them. Near ones,
    with a share below ``NEAR``, go on by all differences, what they lack of the centre too.
    A partner of a far node may be near by that share: nodes in this margin do both. As far
    nodes they only look for such partners, with which they have ``margin`` in common at least.

    Differences of two linked nodes may overlap little, but the node farther from the
    centre, not linked to the pivot, holds at least about half of the differences of a partner nearer to it.
    ``DRAWS`` least tokens of the partner then miss the common ones with a probability of
    ``MISS`` at most, and so does the other if it draws ``log(MISS) / log(1 - f)`` tokens, f
    being the least share of its own differences that is common: they less the link
    distance. Close outside the link distance that means all.
    Where the pivot itself is far from the centre, as in a bucket of texts with one passage
    in common, nodes may be close to the centre and to each other and not to the pivot:
    those within the link distance of the centre go on to a bucket of their own as well.
    """
    shingles, slack = Shingles(words), max(1 - percent / 100, 1e-9)
    margin = (NEAR - slack) * percent / 100
    draws_for = lambda share: int(np.ceil(np.log(MISS) / np.log1p(-min(share, 1 - MISS))))

    def run(keys: pa.Array, owns: pa.Array, pivots: pa.Array, *central: pa.Array) -> dict[str, list]:
        made: dict[str, list] = {"shared": [], "kids": []}
        at, p, q, near = None, None, None, True
        for key, a, b, *c in zip(keys.to_pylist(), owns, pivots, *central, strict=True):
            x = shingles.of_body(a)
            if key != at:
                p = shingles.of_body(b)
                at, q = key, _centre([shingles.of_body(o) for o in c if o.is_valid])
                shared = len(np.intersect1d(p, q, assume_unique=True))
                near = 100 * shared >= percent * (len(p) + len(q) - shared)
            met = len(np.intersect1d(x, p, assume_unique=True))
            new = np.setdiff1d(x, q, assume_unique=True)
            shared = len(x) - len(new)
            either = len(new) + len(q)
            seed = odd_constants(1, key & 0xFFFFFFFFFFFFFFFF)
            kids = [np.empty(0, dtype=U64)]
            if len(new) >= margin * len(x):
                common = 1 - slack * len(x) / len(new)
                if len(new) < NEAR * len(x):
                    common = max(common, margin * len(x) / len(new))
                kids.append((_least(new, seed, max(FAR_DRAWS, draws_for(common)) if common > 0 else len(new)) << U64(8)) ^ U64(1))
            if len(new) < NEAR * len(x) and shared < either:
                apart, draws = np.setxor1d(x, q, assume_unique=True), DRAWS
                if 100 * met < percent * (len(x) + len(p) - met):
                    least = max(len(apart) - (100 - percent) / percent * len(x), 1)
                    draws = max(DRAWS, draws_for(least / len(apart)))
                kids.append((_least(apart, seed, draws) << U64(8)) ^ U64(2))
            if not near and percent * (either - shared) <= (100 - percent) * len(x):
                kids.append(np.array([3], dtype=U64))
            made["shared"].append(met)
            made["kids"].append((_mix(np.concatenate(kids)) ^ _mix(seed)).view(np.int64))
        return made

    return struct_udf(run, "shared long, kids array<long>", FACED)("key", "body_node", "body_pivot", *(f"body_{name}" for name in CENTRAL))


def _direct(judged: DataFrame) -> DataFrame:
    """Blocks of about BLOCK nodes in which every open node meets all nodes of its bucket.

    Open are those outside the bucket's largest component. With few of them a block is a
    share of that component and all open ones, else two parts of the bucket.
    """
    half = BLOCK // 2
    parts = F.expr(f"CAST(ceil((crowd - if(opens <= {half}, opens, 0)) / {half}) AS int)")
    own = F.pmod(F.xxhash64("node"), F.greatest(F.col("parts"), F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.greatest(F.col("parts"), F.lit(1)) - 1)
    few = F.when(F.col("open") == 1, F.transform(every, lambda p: F.struct(p.alias("p"), p.alias("q")))).otherwise(F.array(F.struct(F.col("own").alias("p"), F.col("own").alias("q"))))
    many = F.transform(F.filter(every, lambda p: p != F.col("own")), lambda p: F.struct(F.least(p, F.col("own")).alias("p"), F.greatest(p, F.col("own")).alias("q")))
    dealt = judged.where(f"opens <= {half} OR crowd <= {WIDE * BLOCK}").withColumn("parts", parts).withColumn("own", own)
    dealt = dealt.select("key", F.explode(F.when(F.col("opens") <= half, few).otherwise(many)).alias("part"), *BUCKET[1:])
    return dealt.withColumn("key", F.xxhash64("key", "part.p", "part.q")).select(*BUCKET)


def _merged(links: list[DataFrame]) -> list[DataFrame]:
    """The components of written tables of links, which go, as one table of links (a, b): b is the least node of that of a."""
    label = components(reduce(DataFrame.unionByName, links))
    for done in links:
        drop_table(done)
    return [label.select(F.col("node").alias("a"), F.col("label").alias("b"))]


def _opened(judged: DataFrame, label: DataFrame) -> DataFrame:
    """``judged`` with the component ``of`` each node, for buckets of more than one.

    ``crowd`` are the nodes of the bucket, and ``opens`` those outside its largest component (``open``).
    """
    placed = judged.join(label.select(F.col("a").alias("node"), F.col("b").alias("of")), "node", "left").withColumn("of", F.coalesce("of", "node"))
    parts = placed.groupBy("key", "of").agg(F.count(F.lit(1)).alias("times"))
    buckets = parts.groupBy("key").agg(F.sum("times").alias("crowd"), F.max(F.struct("times", "of")).alias("most"))
    buckets = buckets.select("key", "crowd", F.expr("crowd - most.times").alias("opens"), F.col("most.of").alias("_most")).where("opens > 0")
    return placed.join(buckets, "key").withColumn("open", F.expr("CAST(of <> _most AS int)")).drop("_most")


def candidate_links(nodes: DataFrame, source: DataFrame, words: int, percent: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Screened pairs of the small first buckets, confirmed links of all others (or what connects the same nodes), and the words of all nodes in either; written tables.

    Whatever is compared later is in a pair, alive or in a large bucket at the first level.
    """
    trees = F.expr(f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, path[t]))")
    rows = nodes.select(F.explode(trees).alias("key"), "node", "n", "s0", "s1", F.col("node").alias("of"))
    pairs, links, written, bodies, total = None, [], None, None, nodes.count()
    while True:
        crowd = rows.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"), F.expr("min(of) < max(of)").alias("several")).where("several").drop("several")
        shared = materialise(rows.join(crowd, "key"), "buckets")
        if written is not None:
            drop_table(written)
        if pairs is None:
            pairs, most = materialise(_small_pairs(shared.where(f"crowd <= {SMALL}"), percent), "pairs"), BLOCK
            small = shared.where(f"crowd > {SMALL} AND crowd <= {BLOCK}").select(*BUCKET)
        else:
            # what is in one component is known by now, so no pivot is needed where blocks do
            most, dealt = WIDE * BLOCK, shared.where(f"crowd > {BLOCK} AND crowd <= {WIDE * BLOCK}")
            small = shared.where(f"crowd <= {BLOCK}").select(*BUCKET).unionByName(_direct(dealt.withColumns({"opens": F.col("crowd"), "open": F.lit(1)})))
        release(nodes.sparkSession)
        alive = _alive(small, percent)
        large = shared.where(f"crowd > {most}").drop("crowd", "of")
        if bodies is None:
            asked = [pairs.select("a"), pairs.select("b"), alive.select("node"), large.select("node")]
            bodies = _packed(source, reduce(DataFrame.unionByName, [x.toDF("node") for x in asked]).distinct())
            release(nodes.sparkSession)
        links += _block_links(alive, bodies, total, words, percent)
        if large.isEmpty():
            drop_table(shared)
            return pairs, links, bodies
        centres = materialise(_centred(materialise(_central(large), "central"), bodies, words), "centres")
        off = F.struct((F.bit_count(F.expr("s0 ^ c0")) + F.bit_count(F.expr("s1 ^ c1"))).alias("off"), "node", "n")
        nearest = large.join(centres.select("key", "c0", "c1"), "key").groupBy("key").agg(F.min(off).alias("p"))
        pivots = materialise(nearest.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("p_n")), "pivots")
        met = materialise(large.join(pivots, "key").where("node <> pivot").select("key", "node", "n", "s0", "s1", "pivot", "p_n"), "met")
        drop_table(shared)
        release(nodes.sparkSession)
        facing = materialise(pivots.join(_bodies(bodies, pivots.select("pivot"), "pivot"), "pivot").select("key", "body_pivot"), "facing")
        judged = []
        for part in _slices(met, "node", total):
            faced = part.join(_bodies(bodies, part.select("node"), "node"), "node").join(centres.drop("c0", "c1"), "key").join(facing, "key")
            faced = faced.select("key", "node", "n", "s0", "s1", "pivot", "p_n", _face(words, percent).alias("f"))
            judged.append(materialise(faced.withColumn("linked", F.expr(f"100 * f.shared >= {percent} * (n + p_n - f.shared)")), "faced"))
            release(nodes.sparkSession)
        judged = reduce(DataFrame.unionByName, judged)
        drop_table(met)
        drop_table(pivots)
        drop_table(centres)
        drop_table(facing)
        links.append(materialise(judged.where("linked").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "links"))
        links = _merged(links)
        opened = materialise(_opened(judged.drop("pivot", "p_n", "linked"), links[0]), "opened")
        drop_table(judged)
        release(nodes.sparkSession)
        links += _block_links(_alive(_direct(opened), percent), bodies, total, words, percent)
        rows = written = materialise(opened.where(f"opens > {BLOCK // 2} AND crowd > {WIDE * BLOCK}").select(F.explode("f.kids").alias("key"), "node", "n", "s0", "s1", "of"), "kids")
        drop_table(opened)
        del crowd, shared, small, alive, large, centres, nearest, pivots, facing, met, faced, judged, opened
        release(nodes.sparkSession)


def _node(seed: int) -> Column:
    """The number of a row as a node, from its id and two hashes of its text."""
    return F.xxhash64(F.lit(seed), "doc_id", "_text", "_other")


def _grouped(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """doc_id, n, component_id, and _text (a hash of the text), a row per row of ``docs``."""
    on_workers(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    try:
        return _visited(source, words, percent)
    except Changed:
        return _visited(materialise(source, "documents"), words, percent)


def _visited(source: DataFrame, words: int, percent: int) -> DataFrame:
    """``_grouped`` of documents (doc_id, text) that are read twice."""
    spark = source.sparkSession
    source = source.withColumns({"_text": F.xxhash64("text"), "_other": F.xxhash64(F.lit(1), "text")})
    signed = materialise(source.select("doc_id", F.monotonically_increasing_id().alias("row"), "_text", "_other", sign(F.col("text"), words).alias("s")).select("doc_id", "row", "_text", "_other", "s.*"), "signed")
    full = signed.where("n > 0")
    for seed in count():
        firsts = [F.min("row").alias("row"), F.min_by(_node(seed), "row").alias("node"), F.min("doc_id").alias("least")]
        classes = materialise(full.groupBy("digest").agg(*firsts, F.count(F.lit(1)).alias("copies")), "classes")
        if classes.groupBy("node").count().where("count > 1").isEmpty():
            break
        drop_table(classes)
    nodes = materialise(full.join(classes.select("row"), "row", "left_semi").select(_node(seed).alias("node"), "n", "s0", "s1", "path"), "nodes")
    release(spark)
    total = nodes.count()
    try:
        asked, links, bodies = candidate_links(nodes, source.select(_node(seed).alias("node"), "text"), words, percent)
    except Changed:
        drop_table(signed)
        drop_table(classes)
        raise
    finally:
        drop_table(nodes)
    release(spark)
    nearest = materialise(asked.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "nearest")
    links += _confirmed(nearest, bodies, total, words, percent)
    links = _merged(links)
    label = links[0].select(F.col("a").alias("node"), F.col("b").alias("label"))
    release(spark)
    of = lambda k: label.select(F.col("node").alias(k), F.col("label").alias(f"of_{k}"))
    rest = asked.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    rest = materialise(rest, "rest")
    drop_table(asked)
    release(spark)
    second = reduce(DataFrame.unionByName, _confirmed(rest, bodies, total, words, percent))
    drop_table(bodies)
    label = _merged([*links, second])[0].select(F.col("a").alias("node"), F.col("b").alias("label"))
    release(spark)

    placed = materialise(classes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    placed = spread_join(placed, least, "label", placed.count()).select("digest", "component_id", F.col("copies").alias("_size"))
    whole = spread_join(full.select("doc_id", "n", "_text", "digest"), placed, "digest", full.count())
    empty = signed.where("n = 0").select("doc_id", "n", "_text", F.col("doc_id").alias("component_id"))
    return whole.select("doc_id", "n", "_text", "component_id").unionByName(empty)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per row of ``docs``."""
    found = _grouped(docs, doc_id, text, words, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of the component of their text."""
    gone = _grouped(docs, doc_id, text, words, percent).where("NOT (doc_id <=> component_id)").select(F.col("doc_id").alias("_gone"), F.col("_text").alias("_gone_text")).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("_gone")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("_gone_text")), "left_anti")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, for shingles of four words."""
    return groups(table(spark, sf_dir, "documents"), words=4)


def oracle(words: int = 4, percent: int = 80) -> str:
    """All pairs that share a shingle, in DuckDB's SQL: for small tables."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""

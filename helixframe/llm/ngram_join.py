"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles.  Two documents link when their Jaccard similarity is at least the
threshold.  All documents order shingles alike, rare ones first.  Two that link share alpha = threshold / (1 + threshold) of
their summed sizes, so the first l shingles that they share stand among the first ``size - alpha + l`` of both: a larger l
means longer prefixes and a stricter candidate test.  Each document chooses its own l by estimated cost and emits the
prefix that its smallest possible partner asks for; a pair counts the smaller l, and shared places up to that for its own sizes.

Steps, each over all rows:

1. One Arrow pass gives each document's set size and a digest of its set.  Rows with equal sets form a class.
   The same pass counts shingles by lossy counting; only the order of shingles depends on these counts, never the result.
2. A second pass over class representatives orders each set and emits its prefix.
3. Stars: each representative is verified against the hub that shares most of its first postings.  The verified pairs form a
   forest that already joins large groups of near copies without pairs inside them.  Turns of stars go on while they help.
4. Postings that still span several trees yield the remaining pairs across trees, by shingle and class of sizes; those with l
   shared first postings and enough shared ones in their whole prefixes are verified.  Pairs inside one tree cannot change a component and are never made.  A document with more
   shingles of its own than a link allows has none of its group's common shingles at the places that count, and so
   meets nobody there.
5. Verification intersects whole sets, rebuilt from the text for the documents that take part.

Nulls and edge cases: a null or blank text has the empty set (size 0) and links with nothing; fewer words than the shingle
length give one shingle of the whole sequence; rows with a null id keep their row with a null component; rows that share an
id are one node of the graph; repeated rows give repeated output rows; texts of any length are read whole; equal sizes and counts
are told apart by id, which changes no result; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, arrow_map, discard, mix64, pieces, shingle_hashes, stored, texts_of, within

WORDS, THRESHOLD = 5, 0.75
#: Shingles kept in the order table; the rest count as rare.  A bound on what is collected and broadcast (8 bytes each), not on results.
FREQUENT = 400_000
#: Pairs that the join across trees may look at for each posting before another turn of stars is tried.
PAIRS_PER_POSTING = 20
#: Most turns of stars before pairs are made.
STAR_TURNS = 6
#: Ratio of the sizes in one class of the join across trees, and parts that a hub's partners are dealt to.
SIZE_CLASS, SALTS = 1.05, 64
#: Edges that one task joins into components (16 bytes each).
FEW_EDGES = 200_000
#: Largest l tried, and the cost of verifying a candidate in units of reading one posting.
MOST_MATCHES, VERIFY_COST = 8, 40.0


def _sets(texts: list[bytes], k: int):
    """Yields (index, sorted distinct shingle hashes) for each text."""
    for i, j in pieces(texts):
        w = Words(texts[i:j])
        runs = shingle_hashes(w.hash, k)
        for t in range(j - i):
            a, n = int(w.first[t]), int(w.n[t])
            if n >= k:
                yield i + t, np.unique(runs[a : a + n - k + 1])
            elif n:
                with np.errstate(over="ignore"):
                    acc = np.uint64(n)
                    for h in w.hash[a : a + n]:
                        acc = mix64(np.array([acc ^ h], np.uint64))[0]
                yield i + t, np.array([acc], np.uint64)
            else:
                yield i + t, np.empty(0, np.uint64)


def _profile(k: int, flush: int = 2_000_000):
    """Arrow function: a row (0, id, size, digest halves) for each document, and (1, shingle, count, ...) for counts of 2 and more among some distinct sets."""
    schema = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def counts(held):
        values, n = np.unique(np.concatenate(held), return_counts=True)
        values, n = values[n > 1], n[n > 1]
        zero = np.zeros(len(values), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), np.int8)), pa.array(values.view(np.int64)), pa.array(n), pa.array(zero), pa.array(zero)], schema=schema)

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            ns, keys = np.zeros(len(texts), np.int64), np.zeros((len(texts), 2), np.int64)
            for i, s in _sets(texts, k):
                ns[i] = len(s)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                keys[i] = np.frombuffer(digest, np.int64)
                if digest not in seen and len(s):
                    seen.add(digest)
                    held.append(s)
                    size += len(s)
                    if size >= flush:
                        yield counts(held)
                        held, size, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int8)), ids, pa.array(ns), pa.array(keys[:, 0]), pa.array(keys[:, 1])], schema=schema)
        if held:
            yield counts(held)

    return run


def _alike(threshold: float) -> float:
    """Share of the summed sizes of two sets that their intersection reaches where their similarity reaches the threshold."""
    return threshold / (1 + threshold)


def _matches(n: int, need: int, df: np.ndarray) -> int:
    """The l of least estimated cost, against sets that have to share ``need`` shingles: postings read, and candidates (at most sum(df - 1) / l of them) verified."""
    base, most = n - need, min(MOST_MATCHES, need)
    read = np.cumsum(df[: base + most])[base : base + most]
    made = read - np.arange(base + 1, base + most + 1)
    return 1 + int(np.argmin(read + VERIFY_COST * made / np.arange(1, most + 1)))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def _prefixes(k: int, threshold: float, frequent):
    """Arrow function: each document's size, l, mean log frequency of its shingles, and prefix: places and shingles, those known to stand in several sets apart from the others."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("need", pa.int32()), ("common", pa.float32()), ("known", pa.list_(pa.int64())), ("rare", pa.list_(pa.int64()))])

    def run(batches):
        known, rank_df = frequent.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            out = ([], [], [], [], [], [])
            for i, s in _sets(texts, k):
                n = len(s)
                if not n:
                    continue
                df = np.ones(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    df = np.where(known[at] == s, rank_df[at], 1)
                order = np.lexsort((s, df))
                need = math.ceil(round(threshold * n, 6))
                many = _matches(n, math.ceil(round(2 * n * _alike(threshold), 6)), df[order])  # by sets of its own size
                front = order[: n - need + many]
                prefix, often = s[front].view(np.int64), df[front] > 1
                for part, value in zip(out, (ids[i], n, many, float(np.log(df).sum() / n), prefix[often], prefix[~often]), strict=True):
                    part.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.float32()), _lists(out[4]), _lists(out[5])], schema=schema)

    return run


def _packed(k: int):
    """Arrow function: each document's whole set as an array of longs."""
    schema = pa.schema([("id", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([s.view(np.int64) for _, s in _sets(texts_of(batch.column(1)), k)])], schema=schema)

    return run


def _with_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs (a, b) with those of facts (id, f) as fa and fb.

    A document that stands in many pairs as ``a`` is a hub: its facts are copied once for each of up to SALTS parts of its partners,
    which spreads them over tasks, instead of all theirs meeting at the hub's.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("part"))
    right = dealt.select("a", "part").distinct().join(facts.select(F.col("id").alias("a"), F.col("f").alias("fa")), "a")
    return dealt.join(facts.select(F.col("id").alias("b"), F.col("f").alias("fb")), "b").join(right, ["a", "part"]).drop("part")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _promising(pairs: DataFrame, postings: DataFrame, threshold: float) -> DataFrame:
    """Those (a, b) of pairs, distinct, that share as many postings of their whole prefixes as two documents need to link: what the prefixes
    do not show lies behind the one that ends first."""
    fact = F.struct(F.first("n").alias("n"), F.first("l").alias("l"), F.collect_list("gram").alias("grams")).alias("f")
    facts = postings.join(_ids(pairs), "id", "left_semi").groupBy("id").agg(fact)
    both = _with_facts(pairs, facts)
    n = F.col("fa.n"), F.col("fb.n")
    alpha = F.ceil(F.greatest((n[0] + n[1]) * _alike(threshold), F.greatest(*n) * threshold) - 1e-6)
    behind = F.greatest(*(F.ceil(F.col(f"{f}.n") * threshold - 1e-6) - F.col(f"{f}.l") for f in ("fa", "fb")))
    return both.where(F.size(F.array_intersect("fa.grams", "fb.grams")) >= alpha - behind).select("a", "b")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Those (a, b) of pairs, distinct ids, whose whole sets reach the threshold; stored."""
    sets = stored(arrow_map(within(texts, _ids(pairs), "id", "left_semi"), _packed(k), "id long, f array<long>"), "grams")
    both = F.size(F.array_intersect("fa", "fb")).cast("long")
    reach = both * 1_000_000 >= math.floor(threshold * 1_000_000) * (F.size("fa") + F.size("fb") - both)
    out = stored(_with_facts(pairs, sets).where(reach).select("a", "b"), "linked")
    discard(sets)
    return out


def _join_edges(batches):
    """Arrow function over all edges (u, v): (id, least id of its component)."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while above[top] != top:
            top = above[top]
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            above.setdefault(u, u)
            above.setdefault(v, v)
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    ids = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "root"])


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(id, root): the least id reachable over the edges (a, b), for every id that stands in one; stored.

    Up to FEW_EDGES edges are joined by one task, which spares a dozen jobs.  More take alternating large-star and small-star rounds; each is
    written to the shared folder, and the edges never outnumber the first ones.  A node's least neighbour comes back to its edges
    by SALTS parts of them, so that a node of many edges is no task's alone.
    """

    def spread(rows: DataFrame, least: DataFrame) -> DataFrame:
        """rows (u, v) with the m that least (u, m) gives their u."""
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        parts = dealt.select("u", "part").distinct().join(least, "u")
        return dealt.join(parts, ["u", "part"]).drop("part")

    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name)
    if edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        out = stored(arrow_map(edges.coalesce(1), _join_edges, "id long, root long"), name)
        discard(edges)
        return out
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread(large, low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        after = stored(small, name)
        sums = [df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first() for df in (edges, after)]
        discard(edges)
        edges = after
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError("connected components did not settle")
    # After the last round each edge leads from a node to its root.
    out = stored(edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()), name)
    discard(edges)
    return out


def _reach(x: str, y: str, threshold: float) -> Column:
    """Whether a posting that two documents share may be one of their first l, if they link.

    They share alpha = threshold / (1 + threshold) of their summed sizes, and threshold of the larger one, so alpha - l + 1 shared shingles stand at the l-th one's place or behind it.
    """
    n = F.col(f"n_{x}"), F.col(f"n_{y}")
    alpha = F.ceil(F.greatest((n[0] + n[1]) * _alike(threshold), F.greatest(*n) * threshold) - 1e-6)
    most = F.least(f"l_{x}", f"l_{y}")
    return (F.col(f"at_{x}") <= F.col(f"n_{x}") - alpha + most - 1) & (F.col(f"at_{y}") <= F.col(f"n_{y}") - alpha + most - 1)


def _enough(rows: DataFrame) -> DataFrame:
    """(a, b, shared) of the pairs of rows (a, b, l) that stand l times."""
    return rows.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("l").alias("l")).where("shared >= l").select("a", "b", "shared")


def _stars(placed: DataFrame, threshold: float, turn: int) -> DataFrame:
    """(a, b): each document with the hub of another tree that it shares most of its first postings with.

    Among the postings of a shingle and a band of sizes, one document is the hub: in the first turn the one whose shingles are
    most common, which in a group of near copies is the one nearest to their origin, later the one of least hash.
    """
    band = F.floor(F.log("n") / -math.log(threshold)).cast("int")
    fields = ("id", "n", "l", "at", "tree")
    first = F.xxhash64("id_b", F.lit(turn)).cast("double") if turn else -F.col("common").cast("double")
    shares = placed.select("gram", band.alias("band"), "common", *(F.col(c).alias(f"{c}_b") for c in fields))
    hub = F.min(F.struct(first.alias("h"), *(F.col(f"{c}_b").alias(c) for c in fields))).alias("hub")
    hubs = shares.groupBy("gram", "band").agg(hub, F.min("tree_b").alias("t0"), F.max("tree_b").alias("t1")).where("t1 > t0")
    hubs = hubs.select("gram", "band", *(F.col(f"hub.{c}").alias(f"{c}_a") for c in fields))
    met = shares.join(hubs, ["gram", "band"]).where("tree_a != tree_b").where(_reach("a", "b", threshold))
    tried = _enough(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.least("l_a", "l_b").alias("l")))
    return tried.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")


def _open(postings: DataFrame, trees: DataFrame, threshold: float) -> DataFrame:
    """postings with the tree of their document, of the shingles that still stand in several trees and in a place that counts for documents of its size; stored.

    Trees only grow together, so the others are done with for good.
    """
    placed = postings.drop("tree").join(trees, "id", "left").withColumn("tree", F.coalesce("root", "id")).drop("root")
    room = F.col("n") + F.col("l") - 1 - F.col("at")
    own = F.ceil(2 * F.col("n") * _alike(threshold) - 1e-6) <= room
    mixed = placed.groupBy("gram").agg(F.min("tree").alias("t0"), F.max("tree").alias("t1"), F.max(own).alias("own")).where("t1 > t0 and own").select("gram")
    return stored(placed.join(mixed, "gram", "left_semi"), "open")


def _across(placed: DataFrame, threshold: float) -> DataFrame:
    """(gram, class, side, id, n, l, at, tree): where documents of different trees may meet; stored.

    Of two documents, the smaller one stands with its class of sizes (side 0), at its places that reach a document of its size; the
    larger one asks each class that its place reaches (side 1).  A key whose documents are all of one tree goes.
    """
    step = math.log(SIZE_CLASS)
    cls = lambda n: F.floor(F.log(n) / step + 1e-9).cast("int")
    n, room = F.col("n"), F.col("n") + F.col("l") - 1 - F.col("at")  # room: the most they may have to share
    own = placed.where(F.ceil(2 * n * _alike(threshold) - 1e-6) <= room).withColumn("class", cls(n)).withColumn("side", F.lit(0))
    least, most = cls(F.ceil(n * threshold - 1e-6)), cls(F.least(n, F.floor(room / _alike(threshold) + 1e-6) - n))
    asks = placed.where(F.floor(room / _alike(threshold) + 1e-6) - n >= 1).withColumn("class", F.explode(F.when(most >= least, F.sequence(least, most)))).withColumn("side", F.lit(1))
    columns = ["gram", "class", "side", "id", "n", "l", "at", "tree"]
    stands = own.groupBy("gram", "class").agg(F.min("tree").alias("t0"), F.max("tree").alias("t1"))
    asked = asks.select(columns).join(stands, ["gram", "class"]).where("t0 != tree or t1 != tree").drop("t0", "t1")
    met = asked.groupBy("gram", "class").agg(F.lit(1).alias("met")).select("gram", "class")
    return stored(asked.unionByName(own.select(columns).join(met, ["gram", "class"], "left_semi")), "across")


def _main_trees(open_: DataFrame) -> DataFrame:
    """(gram, class, main, most, n): the tree with most rows of each key, their number, and that of all."""
    trees = open_.groupBy("gram", "class", "tree").agg(F.count("*").alias("m"))
    return trees.groupBy("gram", "class").agg(F.max_by("tree", F.struct("m", "tree")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("n"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of docs; see the module text.  The result is a table in the shared folder, ``discard`` removes it."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = stored(arrow_map(texts, _profile(words), "kind byte, id long, n long, k1 long, k2 long"), "sets")
    rows = seen.where("kind = 0").select("id", "n", "k1", "k2")
    # A class may hold a third of all rows: its representative comes to its rows in up to SALTS parts.
    dealt = rows.where("n > 0 and id is not null").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    classes = stored(dealt.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    keys = dealt.select("k1", "k2", "part").distinct().join(classes, ["k1", "k2"])
    members = stored(dealt.join(keys, ["k1", "k2", "part"]).select("id", "n", "part", "rep", "copies"), "members")
    reps = classes.select(F.col("rep").alias("id"))

    top = seen.where("kind = 1").groupBy(F.col("id").alias("gram")).agg(F.sum("n").alias("df")).where("df > 2").orderBy(F.desc("df"), "gram").limit(FREQUENT).toPandas()
    known = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], top["df"].to_numpy(np.int64)[order]))

    # Texts of representatives only.  An id that comes with several texts stays if one of its sets has it as representative.
    copies = stored(members.where("copies > 1 and id > rep").select("id").distinct().join(reps, "id", "left_anti"), "copies")
    own = within(texts.where("id is not null"), copies, "id", "left_anti")
    prefixes = stored(arrow_map(own, _prefixes(words, threshold, frequent), "id long, n long, l int, common float, known array<long>, rare array<long>"), "prefixes")

    # Postings of shingles that stand in several prefixes.  Frequent shingles are known to; only the others have to meet
    # for that, so that no group in the window is large.  ``at``: place in the document's order.
    head = ("id", "n", "l", "common")
    rare = prefixes.select("id", F.posexplode("rare").alias("at", "gram")).withColumn("df", F.count("*").over(Window.partitionBy("gram"))).where("df > 1").drop("df")
    rare = rare.join(prefixes.select(*head), "id").select(*head, "at", "gram")
    often = prefixes.select(*head, F.size("rare").alias("r"), F.posexplode("known").alias("k", "gram")).select(*head, (F.col("r") + F.col("k")).alias("at"), "gram")
    postings = stored(rare.unionByName(often), "postings")
    discard(prefixes)

    # Stars, in turns, while too many pairs could meet across trees for the number of postings and trees still grow together.
    forest, trees, open_, across = [], None, postings.withColumn("tree", F.col("id")), None
    total, left = postings.count(), None
    for turn in range(STAR_TURNS):
        tried = stored(_promising(_stars(open_, threshold, turn), postings, threshold), "stars")
        forest.append(_linked(tried, own, words, threshold))
        discard(tried)
        if trees is not None:
            discard(trees)
        trees = components(reduce(DataFrame.unionByName, forest), "trees")
        now = _open(open_, trees, threshold)
        if turn:
            discard(open_)
            discard(across)
        open_, across = now, _across(now, threshold)
        was, left = left, _main_trees(across).agg(F.sum((F.col("n") - F.col("most")) * F.col("n")).alias("x")).first()["x"] or 0
        if left <= PAIRS_PER_POSTING * total or (was is not None and left > 0.9 * was):
            break

    # Across trees: a document of another tree than a key's main one meets all of that key, so no two of the main tree meet.
    fields = ("id", "n", "l", "at", "tree", "side")
    a, b = (across.select("gram", "class", *(F.col(c).alias(f"{c}_{side}") for c in fields)) for side in "ab")
    others = a.join(_main_trees(across).select("gram", "class", "main"), ["gram", "class"]).where("tree_a != main").drop("main")
    both = others.join(b.join(others.select("gram", "class").distinct(), ["gram", "class"], "left_semi"), ["gram", "class"])
    larger = (F.struct("n_a", "id_a") < F.struct("n_b", "id_b"))  # the side 0 of a pair is the smaller
    once = F.when(F.col("side_a") == 0, larger).otherwise(~larger) & (F.col("side_a") != F.col("side_b")) & (F.col("tree_a") != F.col("tree_b"))
    met = both.where(once).where(_reach("a", "b", threshold)).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.least("l_a", "l_b").alias("l"), "gram").distinct()
    able = stored(_enough(met).select("a", "b"), "able")
    pairs = stored(_promising(able, postings, threshold), "pairs")
    forest.append(_linked(pairs, own, words, threshold))

    # An id whose rows hold several sets joins their classes.
    several = members.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("id")
    tied = members.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a != b").distinct()
    roots = components(reduce(DataFrame.unionByName, [*forest, tied]), "roots")

    found = members.select("rep", "part").distinct().join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "part", F.coalesce("root", "rep").alias("root"))
    placed = members.join(found, ["rep", "part"]).select("id", "n", F.col("root").alias("component_id"))
    others = rows.where("not (n > 0 and id is not null)").select("id", "n", F.col("id").alias("component_id"))
    out = stored(placed.unionByName(others).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"), "groups")
    for table in (seen, classes, members, copies, postings, trees, open_, across, able, pairs, roots, *forest):
        discard(table)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs with one document of each near-duplicate group: the one of least id.

    Documents without words are no copies of each other and stay, as do rows with a null id.  Of rows that repeat an id and its text one
    stays; an id's rows with different texts share their fate.
    """
    groups = ngram_jaccard_join(docs, id_col, text_col, **params)
    gone = stored(groups.where(F.col(id_col) > F.col("component_id")).select(id_col).distinct(), "copies")
    discard(groups)
    kept = within(docs, gone, id_col, "left_anti")
    worded = F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    key = [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text")]
    repeated = stored(docs.where(worded).groupBy(*key).count().where("count > 1").select("__id", "__text"), "repeated")
    if repeated.isEmpty():
        return kept
    marked = kept.select(F.struct(*docs.columns).alias("__row"), F.when(worded, key[0]).alias("__id"), key[1])
    first = marked.join(repeated, ["__id", "__text"]).groupBy("__id", "__text").agg(F.first("__row").alias("__row"))
    return marked.join(repeated, ["__id", "__text"], "left_anti").select("__row.*").unionByName(first.select("__row.*"))

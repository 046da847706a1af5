"""Operator 10, near duplicates by MinHash with tensored banding.

A document is the set of its two-word shingles. ``COLLECTIONS`` small collections of ``ROWS`` minhashes each are
computed; a table key combines a pair of collections, so C * (C - 1) / 2 tables of 2 * ROWS hashes come from
C * ROWS minhashes. Two sets of similarity s meet in some table if two collections agree: with 16 collections
of 3, at s = 0.8 that fails for fewer than 2 in 10,000 pairs, and a component usually has many links.

Steps:

1. One narrow pass computes per document the size of its set, a digest of the set and the collections. Documents
   with one set are one node (the smallest doc_id) from here on: copies never meet in a table.
2. Tables: a map-side partial aggregate finds the keys that two nodes share; a bitmap filter drops other keys
   before they are shuffled again. Since a node has a row in every table, no key holds more than one row in 120.
3. Rounds: a key whose members are all in one component is done. In the others a leader is drawn from the key's
   main (largest) component, and members of other components are compared with it on full sets, each node with the
   LEADERS that it shares most keys with. Links merge components. Members never pair with one another, so a large
   group costs a few comparisons per member and round, and after the first rounds nearly all members of a key are
   in its main component. Rounds end when step 4 has FEW pairs a row at most, or when they stop helping.
4. Keys that still hold several components get the pairs across components compared, once each, so no link that
   a table shows is lost to the choice of leaders. Members outside the main component meet the others; those
   inside never meet one another. Two exact bounds keep edited copies of one text that are too far off from
   meeting all others: a shingle that no other member of these keys has is in no intersection, and the bits in
   which two parity sketches differ (a bit per hash value: whether the set has an odd number of shingles there)
   are at most the shingles in which the sets differ.

A node is a distinct set and has a number of its own, whatever the doc_ids of its rows; a component's name is
the smallest doc_id in it.

Defined cases: null, empty and word-less texts have an empty set and no links; one word is a set of its own;
rows that repeat a doc_id with different texts are different documents of one name; a null doc_id is nobody's
smallest, a component of nulls has a null name and its rows stay; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import drop_stored, left_join_groups, may_hit, stored, table
from .components import components

COLLECTIONS, ROWS, SEED = 16, 3, 7
PAIRS = [(i, j) for i in range(COLLECTIONS) for j in range(i + 1, COLLECTIONS)]  # of the tables, in order
PERCENT = 80  # least similarity
WIDTH = 2  # words of a shingle
ROUNDS, LEADERS = 5, 3  # most rounds with leaders, and leaders that a node is compared with in one
FEW, HELP = 8, 0.8  # pairs a row that end the rounds; a round helps if it leaves less than this share of the pairs
SKETCH = 16  # longs of a parity sketch; sets of more shingles than its bits have a second one of two bits a shingle at least
CROWD = 32  # nodes at a main component from which sketches are carried; results don't depend on it
CACHE_WORDS = 200_000  # words whose hash a worker keeps

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * _M[2]
    x = (x ^ (x >> np.uint64(29))) * _M[3]
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text; fewer words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and just the contract's white space
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = _mix(h * _M[0] + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    n = COLLECTIONS * ROWS
    return r.integers(0, 1 << 64, (n, 1), np.uint64) | np.uint64(1), r.integers(0, 1 << 64, (n, 1), np.uint64)


def collections_of(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """COLLECTIONS numbers, each made of ROWS minhashes."""
    low = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[at : at + 4096] * a + b).min(1))
    out = np.zeros(COLLECTIONS, np.uint64)
    for part in low.reshape(COLLECTIONS, ROWS).T:
        out = _mix(out * _M[0] + part)
    return out.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text: with doc_id, it tells rows apart), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _row() -> Column:
    return F.xxhash64("doc_id", "mark")


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark, n, digest (of the set; null if empty), sub (array of collections)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients()
        for batch in batches:
            n, digest, sub = [], [], []
            for t in batch["text"]:
                s = shingle_set(t, width)
                n.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                sub.append(collections_of(s, a, b) if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "mark": batch["mark"], "n": n, "digest": digest, "sub": sub}).astype({"doc_id": "Int64"})
        _hashes.clear()

    return _texts(docs).mapInPandas(run, "doc_id long, mark long, n long, digest binary, sub array<long>")


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of shingles per hash value modulo ``bits`` (a power of two), as longs."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide(s: np.ndarray) -> np.ndarray:
    return sketch(s, 1 << (2 * len(s) - 1).bit_length()) if len(s) > SKETCH * 64 else np.zeros(0, np.int64)


def full_sets(docs: DataFrame, nodes: DataFrame, n_nodes: int, width: int = WIDTH) -> DataFrame:
    """node, set (array of long), narrow and wide (its sketches) of ``nodes`` (node, digest, row: hash of one of its rows). Only those rows are read again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            yield pd.DataFrame({"digest": [_digest(s) for s in sets], "set": [s.view(np.int64) for s in sets], "narrow": [sketch(s, SKETCH * 64) for s in sets], "wide": [_wide(s) for s in sets]})
        _hashes.clear()

    near = may_hit(_texts(docs).withColumn("row", _row()), nodes.select("row"), F.col("row"), n_nodes)
    sets = near.select("text").mapInPandas(run, "digest binary, set array<long>, narrow array<long>, wide array<long>")
    return sets.join(nodes.select("node", "digest"), "digest").dropDuplicates(["node"]).drop("digest")


def verified(pairs: DataFrame, sets: DataFrame, n_nodes: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose full sets are similar enough. Sets of nodes in no pair are not shuffled."""
    n = 2 * pairs.count()
    if n * 2 < n_nodes:
        sets = may_hit(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")), F.xxhash64("node"), n)
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("common") * 100 >= PERCENT * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _close(na: str, nb: str):
    """Sizes alone allow the similarity."""
    return F.least(na, nb) * 100 >= PERCENT * F.greatest(na, nb)


def table_keys(nodes: DataFrame) -> DataFrame:
    """node, n, table, key: one row per table, a table for each pair i < j of collections in order."""
    return nodes.select("node", "n", F.posexplode(F.array(*[F.xxhash64(F.lit(i * 100 + j), F.col("sub")[i], F.col("sub")[j]) for i, j in PAIRS])).alias("table", "key"))


def near_links(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, component) of the nodes that are linked; ``nodes`` has node, n, digest, row, sub."""
    keys = table_keys(nodes)
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "minhash-shared")
    members = stored(may_hit(keys, shared, F.col("key"), shared.count()).join(shared, "key").select("key", "table", "node", "n"), "minhash-members")
    in_tables = stored(members.select("node").distinct().join(nodes.select("node", "digest", "row"), "node"), "minhash-nodes")
    n_nodes = in_tables.count()
    sets = stored(full_sets(docs, in_tables, n_nodes, width), "minhash-sets")
    labels = tested = before = None
    for turn in range(ROUNDS + 1):
        members, old = stored(_mixed(members, labels), "minhash-mixed"), members
        drop_stored(old)
        out = F.col("component") != F.col("main")
        rows, left = members.agg(F.count("*"), F.coalesce(F.sum(F.when(out, F.col("m"))), F.lit(0))).first()
        if turn == ROUNDS or turn and (left <= FEW * rows or left > HELP * before):
            break
        before = left
        # the first leader is the same in all keys that share it; later ones are drawn for each key anew
        scramble = F.lit(0).cast("long") if turn == 0 else F.xxhash64("key", F.lit(turn))
        lead = members.where("component = main").groupBy("key").agg(F.min(F.struct(F.col("node").bitwiseXOR(scramble).alias("x"), "node", "component", "n")).alias("l"))
        lead = lead.select("key", F.col("l.node").alias("leader"), F.col("l.component").alias("leader_component"), F.col("l.n").alias("leader_n"))
        pairs = members.join(lead, "key").where("component <> leader_component").where(_close("n", "leader_n"))
        pairs = pairs.groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("shared"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        best = F.row_number().over(W.partitionBy("a").orderBy(F.col("shared").desc(), "b"))
        now = stored(pairs.withColumn("r", best).where(F.col("r") <= LEADERS).select("a", "b"), "minhash-candidates")
        tested = now if tested is None else tested.unionByName(now)
        labels = _merged(labels, verified(now, sets, n_nodes))
    if rows:  # keys of several components: the pairs across them, once, in the first table where they meet
        bounds = _bounds(members, sets, n_nodes)
        able = members.join(bounds, ["main", "node"]).join(nodes.select("node", "sub"), "node")
        able = stored(able, "minhash-across")
        cross = stored(_across(able), "minhash-cross")
        labels = _merged(labels, verified(cross, sets, n_nodes))
        for frame in (able, cross, bounds):
            drop_stored(frame)
    for frame in (sets, members, shared, in_tables, *([tested] if tested is not None else [])):
        drop_stored(frame)
    return labels


def _bounds(members: DataFrame, sets: DataFrame, n_nodes: int) -> DataFrame:
    """(main, node, s, narrow, wide) of the nodes that may have a link: s shingles that some other node of ``members``
    has, too, and the sketches (null at main components of few nodes)."""
    at = stored(members.groupBy("main", "node").agg(F.first("n").alias("n")), "minhash-at-main")
    nodes = stored(at.groupBy("node").agg(F.first("n").alias("n")), "minhash-mixed-nodes")
    n = nodes.count()
    near = may_hit(sets, nodes, F.xxhash64("node"), n) if n * 2 < n_nodes else sets
    near = near.join(nodes, "node", "left_semi")
    alone = near.select("node", F.explode("set").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.first("node").alias("node"))
    alone = alone.where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    s = nodes.join(alone, "node", "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0)))
    s = stored(s.where(F.col("s") * 100 >= PERCENT * F.col("n")).select("node", "s"), "minhash-shared-sizes")
    at = at.join(s, "node").select("main", "node", "s")
    crowds = at.groupBy("main").agg(F.count("*").alias("nodes")).where(F.col("nodes") >= CROWD).select("main")
    crowded = stored(at.join(crowds, "main", "left_semi").select("main", "node"), "minhash-crowds").join(near.select("node", "narrow", "wide"), "node")
    return stored(at.join(crowded, ["main", "node"], "left"), "minhash-bounds")


def _across(members: DataFrame) -> DataFrame:
    """(a, b): pairs across components that share a key, each in the first table where it meets: no collection in front
    of the table's second one, but its first, agrees. Arrays are laid out as columns, for compiled conditions."""
    share = lambda common, n, m: common * (100 + PERCENT) >= PERCENT * (n + m)
    least = members.groupBy("key").agg(F.min("n").alias("least"))  # a partner has that many shingles at least
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * PERCENT / 100))
    able = members.join(least, "key").where(share(F.col("s"), F.col("n"), partner))
    flat = {f"c{k}": F.get("sub", F.lit(k)) for k in range(COLLECTIONS)} | {f"k{k}": F.get("narrow", F.lit(k)) for k in range(SKETCH)}
    able = able.withColumns(flat).select("key", "table", "node", "n", "s", "component", "main", "wide", *flat)
    few = able.where("component <> main").withColumns({x: F.element_at(F.array(*[F.lit(p[y]) for p in PAIRS]), F.col("table") + 1) for y, x in enumerate("ij")})
    other = able.drop("table", "main")
    pairs = few.join(other.select("key", *[F.col(c).alias(f"{c}_") for c in other.columns if c != "key"]), "key")
    pairs = pairs.where("component <> component_ and (component_ = main or component < component_)").where(_close("n", "n_"))
    pairs = pairs.where(" and ".join(f"not (c{k} = c{k}_ and i <> {k} and j > {k})" for k in range(COLLECTIONS)))
    differ = F.expr(" + ".join(f"bit_count(k{k} ^ k{k}_)" for k in range(SKETCH)))
    wide = F.aggregate(F.zip_with("wide", "wide_", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    most = (100 - PERCENT) * (F.col("n") + F.col("n_"))  # (100 + PERCENT) times the shingles in which similar sets differ
    pairs = pairs.where(share(F.least("s", "s_"), F.col("n"), F.col("n_"))).where(F.coalesce(differ * (100 + PERCENT) <= most, F.lit(True)))
    pairs = pairs.where(F.coalesce((F.size("wide") == 0) | (F.size("wide") != F.size("wide_")) | (wide * (100 + PERCENT) <= most), F.lit(True)))
    return pairs.select(F.col("node").alias("a"), F.col("node_").alias("b"))


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """key, table, node, n, component, m (rows of the key), main (its largest component) of the keys of several components."""
    rows = members.select("key", "table", "node", "n")
    if labels is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    several = each.groupBy("key").agg(F.max(F.struct("c", (-F.col("component")).alias("least"))).alias("top"), F.sum("c").alias("m")).where("m > top.c")
    several = several.select("key", "m", (-F.col("top.least")).alias("main"))
    return rows.join(several, "key")


def _merged(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """The labels that all links so far give, and ``new`` (a, b)."""
    every = new if labels is None else new.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return stored(components(every), "minhash-labels")


def near_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, and first (the row is its component's least by doc_id and mark): a row per row of ``docs``."""
    rows = stored(signatures(docs, width), "minhash-signatures")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("name"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")).alias("least"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("sub").alias("sub"))
    classes = classes.withColumns({"node": F.monotonically_increasing_id(), "row": F.xxhash64("least.doc_id", "least.mark")})
    classes = stored(classes, "minhash-classes")
    labels = near_links(docs, classes, width)
    named = stored(classes.join(labels, "node", "left").select("digest", "size", "name", "least", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("linked")), "minhash-named")
    whole = named.where("linked").groupBy("component").agg(F.min("name").alias("all"), F.min("least").alias("all_least"), F.count("*").alias("sets"))
    named = left_join_groups(named.where("linked or size > 1"), stored(whole, "minhash-components"), "component", "sets", named.count()).select("digest", "size", F.coalesce("all", "name").alias("component_id"), F.coalesce("all_least", "least").alias("least"))
    out = left_join_groups(rows.select("doc_id", "mark", "n", "digest"), stored(named, "minhash-groups"), "digest", "size", rows.count())
    first = F.col("least").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark")))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    return near_groups(docs, width).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

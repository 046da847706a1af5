"""Operator 12, vector code compression: product codes by Lloyd's iteration over cover trees.

* **Trees.** Each task cuts its rows into chunks of ``CHUNK`` vectors and builds, for each of the four parts, a cover tree of
  the chunk's different points with their multiplicities: a node covers its points within its radius; its
  children are chosen farthest first until all points lie within half the power of two above that radius. Points are kept in tree
  order, so a node is a stretch of them and its count and sum are two differences of cumulative sums. Trees are
  written once and read in every round; one row holds one chunk.
* **A round.** The codebook (4 x 256 entries, whatever the data) goes to all tasks. A node whose second nearest different
  entry is farther than the nearest by over twice its radius goes to the nearest as a whole (triangle inequality, with
  a margin for rounding); only other nodes descend, and points of ambiguous leaves are compared exactly. A task emits one sum
  per entry and component, so what is shuffled and what the driver gets (4 x 256 sums) is of fixed size.
* **Codes.** The last pass gives each vector its entries and exact error; errors are added up per label with map-side
  partial sums, and a label that holds a large share of the rows is joined by broadcast.

Distances decide by exact whole numbers: products of floats where all terms stay below 2^53, else of 64-bit numbers.

Defined cases: rows whose vector is null or has null or non-finite components are dropped, also vectors that don't have
as many components as that of the smallest vec_id, or a number of them that four doesn't divide; null vec_ids come after all
numbers; of equal vec_ids the smaller vector comes first; repeated rows count each; fewer than 256 rows make fewer entries; of
equal entries the first is used; null labels count as one; an empty table gives no rows; other columns are ignored.
Components of 2^28 and more (inputs over 262,143), whose squares don't fit the sums, raise an error.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, left_join_groups, stored, table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
CHUNK, LEAF = 4096, 8
LIMIT = 1 << 28


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) as whole numbers."""
    out = np.floor(vectors.astype(np.float64) * 1024)
    if out.size and np.abs(out).max() >= LIMIT:
        raise ArithmeticError("a component is too large for exact sums of squares")
    return out.astype(np.int64)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, points by entries."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * points.shape[1] * most * most < 1 << 53:
        points, entries = points.astype(np.float64), entries.astype(np.float64)
    return (points * points).sum(axis=1)[:, None] + (entries * entries).sum(axis=1) - 2 * (points @ entries.T)


def build(points: np.ndarray) -> dict[str, np.ndarray]:
    """The tree of ``points``: different points in tree order, uses, place of each input; nodes breadth first.

    Node: its stretch [start, end) of points, the first of which is its centre, radius, first child and children.
    """
    points, place, uses = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    order = np.arange(len(points))
    start, end, radius, child, children = [0], [len(points)], [], [], []
    node = 0
    while node < len(start):
        a, b = start[node], end[node]
        own = order[a:b].copy()
        x = points[own]
        d = ((x - x[0]) ** 2).sum(axis=1)
        radius.append(np.sqrt(float(d.max())))
        child.append(len(start))
        if b - a <= LEAF:
            children.append(0)
        else:
            near = 4.0 ** np.ceil(np.log2(radius[-1]) - 1)  # square of the children's covering radius
            owner, first, n = np.zeros(len(own), np.int64), [0], 1
            while d.max() > near:
                c = int(d.argmax())
                e = ((x - x[c]) ** 2).sum(axis=1)
                closer = e < d
                d[closer] = e[closer]
                owner[closer] = n
                first.append(c)
                n += 1
            lead = np.ones(len(own), np.int8)
            lead[first] = 0  # the centre stands first in its stretch
            at = np.lexsort((lead, owner))
            order[a:b] = own[at]
            size = np.cumsum(np.bincount(owner, minlength=n))
            start += (a + np.concatenate(([0], size[:-1]))).tolist()
            end += (a + size).tolist()
            children.append(n)
        node += 1
    back = np.empty(len(points), np.int64)
    back[order] = np.arange(len(points))
    return {"points": points[order], "uses": uses[order], "place": back[place.reshape(-1)], "start": np.array(start), "end": np.array(end), "radius": np.array(radius), "child": np.array(child), "children": np.array(children)}


def assign(tree: dict[str, np.ndarray], codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nodes that go as a whole (start, end, entry: rows of one array), points compared (place, entry), distances computed."""
    entries, first = np.unique(codebook, axis=0, return_index=True)
    entries, first = entries[np.argsort(first)], np.sort(first)  # of equal entries the first
    points, gone, left, computed = tree["points"], [], [], 0
    node = np.zeros(1 if len(points) else 0, np.int64)
    while len(node):
        d = squared(points[tree["start"][node]], entries)
        computed += d.size
        near = d.argmin(axis=1)
        least = np.sqrt(d[np.arange(len(node)), near].astype(np.float64))
        d[np.arange(len(node)), near] = np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf
        second = np.sqrt(d.min(axis=1).astype(np.float64))
        radius = tree["radius"][node]
        with np.errstate(invalid="ignore"):
            sure = (radius == 0) | (second - least > 2 * radius + 1e-9 * (least + radius + 1))
        gone.append(np.stack([tree["start"][node[sure]], tree["end"][node[sure]], first[near[sure]]], axis=1))
        node = node[~sure]
        leaf = tree["children"][node] == 0
        left += [np.arange(a, b) for a, b in zip(tree["start"][node[leaf]].tolist(), tree["end"][node[leaf]].tolist(), strict=True)]
        node = node[~leaf]
        n = tree["children"][node]
        node = np.repeat(tree["child"][node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    left = np.concatenate(left) if left else np.zeros(0, np.int64)
    near = squared(points[left], entries).argmin(axis=1) if len(left) else left
    return np.concatenate(gone) if gone else np.zeros((0, 3), np.int64), np.stack([left, first[near]] if len(left) else [left, left], axis=1), computed + len(left) * len(entries)


def sums(tree: dict[str, np.ndarray], codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and componentwise sums by entry."""
    nodes, single, _ = assign(tree, codebook)
    weighted = tree["points"] * tree["uses"][:, None]
    total = np.concatenate((np.zeros((1, weighted.shape[1]), np.int64), np.cumsum(weighted, axis=0)))
    count = np.concatenate(([0], np.cumsum(tree["uses"])))
    n, s = np.zeros(len(codebook), np.int64), np.zeros(codebook.shape, np.int64)
    np.add.at(n, nodes[:, 2], count[nodes[:, 1]] - count[nodes[:, 0]])
    np.add.at(s, nodes[:, 2], total[nodes[:, 1]] - total[nodes[:, 0]])
    np.add.at(n, single[:, 1], tree["uses"][single[:, 0]])
    np.add.at(s, single[:, 1], weighted[single[:, 0]])
    return n, s


def codes(tree: dict[str, np.ndarray], codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each input point."""
    nodes, single, _ = assign(tree, codebook)
    entry = np.zeros(len(tree["points"]), np.int64)
    for a, b, e in nodes.tolist():
        entry[a:b] = e
    entry[single[:, 0]] = single[:, 1]
    error = ((tree["points"] - codebook[entry]) ** 2).sum(axis=1)
    return entry[tree["place"]], error[tree["place"]]


def _packed(tree: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: v.astype(np.int32) if k != "radius" else v for k, v in tree.items()})
    return out.getvalue()


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return {k: f[k] if k == "radius" else f[k].astype(np.int64) for k in f.files}


def trees(rows: DataFrame) -> DataFrame:
    """n, ids, labels, trees: a row per chunk of ``rows`` (vec_id, label, embedding)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def chunk(part: pd.DataFrame) -> pd.DataFrame:
            x = whole(np.stack(part["embedding"].to_numpy()))
            out = [_packed(build(p)) for p in np.split(x, PARTS, axis=1)]
            return pd.DataFrame({"ids": [part["vec_id"].tolist()], "labels": [part["label"].tolist()], "trees": [out]})

        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= CHUNK:
                every = pd.concat(held)
                yield chunk(every.iloc[:CHUNK])
                held = [every.iloc[CHUNK:]]
        if sum(map(len, held)):
            yield chunk(pd.concat(held))

    texts = rows.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return texts.mapInPandas(run, "ids array<string>, labels array<string>, trees array<binary>")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long), label, embedding of rows with a finite vector of a length that four divides."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & ~odd)


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error, one row per usable row of ``vectors`` (vec_id, label, embedding), stored; and the codebooks by part."""
    rows = usable(vectors)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding")
    first = seeds.first()
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if first is None:
        return rows.sparkSession.createDataFrame([], schema), [np.zeros((0, 0), np.int64)] * PARTS
    rows = rows.where(F.size("embedding") == len(first[0]))
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries)
    books = np.split(whole(np.array([r[0] for r in seeds.collect()])), PARTS, axis=1)
    kept = stored(trees(rows), "cover-trees")
    for _ in range(rounds):
        books = _next(kept, books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, labels, packed in b[["ids", "labels", "trees"]].itertuples(index=False):
                found = [codes(_unpacked(raw), book) for raw, book in zip(packed, books, strict=True)]
                code = ["".join(f"{e:02x}" for e in es) for es in zip(*(entry.tolist() for entry, _ in found), strict=True)]
                yield pd.DataFrame({"vec_id": ids, "label": labels, "code": code, "error": sum(error for _, error in found)})

    coded = kept.mapInPandas(run, "vec_id string, label string, code string, error long")
    coded = stored(coded.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast(rows.schema["label"].dataType).alias("label"), "code", "error"), "vector-codes")
    drop_stored(kept)
    return coded, books


def _next(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; entries that nothing uses stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for b in batches:
            for packed in b["trees"]:
                for part, raw in enumerate(packed):
                    more = sums(_unpacked(raw), books[part])
                    n[part] += more[0]
                    s[part] += more[1]
        for part in range(PARTS):
            used = np.flatnonzero(n[part])
            yield pd.DataFrame({"part": part, "entry": used, "n": n[part][used], "s": s[part][used].tolist()})

    rows = kept.select("trees").mapInPandas(run, "part int, entry int, n long, s array<long>")
    width = books[0].shape[1]
    added = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    books = [b.copy() for b in books]
    for r in added.collect():  # at most PARTS * ENTRIES rows
        books[r["part"]][r["entry"]] = np.array(r["s"], np.int64) // r["n"]
    return books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = compress(vectors)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    key = F.encode(F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")), "UTF-8")  # null labels are one
    rows = coded.withColumn("key", key)
    labels = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("uses"))
    out = left_join_groups(rows, labels, "key", "uses", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql(entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds written out."""
    near = """
a{i} AS MATERIALIZED (
  SELECT p.r, p.part, min(struct_pack(d := (p.xx + b.cc - 2 * list_inner_product(p.x, b.c))::BIGINT, e := b.entry)) AS best
  FROM p JOIN b{i} b USING (part) GROUP BY p.r, p.part)"""
    means = """
b{j} AS MATERIALIZED (
  WITH s AS (SELECT p.part, best.e AS entry, i, sum(p.x[i]::BIGINT) AS s, count(*) AS n FROM a{i} JOIN p USING (r, part), generate_series(1, len(p.x)) g(i) GROUP BY ALL),
  m AS (SELECT part, entry, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s GROUP BY part, entry)
  SELECT part, entry, coalesce(m.c, b.c) AS c, list_inner_product(coalesce(m.c, b.c), coalesce(m.c, b.c)) AS cc FROM b{i} b LEFT JOIN m USING (part, entry))"""
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [means.format(i=i, j=i + 1), near.format(i=i + 1)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding, len(embedding) // {PARTS} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT r, k AS part, [floor(1024 * x::DOUBLE) for x in embedding[k * w + 1 : (k + 1) * w]] AS x FROM v, range({PARTS}) t(k)),
p AS MATERIALIZED (SELECT r, part, x, list_inner_product(x, x) AS xx FROM q),
b0 AS MATERIALIZED (SELECT part, r AS entry, x AS c, xx AS cc FROM p WHERE r < {entries}),{",".join(steps)},
h AS (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM b{rounds}, generate_series(1, len(c)) g(i)),
o AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN o USING (r), h
"""


OP12_SQL = _sql()

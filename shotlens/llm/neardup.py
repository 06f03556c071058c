"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate
edges, links confirmed on the full shingle sets, and connected components.

Texts with the same words are one node, so that exact copies cost nothing further. A bucket of n nodes makes n - 1
candidate edges, all from the node that shares most buckets with others, so that one centre serves a group in all bands.
A bucket that confirmed links leave in several components gets further centres in a fixed number of rounds, and an exact
join over the texts' rare shingles settles what is still open then (see link_texts), so that a star's shape loses no link.
Pairs that cannot link, by their set sizes or by a bound on their difference, are not fetched for confirmation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.llm.common import batch_of, column_bytes, map_arrow, prepared, table, trim
from shotlens.session import materialise

#: Words of a shingle; a link is 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: BANDS of ROWS bins: two texts of similarity 0.75 miss every common bucket with probability 5e-6.
BANDS, ROWS = 32, 4
#: Members up to which an unsettled bucket is compared in full across its components; a larger one gets CENTRES further
#: centres in each of ROUNDS rounds, before the exact join settles it.
SMALL, CENTRES, ROUNDS = 24, 3, 2
#: Words whose hashes a task keeps; 64-bit parts of a parity sketch; links that one task contracts.
CACHE, LANES, TASK_LINKS = 150_000, 8, 500_000
#: Counters (a power of two, by a shingle's first bits) that order shingles by rarity; members of a shingle that one part of a join takes.
COUNTER_BITS, FEW = 20, 1000
#: Nodes for each file of an intermediate table beyond one for each core: small tables stay in few files.
PART_NODES = 50_000
#: Fixed odd multipliers of the hashes.
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Words of a text (white space separates, A-Z is lowered) and the sorted 64-bit hashes of its distinct shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.cache = words, {}

    def split(self, text: bytes) -> list[bytes]:
        return text.lower().split()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        cache, digest = self.cache, xxhash.xxh3_64_intdigest
        try:
            h = np.array([cache[w] for w in words], np.uint64)
        except KeyError:
            for w in set(words):
                if w not in cache:
                    cache[w] = digest(w)
            h = np.array([cache[w] for w in words], np.uint64)
        n = min(self.words, len(h))
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = out * _M1 + h[k : len(h) - n + 1 + k]
        return np.unique(_mix(out + np.uint64(n)))


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation hash: the least hash in each of `bins` ranges of hashes. An empty bin takes the value of a bin
    that a hash of its own number and the attempt's picks, until that one isn't empty."""
    width = np.uint64((1 << 64) // bins)
    at = (shingles // width).astype(np.int64)
    np.minimum(at, bins - 1, out=at)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[at[first]] = shingles[first]
    full[at[first]] = True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        attempt += 1
        pick = (_mix((empty.astype(np.uint64) << np.uint64(32)) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        ok = full[pick]
        out[empty[ok]] = out[pick[ok]]
        empty = empty[~ok]
    return out


def buckets_of(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket number for each band."""
    s = signature(shingles, bands * rows).reshape(bands, rows)
    h = np.arange(bands, dtype=np.uint64) * _M1
    for k in range(rows):
        h = _mix(h + s[:, k]) * _M1
    return _mix(h).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """64 * LANES bits; each shingle flips one. Two sets differ in at least as many shingles as these differ in bits."""
    at = (shingles % np.uint64(64 * LANES)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * LANES) & 1).astype(np.uint8)).view(np.int64)


def may_link(a: Column, b: Column) -> Column:
    """False where the set sizes, or the least number of shingles that only one of the sets has, rule a link out."""
    apart = sum((F.bit_count(a["bits"][k].bitwiseXOR(b["bits"][k])) for k in range(1, LANES)), F.bit_count(a["bits"][0].bitwiseXOR(b["bits"][0])))
    sizes = 100 * F.least(a["size"], b["size"]) >= PERCENT * F.greatest(a["size"], b["size"])
    return sizes & ((100 + PERCENT) * apart <= (100 - PERCENT) * (a["size"] + b["size"]))


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (128 bits of the words; null without words), n_shingles and buckets of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler()
        for b in batches:
            trim(sh.cache, CACHE)
            keys, sizes, buckets = [], [], []
            for text in column_bytes(b, "text"):
                words = sh.split(text)
                s = sh.shingles(words)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                buckets.append(buckets_of(s) if words else None)
            yield batch_of(id=b.column(0), key=pa.array(keys, pa.binary()), n_shingles=pa.array(sizes, pa.int64()), buckets=pa.array(buckets, pa.list_(pa.int64())))

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, run, f"id {docs.schema[id_col].dataType.simpleString()}, key binary, n_shingles long, buckets array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, weight, size, bits (see parities) and shingles (64-bit hashes, rising) of the wanted nodes (node, key, doc,
    weight). An id may come with several texts: the one with the node's words counts."""
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(wanted.select("node", "key", "doc", "weight"), "doc").select("node", "weight", "key", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler()
        for b in batches:
            trim(sh.cache, CACHE)
            same, sets = [], []
            for key, text in zip(b.column(2).to_pylist(), column_bytes(b, "text"), strict=True):
                words = sh.split(text)
                same.append(xxhash.xxh3_128_digest(b" ".join(words)) == key)
                if same[-1]:
                    sets.append(sh.shingles(words))
            node, weight = (b.column(i).filter(pa.array(same)) for i in range(2))
            bits = pa.array([parities(x) for x in sets], pa.list_(pa.int64()))
            yield batch_of(node=node, weight=weight, size=pa.array([len(x) for x in sets], pa.int64()), bits=bits, shingles=pa.array([x.tobytes() for x in sets], pa.binary()))

    return map_arrow(texts, own, "node long, weight long, size long, bits array<long>, shingles binary").dropDuplicates(["node"])


def confirm(sets: DataFrame, edges: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The edges (a, b) whose full shingle sets are similar enough."""
    pairs = edges.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("shingles_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("shingles_a")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                sa, sb = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                kept[i] = 100 * both >= percent * (len(sa) + len(sb) - both)
            yield b.select(["a", "b"]).filter(pa.array(kept))

    return map_arrow(pairs.select("a", "b", "shingles_a", "shingles_b"), check, "a long, b long")


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars: u and the smallest node v that its links reach, for every u but that one."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    nodes = list(up)
    yield batch_of(u=pa.array(nodes, pa.int64()), v=pa.array([root(x) for x in nodes], pa.int64()))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node and root (the smallest node that can be reached) of every node in a link.

    Each task contracts its links, TASK_LINKS or so, to stars; where there are several tasks, large and small stars in
    turn join these, until each node has one edge and no root has any. A node's least neighbour is found by an aggregate,
    which is combined before its shuffle, and goes back by a join that Spark can split for a node with very many
    neighbours."""
    parts = 1 + links.count() // TASK_LINKS
    edges = materialise(spark, map_arrow(links.coalesce(parts), contract, "u long, v long"), "links")
    while edges.groupBy("u").count().where("count > 1").count() or edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").count() if parts > 1 else False:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(spark, map_arrow(small.coalesce(parts), contract, "u long, v long"), "links")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def grown(spark: SparkSession, found: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots after further links."""
    return components(spark, found.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))


def prefixes(spark: SparkSession, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, size, at and shingle: the first shingles of every text, rare ones first, as many as every linked text has to
    meet one of. The order is the same for all texts: by counters that shingles share by their first bits, then by hash."""
    shift = np.uint64(64 - COUNTER_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(n, (np.frombuffer(x.as_buffer(), np.uint64) >> shift).astype(np.int64), 1)
        hit = np.flatnonzero(n)
        yield batch_of(slot=pa.array(hit, pa.int64()), n=pa.array(n[hit], pa.int64()))

    got = map_arrow(sets.select("shingles"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 2 ** COUNTER_BITS rows at most
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        for b in batches:
            nodes, places, hashes = [], [], []
            for node, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                s = s[np.lexsort((s, n[(s >> shift).astype(np.int64)]))]
                k = len(s) - -(-percent * len(s) // 100) + 1
                nodes.append(np.full(k, node, np.int64))
                places.append(np.arange(k))
                hashes.append(s[:k].view(np.int64))
            if nodes:
                yield batch_of(**{c: pa.array(np.concatenate(x), pa.int64()) for c, x in (("node", nodes), ("at", places), ("shingle", hashes))})

    return map_arrow(sets.select("node", "shingles"), first, "node long, at long, shingle long")


def settle(spark: SparkSession, members: DataFrame, sketches: DataFrame, sets: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """The roots after every link between members (bucket, node) of buckets that still span components.

    Of two linked texts, the first shingle that both prefixes hold leaves enough behind it in both for the link, so a join
    over the prefixes under that condition meets every link. Shingles of at most SMALL texts come first: their links
    bring components together before the frequent ones are joined, each in parts of FEW texts. Where a shingle's texts lie in
    several components, one of two unlinked texts is outside the most frequent of these: only such texts are on the left."""
    placed = members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
    unsettled = materialise(spark, placed.join(open_, "bucket", "left_semi").select("node").distinct().coalesce(parts), "unsettled")
    if unsettled.isEmpty():
        return roots
    first = materialise(spark, prefixes(spark, sets.join(unsettled, "node", "left_semi")).coalesce(2 * parts), "prefixes")
    known = unsettled.join(sketches, "node")
    for frequent in (False, True):
        placed = first.join(known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "node")
        shared = placed.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.mode("root", True).alias("most")).where("r0 <> r1")
        shared = shared.where(F.col("n") > SMALL if frequent else F.col("n") <= SMALL).select("shingle", "most", F.ceil(F.col("n") / FEW).cast("int").alias("deals"))
        rows = placed.join(shared, "shingle").select("shingle", "most", "deals", F.struct("node", "size", "bits", "at", "root").alias("x"))
        left = rows.where("x.root <> most").select("shingle", "most", F.pmod(F.xxhash64("x.node"), "deals").cast("int").alias("deal"), "x")
        right = rows.select("shingle", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("x").alias("y"))
        x, y = F.col("x"), F.col("y")
        both = F.least(x["size"] - x["at"], y["size"] - y["at"])
        enough = (100 + PERCENT) * both >= PERCENT * (x["size"] + y["size"])
        once = (x["node"] < y["node"]) | (y["root"] == F.col("most"))
        pairs = left.join(right, ["shingle", "deal"]).where((x["root"] != y["root"]) & once & enough & may_link(x, y))
        new = materialise(spark, pairs.select(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")).distinct().coalesce(2 * parts), "edges")
        found = materialise(spark, confirm(sets, new).coalesce(2 * parts), "confirmed")
        if not found.isEmpty():
            roots = grown(spark, found, roots)
    return roots


def link_texts(spark: SparkSession, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """node and root of every node in a confirmed link (None: there is no candidate).

    First round: in each bucket a star around the node that shares most buckets with others (of equal ones the smaller). A
    bucket whose members then lie in several components is unsettled: two members that the centre doesn't link may
    still be linked to each other. The second round compares the members of small unsettled buckets across components in
    full, SMALL nodes at most, and gives each larger one stars around CENTRES members outside its first one's component,
    the most shared of them and others that a hash picks; so does each further round, ROUNDS of them at most. The
    larger buckets that then still span components are settled exactly (see settle)."""
    parts = spark.sparkContext.defaultParallelism + nodes.count() // PART_NODES
    bands = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(spark, bands.join(shared, "bucket").coalesce(4 * parts), "members")
    if members.isEmpty():
        return None
    wanted = nodes.join(members.groupBy("node").agg(F.sum("n").alias("weight")), "node")
    sets = materialise(spark, sets_of(docs, wanted, id_col, text_col).coalesce(4 * parts), "sets")
    sketches = sets.select("node", "weight", "size", "bits")
    whole = F.struct(F.col("weight").alias("weight"), (-F.col("node")).alias("order"), "node", "size", "bits")
    known = members.join(sketches, "node")
    centres = known.groupBy("bucket").agg(F.max(whole).alias("c"))
    x, c = F.struct("size", "bits"), F.col("c")
    members = materialise(spark, known.join(centres, "bucket").coalesce(4 * parts), "placed")
    first = members.where((F.col("node") != c["node"]) & may_link(x, c)).select(c["node"].alias("a"), F.col("node").alias("b")).distinct()
    roots = components(spark, materialise(spark, confirm(sets, first).coalesce(2 * parts), "confirmed"))
    members = members.where("n > 2").select("bucket", "n", "node", "weight", "size", "bits", F.col("c.node").alias("centre"))
    for attempt in range(ROUNDS):
        # small buckets are settled once they are compared in full, in the first of these rounds
        placed = members.where(F.col("n") > (SMALL if attempt else 2)).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        node = ("node", "root", "size", "bits")
        # the centres lie outside one component, that of the first centre, which has met all members already
        met = placed.where("node = centre").select("bucket", F.col("root").alias("met"))
        by_weight = [F.max(F.struct("weight", (-F.col("node")).alias("order"), *node)).alias("c0")] if attempt == 0 else []
        by_hash = [F.min(F.struct(F.xxhash64("node", F.lit(CENTRES * attempt + k)).alias("order"), *node)).alias(f"c{k}") for k in range(len(by_weight), CENTRES)]
        open_ = placed.join(met, "bucket").where("root <> met").groupBy("bucket").agg(*by_weight, *by_hash)
        open_ = open_.select("bucket", F.array(*(F.struct(*(F.col(f"c{k}.{f}") for f in node)) for k in range(CENTRES))).alias("centres"))
        unsettled = placed.join(open_, "bucket")
        useful = F.filter("centres", lambda c: (c["root"] != F.col("root")) & may_link(F.struct("size", "bits"), c))
        stars = unsettled.where(F.col("n") > SMALL).select(F.explode(F.array_distinct(useful["node"])).alias("a"), F.col("node").alias("b"))
        if attempt == 0:
            few = unsettled.where(F.col("n") <= SMALL)
            left, right = (few.select("bucket", F.struct(*node).alias(x)) for x in ("x", "y"))
            across = left.join(right, "bucket").where((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & may_link(F.col("x"), F.col("y"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
            stars = stars.unionByName(across)
        new = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = materialise(spark, confirm(sets, new).coalesce(2 * parts), "confirmed")
        if found.isEmpty():
            break
        roots = grown(spark, found, roots)
    return settle(spark, members.where(F.col("n") > SMALL), sketches, sets, roots, parts)


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_shingles, component_id and kept of every row.

    Rows with the same words are copies of one node; component_id is the smallest id among the rows of all nodes that
    links reach, and kept says that the row has that id. A text without words (null and empty ones) has n_shingles 0 and
    is a component of its own; a row with a null id is linked with nothing, has a null component_id and is kept;
    repeated rows get the same values; an id that comes with several texts is placed by each of them; an empty table
    gives an empty table; other columns are not read.
    """
    prepared(spark)
    rows = materialise(spark, hashed(docs, id_col, text_col), "rows")
    nodes = rows.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("doc"), F.first("n_shingles").alias("size"), F.first("buckets").alias("buckets"))
    nodes = materialise(spark, nodes.coalesce(8 * spark.sparkContext.defaultParallelism + rows.count() // PART_NODES).withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = link_texts(spark, docs, nodes, id_col, text_col)
    places = nodes.select("key", "node", "doc")
    if roots is not None:
        rooted = places.join(roots, "node")
        linked = rooted.join(rooted.groupBy("root").agg(F.min("doc").alias("least")), "root").select("node", "least")
        places = places.join(linked, "node", "left").select("key", F.coalesce("least", "doc").alias("component_id"))
    else:
        places = places.select("key", F.col("doc").alias("component_id"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key"), "n_shingles").join(places, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)
), edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edge e ON e.x = r.other
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

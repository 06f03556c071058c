"""Token overlap of texts and cosine of vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.functions.geometry import unit
from shotlens.functions.numeric import clamp
from shotlens.session import materialise, ship


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def token_score(a: Column, b: Column) -> Column:
    """A struct of score, recall, precision, f1 and length_ratio of two token arrays; a is the side that is to be found.

    The overlap is one of sets; the length ratio counts repeats. All is 0 without a common token."""
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(sa, sb)).cast("double")
    recall, precision = F.try_divide(both, F.size(sa)), F.try_divide(both, F.size(sb))
    f1 = F.try_divide(2 * recall * precision, recall + precision)
    lengths = F.try_divide(F.least(F.size(a), F.size(b)).cast("double"), F.greatest(F.size(a), F.size(b), F.lit(1)))
    any_ = both > 0
    zero = lambda c: F.when(any_, c).otherwise(0.0)
    return F.struct(zero(clamp(0.50 * recall + 0.35 * f1 + 0.15 * lengths)).alias("score"), zero(recall).alias("recall"), zero(precision).alias("precision"), zero(f1).alias("f1"), zero(lengths).alias("length_ratio"))


def token_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, text: str, least: float) -> DataFrame:
    """Pairs of a key's rows whose token score reaches `least` (above 0): pairs meet on a common token, by an equi-join, so
    that pairs without one are never made.

    A score of `least` takes a recall of at least r (see least_recall), so that all but the first n - ceil(r n) + 1 of a
    left row's n tokens need not meet anything; these are its rarest ones, by how many right rows have them."""
    a = left.select(*keys, left_id, tokens(F.col(text)).alias("__a"))
    b = right.select(*keys, right_id, tokens(F.col(text)).alias("__b"))
    at = a.select(*keys, left_id, F.explode(F.array_distinct("__a")).alias("__t"))
    bt = b.select(*keys, right_id, F.explode(F.array_distinct("__b")).alias("__t"))
    often = bt.groupBy(*keys, "__t").agg(F.count("*").alias("__n"))
    first = Window.partitionBy(*keys, left_id).orderBy(F.coalesce("__n", F.lit(0)), "__t")
    all_ = F.count("*").over(Window.partitionBy(*keys, left_id))
    rare = at.join(often, [*keys, "__t"], "left").withColumns({"__r": F.row_number().over(first), "__all": all_}).where((F.col("__r") <= F.col("__all") - F.ceil(F.col("__all") * least_recall(least)) + 1) & F.col("__n").isNotNull())
    pairs = rare.select(*keys, left_id, "__t").join(bt, [*keys, "__t"]).select(*keys, left_id, right_id).distinct()
    scored = pairs.join(a, [*keys, left_id]).join(b, [*keys, right_id]).withColumn("__s", token_score(F.col("__a"), F.col("__b")))
    return scored.where(F.col("__s.score") >= least).select(*keys, left_id, right_id, "__s.*")


def least_recall(score: float) -> float:
    """The recall below which no token score reaches `score`, whatever the precision and the lengths (rounded down)."""
    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.50 * mid + 0.35 * 2 * mid / (1 + mid) + 0.15 < score else (low, mid)
    return max(0.0, low - 1e-9)


def mean_unit(df: DataFrame, keys: Sequence[str], vec: str, order: Sequence[Column | str] | None = None, k: int | None = None, name: str = "embedding") -> DataFrame:
    """The renormalised mean of the unit vectors of a group's first k rows (all without k), and how many there were.

    Sums are made per dimension, so that they are combined before the shuffle."""
    rows = df.withColumn("__u", unit(F.col(vec))).where(F.size("__u") > 0)
    if k is not None:
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k)
    parts = rows.select(*keys, F.posexplode("__u").alias("__d", "__v")).groupBy(*keys, "__d").agg(F.avg("__v").alias("__m"), F.count("*").alias("__n"))
    return parts.groupBy(*keys).agg(unit(F.transform(F.sort_array(F.collect_list(F.struct("__d", "__m"))), lambda x: x["__m"])).alias(name), F.max("__n").alias("crop_count"))


def two_largest(items: Column) -> Column:
    """The two largest of an array of structs, by two maxima; of repeated ones both."""

    def after(a: Column) -> Column:
        top = F.array_max(a)
        again = F.when(F.size(F.filter(a, lambda x: x == top)) > 1, top)
        return F.array_compact(F.array(top, F.coalesce(again, F.array_max(F.filter(a, lambda x: x < top)))))

    return F.transform(F.array(items), after)[0]


#: Vectors that a task compares at a time, of the queries and of the gallery; queries of one product; what rounding may add.
QUERIES, PROTOTYPES, CHUNK, SLACK = 16_384, 32_768, 256, 1e-9


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of one length (zeros behind the shorter ones), and their lengths."""
    a = column.combine_chunks()
    sizes = np.diff(a.offsets.to_numpy())
    out = np.zeros((len(a), int(sizes.max()) if len(a) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = a.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def _two_best(q: np.ndarray, g: np.ndarray, odd: np.ndarray | None, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, column and score of the two best of each query; of equal scores the later column. `odd` pairs score -1, those
    that `seen` leaves out do not count. What a product of matrices finds is scored again term by term, so that equal vectors
    have equal scores wherever they lie."""
    s = q @ g.T
    s[np.isnan(s)] = np.inf  # the largest, as Spark has it
    if odd is not None:
        s[odd] = -1.0
    if seen is not None:
        s[~seen] = -np.inf
    at = np.arange(len(s))
    first = s.argmax(1)
    top = s[at, first]
    s[at, first] = -np.inf
    least = s.max(1)
    s[at, first] = top
    least = np.where(least == -np.inf, top, least)
    least[top == -np.inf] = np.nan  # nothing counts
    i, j = np.nonzero(s >= (least - SLACK)[:, None])
    score = np.zeros(len(i))
    for d in range(q.shape[1]):
        score += q[i, d] * g[j, d]
    if odd is not None:
        score[odd[i, j]] = -1.0
    order = np.lexsort((-j, -np.where(np.isnan(score), np.inf, score), i))
    i, j, score = i[order], j[order], score[order]
    keep = np.ones(len(i), bool)
    keep[2:] = i[2:] != i[:-2]
    return i[keep], j[keep], score[keep]


def grid(q: DataFrame, g: DataFrame, copies: int, reach: Callable[[pa.Table], tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]] | None = None) -> DataFrame:
    """id, score, proto and label of the two best in each part of the gallery; a row without a score where nothing may match.

    q: id, q, allow, part (and what `reach` needs); g: proto, label, v, part, cell. Queries are dealt to `copies` groups by
    their id; each meets the parts it is sent to, so that a task holds one group and one part, whatever the sizes. `reach`
    gives, for queries, an order in which neighbours read the same cells, and a function of some of them that flags each
    cell number for each."""
    key = F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int")
    left = q.withColumn("copy", key).groupBy("copy", "part")
    right = g.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).groupBy("copy", "part")
    kinds = {c: df.schema[c].dataType for c, df in (("id", q), ("proto", g), ("label", g))}
    schema = f"id {kinds['id'].simpleString()}, score double, proto {kinds['proto'].simpleString()}, label {kinds['label'].simpleString()}"

    def meet(mine: pa.Table, other: pa.Table) -> pa.Table:
        other = other.take(pc.sort_indices(other, [("proto", "ascending"), ("label", "ascending")]))
        vectors, sizes = _matrix(mine["q"])
        protos, lengths = _matrix(other["v"])
        width = max(vectors.shape[1], protos.shape[1])
        vectors, protos = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, protos))
        same = len(np.unique(np.concatenate([sizes, lengths]))) == 1 and width > 0
        labels, cells = np.array(other["label"].to_pylist(), object), other["cell"].to_numpy()
        near, flags_of = reach(mine) if reach and len(mine) else (sizes, None)
        sets: dict = {}
        for n, a in enumerate(mine["allow"].to_pylist()):
            sets.setdefault(frozenset(a) - {None} if a else None, []).append(n)
        found: list[tuple] = []
        for allowed, members in sets.items():
            cols = np.arange(len(labels)) if allowed is None else np.nonzero([x in allowed for x in labels])[0]
            members = np.array(members)[np.argsort(near[members], kind="stable")]
            for a in range(0, len(members) if len(cols) else 0, CHUNK):
                some, seen, c = members[a : a + CHUNK], None, cols
                if flags_of is not None:
                    flags = flags_of(some)
                    c = cols[flags.any(0)[cells[cols]]]
                    if not len(c):
                        continue
                    seen = flags[:, cells[c]]
                odd = None if same else (sizes[some][:, None] != lengths[c]) | (sizes[some] == 0)[:, None]
                i, j, score = _two_best(vectors[some], protos[c], odd, seen)
                found.append((some[i], c[j], score))
        i, j, score = (np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in range(3))
        none = np.setdiff1d(np.arange(len(mine)), i)
        i = pa.array(np.concatenate([i, none]).astype(np.int64))
        j = pa.concat_arrays([pa.array(j.astype(np.int64)), pa.nulls(len(none), pa.int64())])
        score = pa.concat_arrays([pa.array(score.astype(float)), pa.nulls(len(none), pa.float64())])
        return pa.table({"id": mine["id"].take(i), "score": score, "proto": other["proto"].take(j), "label": other["label"].take(j)})

    return left.cogroup(right).applyInArrow(meet, schema)


def best_two(found: DataFrame) -> DataFrame:
    """id and `two`, the two largest of all that the grid has found for it."""
    item = F.when(F.col("score").isNotNull(), F.struct("score", "proto", "label"))
    return found.groupBy("id").agg(two_largest(F.collect_list(item)).alias("two"))


def copies_of(queries: int) -> int:
    """Groups of queries: at most QUERIES in each, and enough for the cores."""
    return max(-(-queries // QUERIES), min(16, -(-queries // CHUNK)), 1)


def best_match(queries: DataFrame, gallery: DataFrame, query_id: str, vec: str, proto_id: str, label: str, threshold: float, margin: float, allow: str | None = None) -> DataFrame:
    """The nearest gallery vector by cosine for each query: top_score, second_score (-1 without a second), margin, and the
    prototype and label where the score and the margin reach their limits.

    `allow` is a column of labels that a query may match (empty: all). Every pair is compared, in a grid of groups of queries
    and parts of the gallery: work grows with both, the memory of a task does not."""
    spark = queries.sparkSession
    ship(spark)
    q = queries.select(F.col(query_id).alias("id"), unit(F.col(vec)).alias("q"), (F.col(allow) if allow else F.lit(None).cast("array<string>")).alias("allow"))
    q = materialise(spark, q, "match-queries")
    g = gallery.select(F.col(proto_id).alias("proto"), F.col(label).alias("label"), unit(F.col(vec)).alias("v"), F.lit(0).cast("long").alias("cell"))
    g = materialise(spark, g, "match-gallery")
    parts = max(1, -(-g.count() // PROTOTYPES))
    q_all = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    merged = best_two(grid(q_all, g.withColumn("part", F.pmod(F.xxhash64("proto"), F.lit(parts)).cast("int")), copies_of(q.count())))
    return verdict(merged, query_id, label, threshold, margin)


def verdict(found: DataFrame, query_id: str, label: str, threshold: float, margin: float) -> DataFrame:
    """What best_match returns, from `two`; further columns stay."""
    more = [c for c in found.columns if c not in ("id", "two")]
    top, second = F.try_element_at("two", F.lit(1)), F.try_element_at("two", F.lit(2))
    out = found.select(F.col("id").alias(query_id), F.coalesce(top["score"], F.lit(-1.0)).alias("top_score"), F.coalesce(second["score"], F.lit(-1.0)).alias("second_score"), top["proto"].alias("__p"), top["label"].alias("__l"), *more)
    out = out.withColumn("margin", F.when(F.col("__p").isNull(), 0.0).otherwise(F.col("top_score") - F.col("second_score")))
    hit = (F.col("top_score") >= threshold) & (F.col("margin") >= margin)
    return out.select(query_id, "top_score", "second_score", "margin", F.when(hit, F.col("__p")).alias("prototype_id"), F.when(hit, F.col("__l")).alias(label), *more)

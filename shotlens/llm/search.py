"""Exact BM25 top-k search: an inverted index per shard with block-max WAND pruning, merged exactly, because every shard
scores with the statistics of the whole table.

Texts are taken apart once, into a table of their terms in the shared folder. A shard is what a task reads of it,
SHARD_POSTINGS at a time; nothing is shuffled to build it. The queries, with the inverse document frequencies of their
terms, are a table in the shared folder that each shard reads in blocks, so that no task and not the driver ever holds
all of them. Every document is in one of several rounds, dealt by a hash of its id: the first is of a few shards, each
later one of three times what came before it. A round is asked for what comes before the k-th best that a query has found
in the rounds before (by score and id), so that of each some 3 * k rows a query are to be expected, however many shards
it has; each shard is asked once, by one task or, where a round has few shards, by some that share the queries. A shard's commonest
terms are the columns of a matrix with a row for each document and one for each block, which holds the block's largest impacts;
the postings of the others are summed for many queries at a time. Blocks are aligned over all terms, so that the pivot
test, whether a block's largest impacts and the largest sum of postings of one of its documents together reach the threshold,
is made for all blocks at a time. A block that passes is multiplied with the queries for which it does, the others are skipped.
These sums are bounds, and scores are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlens.llm.common import batch_of, column_bytes, joined, map_arrow, places, prepared, table
from shotlens.session import materialise, shared_dir

K1, B = 1.2, 0.75
#: Postings of a shard's index and documents of a block whose largest impact bounds it; both bound a task's memory.
SHARD_POSTINGS, BLOCK_DOCS = 3_000_000, 64
#: Postings of the rarest terms that a shard looks at for a threshold where none is known.
SEED_POSTINGS = 2048
#: A round's share of what is left to it, as the logarithm's base, and rounds at most.
ROUND, ROUNDS = 4.0, 12
#: Commonest terms of a shard whose impacts are a matrix (those in at least one of COMMON_SHARE documents), and queries that
#: are asked at a time, of these as many for which postings are summed; cells of that matrix, and of the sums, at most, for
#: shards of many short texts; bytes of a batch of queries.
COMMON, COMMON_SHARE, TOGETHER, RARE_TOGETHER = 1024, 128, 256, 8
COMMON_CELLS, SUM_CELLS, QUERY_BYTES = 16 << 20, 4 << 20, 8 << 20
#: A round of fewer than TASKS tasks makes more of them, each for a part of the queries, of TASK_QUERIES or more.
TASKS, TASK_QUERIES = 24, 8192
POSTING = np.dtype([("doc", np.int32), ("impact", np.float32)])
_TERM = re.compile(rb"[a-z0-9\x80-\xff]+")


def terms_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct terms (64-bit hashes, rising) and their counts. A term is a run of ASCII letters and digits and
    of characters beyond ASCII; A-Z is lowered."""
    digests = b"".join(map(xxhash.xxh3_64_digest, _TERM.findall(text.lower())))
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64), return_counts=True)


class Shard:
    """Documents (sorted by their most frequent term and length, so that a block's are alike) with the impacts of their
    terms, by document and by term. The commonest terms are columns of a matrix, with the largest impacts of each block of
    `block_docs` documents."""

    def __init__(self, ids: list, terms: list[np.ndarray], counts: list[np.ndarray], average: float, k1: float = K1, b: float = B, block_docs: int = BLOCK_DOCS):
        order = sorted(range(len(ids)), key=lambda i: (int(terms[i][counts[i].argmax()]), int(counts[i].sum())))
        self.ids, terms, counts = np.array(ids)[order], [terms[i] for i in order], [counts[i] for i in order]
        n = len(ids)
        self.size = np.array([len(t) for t in terms])
        lengths = np.array([c.sum() for c in counts], float)
        self.begin = np.cumsum(self.size) - self.size
        tf = np.concatenate(counts).astype(float)
        doc = np.repeat(np.arange(n, dtype=np.int32), self.size)
        norm = k1 * (1 - b + b * lengths / max(average, 1e-9))
        self.impact = tf * (k1 + 1) / (tf + norm[doc])  # by document, terms rising
        del tf, counts
        self.terms, self.term = np.unique(np.concatenate(terms), return_inverse=True)
        self.term = self.term.astype(np.int32)
        turned = np.argsort(self.term, kind="stable")
        self.postings = np.empty(len(turned), POSTING)
        self.postings["doc"], self.postings["impact"] = doc[turned], self.impact[turned]
        self.df = np.bincount(self.term, minlength=len(self.terms))
        self.start = np.cumsum(self.df) - self.df
        self.most = np.maximum.reduceat(self.postings["impact"], self.start)
        # the impacts of the commonest terms as a matrix, single precision, with those of the blocks
        most = np.argsort(-self.df, kind="stable")[: min(COMMON, COMMON_CELLS // n)]
        most = most[self.df[most] * COMMON_SHARE >= n]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[most] = np.arange(len(most))
        self.common = np.zeros((n, len(most)), np.float32)
        column = self.column[self.term]
        self.common[doc[column >= 0], column[column >= 0]] = self.impact[column >= 0]
        self.blocks = np.arange(0, n, block_docs)
        self.common_most = np.maximum.reduceat(self.common, self.blocks)
        #: Largest relative error of a sum of len(most) products and one sum of postings, none negative and each number rounded once.
        self.off = (len(most) + 8) * 2.0**-24 * 1.01
        self.q = np.zeros(len(self.terms))
        self.skipped = self.read = 0  # blocks

    def _exact(self, docs: np.ndarray) -> np.ndarray:
        """Scores, each a sum over the document's terms in their order."""
        if not len(docs):
            return np.empty(0)
        n = self.size[docs]
        at = places(self.begin[docs], n)
        return np.add.reduceat(self.q[self.term[at]] * self.impact[at], np.cumsum(n) - n)

    def _postings(self, at: np.ndarray, df: np.ndarray) -> np.ndarray:
        return self.postings.view(np.int64).take(places(self.start[at], df)).view(POSTING)

    def _places(self, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.terms, terms)
        hit = at < len(self.terms)
        hit[hit] = self.terms[at[hit]] == terms[hit]
        return at[hit], idf[hit]

    def _ask(self, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, w = self._places(terms, idf)
        self.q[at] = w
        return at, w

    def seeds(self, own, terms: np.ndarray, idf: np.ndarray, most: int) -> list[float]:
        """The scores of at most `most` documents, those that the rarest terms favour."""
        at, w = self._ask(terms, idf)
        rare = np.argsort(-w, kind="stable")
        rare = rare[: int(np.searchsorted(np.cumsum(self.df[at][rare]), SEED_POSTINGS)) + 1]
        n = self.df[at[rare]]
        here = self._postings(at[rare], n)
        doc, part = np.unique(here["doc"], return_inverse=True)
        favour = np.bincount(part, here["impact"] * np.repeat(w[rare], n), minlength=len(doc)) * (self.ids[doc] != own)
        best = doc[np.argsort(-favour, kind="stable")[:most]][: np.count_nonzero(favour)]
        scores = self._exact(best).tolist()
        self.q[at] = 0
        return scores

    def search(self, own, terms: np.ndarray, idf: np.ndarray, k: int, least: float = 0.0) -> list[tuple[float, object]]:
        """The k best (-score, id) of a positive score that is `least` or more, without `own`."""
        return self.search_many([(own, terms, idf, least)], k)[0]

    def search_many(self, queries: list[tuple], k: int) -> list[list[tuple[float, object]]]:
        """`search` for each (own, terms, idf, least), or (own, terms, idf, least, last) for what comes before the row of score
        `least` and id `last`; up to TOGETHER at a time. Where no threshold is known the shard looks for one of its own."""
        for i, (own, terms, idf, least, *_) in enumerate(queries := list(queries)):
            if least <= 0 and len(some := sorted(self.seeds(own, terms, idf, k))) == k:
                queries[i] = own, terms, idf, some[0]
        size = max(1, min(TOGETHER, SUM_CELLS // len(self.ids)))
        return [best for c in range(0, len(queries), size) for best in self._together(queries[c : c + size], k)]

    def _rare(self, at: np.ndarray, idf: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Sums of n queries (rows) for all documents over the terms that have no column, by their postings."""
        docs = len(self.ids)
        sums = np.empty((n, docs), np.float32)
        for i in range(0, n, RARE_TOGETHER):
            these = slice(*np.searchsorted(of, (i, i + RARE_TOGETHER)))
            df = self.df[at[these]]
            here = self._postings(at[these], df)
            cell, score = np.repeat((of[these] - i) * docs, df), np.repeat(idf[these], df)
            cell += here["doc"]
            score *= here["impact"]
            rows = min(RARE_TOGETHER, n - i)
            sums[i : i + rows] = np.bincount(cell, score, minlength=rows * docs).reshape(rows, docs)
        return sums

    def _together(self, queries: list[tuple], k: int) -> list[list[tuple[float, object]]]:
        n, of = len(queries), np.repeat(np.arange(len(queries)), [len(q[1]) for q in queries])
        terms, w = np.concatenate([q[1] for q in queries]), np.concatenate([q[2] for q in queries])
        order, at = np.argsort(terms), np.empty(len(terms), np.int64)
        at[order] = np.searchsorted(self.terms, terms[order])
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == terms
        at, w, of = at[hit], w[hit], of[hit]
        column = self.column[at]
        common = column >= 0
        weight = np.zeros((n, self.common.shape[1]), np.float32)
        weight[of[common], column[common]] = w[common]
        least = np.array([q[3] for q in queries], float)
        reach = (weight @ self.common_most.T).astype(float) / (1 - self.off)
        # postings are read for queries that could reach their threshold if one document had all of the largest impacts
        able = reach.max(1) + np.bincount(of[~common], w[~common] * self.most[at[~common]], minlength=n) / (1 - self.off) >= least * (1 - 1e-12)
        these = ~common & able[of]
        rare = self._rare(at[these], w[these], of[these], n)
        reach += np.maximum.reduceat(rare, self.blocks, axis=1) / (1 - self.off)
        keep = (reach >= least[:, None] * (1 - 1e-12)) & (reach > 0)
        self.skipped, self.read = self.skipped + int((~keep).sum()), self.read + int(keep.sum())
        # a sum is off by a share of at most `off`: exact scores are for those that may be of the k best
        bar = np.maximum(least * (1 - self.off) * (1 - 1e-6), np.finfo(np.float32).smallest_subnormal).astype(np.float32)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        for b in np.flatnonzero(keep.any(0)):
            rows, block = np.flatnonzero(keep[:, b]), slice(self.blocks[b], self.blocks[b + 1] if b + 1 < len(self.blocks) else len(self.ids))
            sums = weight[rows] @ self.common[block].T
            sums += rare[rows, block]
            i, d = np.nonzero(sums >= bar[rows, None])
            if len(i):
                found.append((rows[i], d + block.start, sums[i, d]))
        row, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        doc, score, cut, own_terms = doc[order], score[order].astype(float), np.searchsorted(row[order], np.arange(n + 1)), np.searchsorted(of, np.arange(n + 1))
        out: list = [[] for _ in queries]
        for i in np.flatnonzero(np.diff(cut)):
            own, _, _, known, *last = queries[i]
            some, sums = doc[cut[i] : cut[i + 1]], score[cut[i] : cut[i + 1]]
            other = self.ids[some] != own
            some, sums = some[other], sums[other]
            if len(some) > k:
                some = some[sums >= max(known, float(np.partition(sums, len(some) - k)[len(some) - k]) * (1 - self.off) ** 2) * (1 - self.off) * (1 - 1e-6)]
            these = slice(own_terms[i], own_terms[i + 1])
            self.q[at[these]] = w[these]
            best = sorted((-s, d) for s, d in zip(self._exact(some).tolist(), self.ids[some].tolist(), strict=True) if s > 0 and s >= known * (1 - 1e-12))
            self.q[at[these]] = 0
            if last:  # equal sums are equal to the last bit: they are of the same numbers in the same order
                best = [x for x in best if x < (-known, last[0])]
            out[i] = best[:k]
        return out


def search(spark: SparkSession, docs: DataFrame, queries: Column, k: int = 10, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, shard_postings: int = SHARD_POSTINGS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """query_id, rank, `id_col` and score: the k best rows for each row for which `queries` holds, whose whole text is
    the query, each of its terms once.

    Score: the sum over common terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b *
    length / mean length)), with N, df and the mean length of the whole table. Rows with the query's own id are left out;
    ties go to the smaller id; fewer rows where fewer share a term. Rows with a null id take no part, null texts are
    empty and match nothing; repeated rows count each (a repeated query is one, and of several texts with one id the least
    is the query); an empty table gives an empty table; further columns are not read.
    """
    prepared(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(queries, F.lit(False)).alias("asks"))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t) for t in column_bytes(batch, "text")]
            yield batch_of(id=batch.column(0), term=pa.array([t.view(np.int64) for t, _ in found], pa.list_(pa.int64())), n=pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())))

    def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(id=batch.column(0), terms=pa.array([terms_of(t)[0].view(np.int64) for t in column_bytes(batch, "text")], pa.list_(pa.int64())))

    # texts are taken apart once: their terms and counts are a table in the shared folder that all rounds read
    place = (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    level = F.least(F.floor(-F.log(ROUND, place)), F.lit(ROUNDS - 1)).cast("int")
    parsed, kept = map_arrow(rows.select("id", "text"), taken, f"id {kind}, term array<long>, n array<int>"), shared_dir(spark, "terms")
    parsed.withColumn("level", level).write.partitionBy("level").parquet(kept)
    held = spark.read.schema(f"id {kind}, term array<long>, n array<int>, level int").parquet(kept)
    counted = materialise(spark, held.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    length = F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y)
    levels = held.groupBy("level").agg(F.count("*").alias("rows"), F.coalesce(F.sum(length), F.lit(0)).alias("words"), F.coalesce(F.sum(F.size("n").cast("long")), F.lit(0)).alias("postings")).collect()
    n, words = sum(r["rows"] for r in levels), sum(r["words"] for r in levels)
    average = words / n if n else 0.0
    asked = map_arrow(rows.where("asks").groupBy("id").agg(F.min("text").alias("text")), query_terms, f"id {kind}, terms array<long>")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.select("id", F.explode("terms").alias("term")).join(counted.select("term", idf.alias("idf")), "term")
    each = weighted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms"))  # one text's terms
    untold = shared_dir(spark, "queries")
    each.select("id", F.col("terms.term").alias("term"), F.col("terms.idf").alias("idf"), F.lit(0.0).alias("least"), F.lit(None).cast(kind).alias("last")).write.parquet(untold)

    def over_shards(part: DataFrame, source: str, turn: int, turns: int) -> DataFrame:
        """The best of each shard of `part` for the queries (own, terms, idf, least, last) of a table in the shared folder,
        for those batches of them whose turn it is."""

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, parts, counts, size = [], [], [], 0

            def run() -> Iterator[pa.RecordBatch]:
                shard = Shard(ids, parts, counts, average, k1, b, block_docs)
                for x in (ids, parts, counts):
                    x.clear()
                store, base = pafs.FileSystem.from_uri(source)
                files = sorted(f.path for f in store.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet"))
                asked_of = pads.dataset(files, filesystem=store, format="parquet").to_batches(batch_size=TOGETHER, batch_readahead=1, fragment_readahead=1) if files else iter(())
                for q in islice(joined(asked_of, TOGETHER, QUERY_BYTES), turn, None, turns):
                    asked = []
                    ends = np.cumsum(q.column(1).value_lengths().to_numpy()).tolist()
                    terms, idf = np.asarray(q.column(1).flatten()).view(np.uint64), np.asarray(q.column(2).flatten())
                    for own, x, y, least, last in zip(q.column(0).to_pylist(), [0, *ends], ends, q.column(3).to_pylist(), q.column(4).to_pylist(), strict=False):
                        asked.append((own, terms[x:y], idf[x:y], least) if last is None else (own, terms[x:y], idf[x:y], least, last))
                    found = [(own, i, -s) for (own, *_), best in zip(asked, shard.search_many(asked, k), strict=True) for s, i in best]
                    yield batch_of(query_id=pa.array([x[0] for x in found], q.column(0).type), id=pa.array([x[1] for x in found], q.column(0).type), score=pa.array([x[2] for x in found], pa.float64()))

            for batch in batches:
                term, n = batch.column(1), batch.column(2)
                cuts = (np.asarray(term.offsets) - term.offsets[0].as_py()).tolist()
                t, c = np.asarray(term.flatten()).view(np.uint64), np.asarray(n.flatten())
                for i, x, y in zip(batch.column(0).to_pylist(), cuts, cuts[1:], strict=False):
                    if y > x:
                        ids.append(i)
                        parts.append(t[x:y])
                        counts.append(c[x:y])
                        size += y - x
                    if size >= shard_postings:
                        yield from run()
                        size = 0
            if ids:
                yield from run()

        return map_arrow(part.select("id", "term", "n"), shards, f"query_id {kind}, id {kind}, score double")

    # the deepest levels that fill a shard together are the first round, each other one is a round
    per, rounds, deepest = max(1, shard_postings * 3 // 4), [], 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        deepest += r["postings"]
        if rounds:
            rounds.append((F.col("level") == r["level"], r["postings"]))
        elif deepest >= per or r["level"] == min(x["level"] for x in levels):
            rounds.append((F.col("level") >= r["level"], deepest))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best, told, asking = spark.createDataFrame([], f"query_id {kind}, id {kind}, score double, rank int"), untold, spark.read.schema(f"id {kind}").parquet(untold).count()
    for i, (of, postings) in enumerate(rounds):
        tasks = -(-postings // per) or 1
        turns = max(1, min(-(-asking // TASK_QUERIES), -(-TASKS // tasks)))
        found = reduce(DataFrame.unionByName, [over_shards(held.where(of).coalesce(tasks), told, turn, turns) for turn in range(turns)])
        best = (best.drop("rank").unionByName(found) if i else found).withColumn("rank", rank).where(F.col("rank") <= k)
        if i + 1 < len(rounds):
            best, told = materialise(spark, best, "best"), shared_dir(spark, "thresholds")
            known = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"), F.col("id").alias("last"))
            asked = spark.read.schema(f"id {kind}, term array<long>, idf array<double>, least double, last {kind}").parquet(untold)
            asked.select("id", "term", "idf").join(known, "id", "left").select("id", "term", "idf", F.coalesce("least", F.lit(0.0)).alias("least"), "last").write.parquet(told)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op7_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)

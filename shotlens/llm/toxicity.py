"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes,
and a monotone calibration of them on the examples themselves, each left out in turn.

The vector space is every term of the examples. A term's weight is its TF-IDF times a factor that rises with the
strength of its link to the label, so that texts meet by what matters for it; no term is left out, and a text with none
of the telling terms still has neighbours, by all its other terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.llm.common import batch_of, column_bytes, column_list, crc_fold, map_arrow, places, prepared, table, trim
from shotlens.session import materialise

#: Labelled documents that the model is fitted on at most (by the hash of their ids), and characters of their texts together:
#: both bound what is broadcast.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 16_000_000
#: Least factor of a term's weight; its log-likelihood ratio with the label counts against 2 ln(terms / CHANCE), which about
#: CHANCE terms reach by accident.
LEAST, CHANCE = 0.02, 0.1
#: Neighbours, examples of an index block, blocks that a search reads first.
NEIGHBOURS, BLOCK, FIRST = 15, 128, 2
#: What keeps the weight of a neighbour at distance 0 finite, votes of the base rate.
NEAR, PRIOR = 0.05, 0.5
PREFIXES = (5,)
THRESHOLD, CACHE = 0.7, 300_000
LETTERS = regex.compile(r"\p{L}+")


def terms_of(text: str) -> list[str]:
    """Words, and the beginnings of longer words (with a hyphen), so that inflected forms meet."""
    words = LETTERS.findall(text.lower())
    return words + [w[:n] + "-" for w in words for n in PREFIXES if len(w) > n]


class Index:
    """Block-max inverted index of unit vectors (terms rising, weights) with their ids and labels. Examples are sorted by
    their strongest terms, so that a block's are alike. A term's postings are in the order of the examples; for each
    block of BLOCK examples that it is in there is a cell with its largest weight there and the place of its postings."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list, labels: np.ndarray, terms: int):
        order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:8]].tolist(), ids[i]))
        self.ids, self.labels = [ids[i] for i in order], np.asarray(labels, float)[order]
        self.rank = np.argsort(np.array(sorted(range(len(order)), key=lambda at: self.ids[at]), np.int64))  # place of each id
        self.size = np.array([len(vectors[i][0]) for i in order])
        self.begin = np.cumsum(self.size) - self.size
        self.term = np.concatenate([vectors[i][0] for i in order]).astype(np.int32)
        self.weight = np.concatenate([vectors[i][1] for i in order])
        turned = np.argsort(self.term, kind="stable")
        self.doc = np.repeat(np.arange(len(order), dtype=np.int32), self.size)[turned]
        self.by_term = self.weight[turned]
        by = self.term[turned]
        self.posting = np.flatnonzero(np.concatenate([[True], (np.diff(by) != 0) | (np.diff(self.doc // BLOCK) != 0)]))  # first posting of each cell
        self.postings = np.diff(np.append(self.posting, len(by)))
        self.block = (self.doc[self.posting] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.by_term, self.posting)
        self.cells = np.bincount(by[self.posting], minlength=terms)
        self.cell = np.cumsum(self.cells) - self.cells  # first cell of each term

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples of a cosine above 0, ties to the smaller id; `skip` is a
        position to leave out.

        The cells of the query's terms bound what the examples of a block can reach. Blocks are read from the highest
        bound down: the FIRST, and then at once all that can reach the k-th cosine found there. A cosine is the
        sum over the common terms in their order, so that equal examples have equal ones."""
        if not len(terms):
            return np.empty(0, int), np.empty(0)
        n = self.cells[terms]
        cells, w = places(self.cell[terms], n), np.repeat(weights, n)
        block = self.block[cells]
        bound = np.bincount(block, self.most[cells] * w)
        order = np.argsort(-bound, kind="stable")
        score, read, more, kth = np.zeros(len(self.labels)), 0, FIRST, 0.0
        while read < len(order) and bound[order[read]] > 0 and bound[order[read]] * (1 + 1e-9) >= kth:
            now = np.zeros(len(bound), bool)
            now[order[read : read + more]] = True
            now &= bound * (1 + 1e-9) >= kth
            own = now[block]
            sizes = self.postings[cells[own]]
            here = places(self.posting[cells[own]], sizes)
            score += np.bincount(self.doc[here], self.by_term[here] * np.repeat(w[own], sizes), minlength=len(score))
            if skip >= 0:
                score[skip] = 0
            read, more = read + more, len(order)
            kth = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        at = np.flatnonzero((score > 0) & (score >= kth))  # ties at the end are in
        best = at[np.lexsort((self.rank[at], -score[at]))[:k]]
        return best, score[best]


@dataclass
class Model:
    """Bounded by SAMPLE_DOCS and SAMPLE_CHARS, so that it can be broadcast."""

    term_no: dict[str, int]
    factor: np.ndarray  # of each term: IDF, times what its link to the label gives
    index: Index | None
    base: float  # share of label 1 among the examples
    none: float  # the same among those that have no term
    steps: np.ndarray = field(default_factory=lambda: np.array([-np.inf]))  # votes at which the calibrated score changes
    values: np.ndarray = field(default_factory=lambda: np.array([0.0]))

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.factor[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(terms) else w

    def votes(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        at, cos = self.index.nearest(terms, weights, NEIGHBOURS, skip)
        w = cos / (1 - np.minimum(cos, 1) + NEAR)
        return float((w @ self.index.labels[at] + PRIOR * self.base) / (w.sum() + PRIOR)), at, cos

    def score(self, votes: float) -> float:
        return float(self.values[max(0, np.searchsorted(self.steps, votes, side="right") - 1)])


def calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a rising step function from votes to the share of label 1, drawn in by one vote of each."""
    order = np.argsort(votes, kind="stable")
    blocks: list[list[float]] = []
    for v, y in zip(votes[order], labels[order], strict=True):
        if blocks and blocks[-1][3] == v:
            blocks[-1][1] += y
            blocks[-1][2] += 1
        else:
            blocks.append([v, y, 1, v])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, y2, n2, last = blocks.pop()
            blocks[-1][1] += y2
            blocks[-1][2] += n2
            blocks[-1][3] = last
    return np.array([b[0] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


class Terms:
    """Numbers of a text's terms, as int32; pieces between white space are kept in a cache of bounded size."""

    def __init__(self, term_no: dict[str, int]):
        coded = zip(term_no, np.array(list(term_no.values()), np.int32).reshape(-1, 1), strict=True)
        self.no = {t: n.tobytes() for t, n in coded}
        self.begins = {t[:-1]: n for t, n in self.no.items() if t[-1] == "-"}
        self.cache: dict[bytes, bytes] = {}

    def of(self, text: bytes) -> np.ndarray:
        cache, words = self.cache, text.split()
        trim(cache, CACHE)
        word, begin = self.no.get, self.begins.get
        for w in set(words).difference(cache):
            bare = w.rstrip(b".,;:!?").decode("utf-8", "replace").lower()
            if not bare.isalpha():
                cache[w] = b"".join([word(t, b"") for t in terms_of(w.decode("utf-8", "replace"))])
                continue
            found = word(bare, b"")  # one word, as most pieces are, has its terms at once
            for n in PREFIXES:
                if len(bare) > n:
                    found += begin(bare[:n], b"")
            cache[w] = found
        return np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32)


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far a term in a documents of label 1 and b of label 0 departs from the shares n1 and n0."""
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(e, 1e-9)), 0.0)
    e1, e0 = (a + b) * (n1 / (n1 + n0)), (a + b) * (n0 / (n1 + n0))
    return np.maximum(0, 2 * (part(a, e1) + part(b, e0) + part(n1 - a, n1 - e1) + part(n0 - b, n0 - e0)))


def terms_and_counts(finder: Terms, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The terms of each text, rising, and how often each is in it."""
    found = [np.unique(finder.of(t), return_counts=True) for t in texts]
    return [f[0] for f in found], [f[1] for f in found]


def packed(parts: list[np.ndarray]) -> pa.Array:
    """Each array as the bytes of its int32: far less work for Spark than lists of numbers."""
    return pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary())


def unpacked(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in b.column(b.schema.get_field_index(name)).to_pylist()]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, keep: tuple[str, ...] = ()) -> tuple[Model, DataFrame | None]:
    """The model, and the documents as rows of their terms (id, the columns in `keep`, __terms, __counts, and __sums, which marks
    rows that sum up a task), by which score_counted scores them without taking their texts apart again. None without a label.

    Index at most `sample_docs` labelled documents (those where `train` holds; an id with several labels counts as 1 if
    any is; of equal texts with one label one stays), in the order of a hash until their whole texts come to
    `sample_chars` characters. All of their terms count; document frequencies for the IDF are counted over all documents."""
    prepared(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = known.select("id", "y", F.xxhash64("id").alias("order")).orderBy("order", "id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id")  # sample_docs rows at most are broadcast
    once = joined.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min(F.struct("order", "id")).alias("x"), F.min_by("text", F.struct("order", "id")).alias("text"))
    examples = materialise(spark, once.select("x.*", "y", "text").coalesce(spark.sparkContext.defaultParallelism), "examples")
    sizes = examples.select("order", F.length("text").alias("n")).orderBy("order").toArrow()  # sample_docs rows, or few more where ids repeat
    fits = np.cumsum(sizes.column("n").to_numpy()) <= sample_chars
    if not fits.all():
        last = int(sizes.column("order")[max(0, int(fits.sum()) - 1)].as_py())
        examples = examples.where(F.col("order") <= last)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        docs_of = [0, 0]
        for b in batches:
            for y, text in zip(column_list(b, "y"), column_list(b, "text"), strict=True):
                seen[y].update(set(terms_of(text)))
                docs_of[y] += 1
        every = list(seen[0].keys() | seen[1].keys())
        yield batch_of(term=pa.array(["", *every]), a=pa.array([docs_of[1], *(seen[1][t] for t in every)], pa.int64()), b=pa.array([docs_of[0], *(seen[0][t] for t in every)], pa.int64()))

    counted = map_arrow(examples, count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()  # the terms of sample_chars characters
    counted = counted.sort_by("term")
    every, a, b = counted.column("term").to_pylist(), counted.column("a").to_numpy().astype(float), counted.column("b").to_numpy().astype(float)
    n1, n0 = (int(a[0]), int(b[0])) if every and every[0] == "" else (0, 0)
    base = (n1 + 0.5) / (n1 + n0 + 1)
    no = {t: i for i, t in enumerate(every[1:])}
    if not n1 or not n0 or not no:
        return Model({}, np.empty(0), None, base, base, values=np.array([base])), None
    vocabulary = spark.sparkContext.broadcast(no)

    base_rows = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kept = [f for f in base_rows.schema if f.name != "__text"]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its terms; last, for the whole task, the number of rows (as that of term -1) and of rows with each term."""
        finder, df, n, kinds = Terms(vocabulary.value), np.zeros(len(vocabulary.value), np.int64), 0, None
        for b in batches:
            terms, tf = terms_and_counts(finder, column_bytes(b, "__text"))
            for t in terms:
                df[t] += 1
            n += len(terms)
            own = [(x.name, b.column(i)) for i, x in enumerate(b.schema) if x.name != "__text"]
            kinds = {name: col.type for name, col in own}
            yield batch_of(**dict(own), __terms=packed(terms), __counts=packed(tf), __sums=pa.array([False] * len(terms)))
        if n:
            hit = np.flatnonzero(df)
            yield batch_of(**{name: pa.nulls(1, kind) for name, kind in kinds.items()}, __terms=packed([np.concatenate([[-1], hit])]), __counts=packed([np.concatenate([[n], df[hit]])]), __sums=pa.array([True]))

    rows_of = map_arrow(base_rows, frequencies, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", __terms binary, __counts binary, __sums boolean")
    rows_of = materialise(spark, rows_of, "terms", compression="zstd")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, n in zip(unpacked(b, "__terms"), unpacked(b, "__counts"), strict=True):
                yield batch_of(term=pa.array(t, pa.int32()), n=pa.array(n.astype(np.int64)))

    per_task = map_arrow(rows_of.where("__sums").select("__terms", "__counts"), sums, "term int, n long")
    got = per_task.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the examples
    df = np.zeros(len(no) + 1)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()  # the last place has the number of documents
    telling = likelihood_ratio(a[1:], b[1:], n1, n0) / (2 * np.log(len(no) / CHANCE))
    factor = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * (LEAST + telling**4 / (1 + telling**4))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Terms(vocabulary.value)
        for b in batches:
            yield batch_of(id=b.column(b.schema.get_field_index("id")), y=b.column(b.schema.get_field_index("y")), terms=pa.array([finder.of(t) for t in column_bytes(b, "text")], pa.list_(pa.int32())))

    rows = map_arrow(examples, numbers, f"id {kind}, y int, terms array<int>").toArrow()  # the examples
    model = Model(no, factor, None, base, base)
    ids, y = rows.column("id").to_pylist(), rows.column("y").to_numpy().astype(float)
    found = [model.vector(*np.unique(np.asarray(t.values), return_counts=True)) for t in rows.column("terms")]
    some = [i for i, v in enumerate(found) if len(v[0])]
    empty = [i for i, v in enumerate(found) if not len(v[0])]
    model.none = (y[empty].sum() + 0.5) / (len(empty) + 1) if empty else base
    model.index = Index([found[i] for i in some], [ids[i] for i in some], y[some], len(no))
    shared = spark.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ix = m.index
        for b in batches:
            at = b.column(0).to_pylist()
            own = [slice(ix.begin[i], ix.begin[i] + ix.size[i]) for i in at]
            vectors = [(ix.term[x], ix.weight[x]) for x in own]
            yield batch_of(at=b.column(0), votes=pa.array([m.votes(*v, skip=i)[0] for i, v in zip(at, vectors, strict=True)], pa.float64()))

    votes = map_arrow(spark.range(len(model.index.ids)), left_out, "at long, votes double").toArrow().sort_by("at")  # the examples
    model.steps, model.values = calibrate(votes.column("votes").to_numpy(), model.index.labels)
    for done in (vocabulary, shared):  # every table that was made with them is written or collected
        done.destroy()
    return model, rows_of


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id (and the columns in `keep`), score, predicted, and the evidence: neighbours array<struct<id, cosine, label>>.

    A text without any term of the examples (null and empty ones too) gets the share of label 1 among such examples
    and no neighbours. Of examples at one cosine those of the smaller ids are neighbours. Ids may be of any type; null
    ids stay null; repeated rows are scored each; an empty table gives an empty table; other columns are not read.
    """
    prepared(spark)
    shared: Broadcast = spark.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        finder = Terms(m.term_no)
        for b in batches:
            texts = column_bytes(b, "__text")
            yield _scored(m, b, ("__text",), *(terms_and_counts(finder, texts) if m.index else ([np.empty(0, int)] * len(texts),) * 2), threshold)

    return map_arrow(base, run, _scored_schema(base, ("__text",), id_col))


def score_counted(spark: SparkSession, rows: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """What score_documents gives, for the rows of terms that fit has made of the same documents."""
    prepared(spark)
    shared: Broadcast = spark.sparkContext.broadcast(model)
    taken = ("__terms", "__counts", "__sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _scored(shared.value, b, taken, unpacked(b, "__terms"), unpacked(b, "__counts"), threshold)

    rows = rows.where("NOT __sums")
    return map_arrow(rows, run, _scored_schema(rows, taken, id_col))


def _scored_schema(rows: DataFrame, without: tuple[str, ...], id_col: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in without]
    return ", ".join([*kept, f"score double, predicted int, neighbours array<struct<id:{rows.schema[id_col].dataType.simpleString()},cosine:double,label:int>>"])


def _scored(m: Model, b: pa.RecordBatch, without: tuple[str, ...], terms: list[np.ndarray], tf: list[np.ndarray], threshold: float) -> pa.RecordBatch:
    """A batch (id first) with score, predicted and neighbours in place of the columns `without`."""
    scores, at, cos = [], [], []
    for t, n in zip(terms, tf, strict=True):
        votes, a, c = m.votes(*m.vector(t, n)) if len(t) else (0.0, np.empty(0, int), np.empty(0))
        scores.append(m.score(votes) if len(t) else m.none)
        at.append(a)
        cos.append(c)
    every = np.concatenate([*at, np.empty(0, int)])
    ids = [m.index.ids[i] for i in every] if m.index else []
    near = pa.StructArray.from_arrays([pa.array(ids, b.column(0).type), pa.array(np.concatenate([*cos, np.empty(0)])), pa.array(m.index.labels[every] if m.index else [], pa.int32())], names=["id", "cosine", "label"])
    kept = {x.name: b.column(i) for i, x in enumerate(b.schema) if x.name not in without}
    scores = np.array(scores, float)
    return batch_of(**kept, score=pa.array(scores), predicted=pa.array((scores >= threshold).astype(np.int32)), neighbours=pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, at)]), pa.int32()), near))


def score_corpus(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fit on the labelled ones of the documents and score them all (see fit and score_documents)."""
    model, rows = fit(spark, docs, labels, train, id_col, text_col, keep=keep)
    return score_documents(spark, docs, model, id_col, text_col, threshold, keep) if rows is None else score_counted(spark, rows, model, id_col, threshold)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_fold(id_col, 3) == 1, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out()).select("doc_id", held_out().alias("held_out"), "score", "predicted", "neighbours")

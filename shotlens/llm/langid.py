"""Language identification: script ranges narrow the candidates of a word, character n-grams score it, and Viterbi with
a switching penalty labels the spans of a text that mixes languages."""

from __future__ import annotations

import functools
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlens.llm.common import batch_of, column_bytes, column_list, crc_fold, joined, map_arrow, pieces, prepared, table

#: First and last code point of the letters of each script that is told apart.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("arabic", 0xFB50, 0xFDFF), ("han", 0x20000, 0x3FFFF),
)
#: Documents of each language that the model is fitted on at most (by the hash of their ids), and characters of their whole
#: texts together (one text at least): both bound the model, which keeps every n-gram of them.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 3_000_000
#: Cost of a change of language between two words, share of a language's letters from which a script is one of its own,
#: worst score of a word against the best language (so that one odd word doesn't decide), words in the cache.
SWITCH, OWN_SCRIPT, FLOOR, CACHE = 8.0, 0.01, -12.0, 100_000
#: Texts that are labelled at a time and bytes of them (or one longer text), and new words scored at a time.
TEXTS, TEXT_BYTES, NEW_WORDS = 2000, 1 << 23, 16_384
#: Bytes of a text that are split at a time, and words whose letters are counted at a time.
PIECE, PLACES = 1 << 20, 1 << 20
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")


@functools.lru_cache(4096)
def script_of(char: str) -> str:
    c = ord(char)
    return next((s for s, a, b in SCRIPTS if a <= c <= b), "other")


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [*word, *(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2))]


@dataclass
class Model:
    """Bounded by SAMPLE_CHARS for each language, so that it can be broadcast."""

    langs: list[str]
    gram_no: dict[str, int]
    logp: np.ndarray  # (n-grams + 1, languages); the last row is for n-grams not seen
    scripts: dict[str, np.ndarray]  # for each script which languages use it


def fit(spark: SparkSession, docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Count character n-grams and scripts in whole texts of each language among the rows where `train` holds and the
    language is not null: at most `sample_docs` of them, in the order of a hash, until they come to `sample_chars`."""
    prepared(spark)
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # a language may hold most rows: a hash cuts each down to some more than sample_docs before they are ranked
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    near = rows.select("id", "lang", place.alias("place"), F.length("text").alias("size")).join(F.broadcast(sizes), "lang")  # a row for each language, as in the model
    near = near.where(F.col("place") * F.col("n") <= sample_docs + 6 * sample_docs**0.5)
    order = Window.partitionBy("lang").orderBy("place", "id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs)
    chosen = ranked.withColumn("all", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where((F.col("all") <= sample_chars) | (F.col("rank") == 1)).select("id", "lang").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for lang, text in zip(column_list(b, "lang"), column_list(b, "text"), strict=True):
                for word, n in Counter(LETTERS.findall(text.lower())).items():
                    for g in grams(word):
                        seen[lang, "g" + g] += n
                    seen[lang, "s" + script_of(word[0])] += n * len(word)
        if seen:
            yield batch_of(lang=pa.array([k[0] for k in seen]), feature=pa.array([k[1] for k in seen]), n=pa.array(list(seen.values()), pa.int64()))

    sampled = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi")  # sample_docs rows a language
    counted = map_arrow(sampled, count, "lang string, feature string, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = counted.toArrow().to_pydict()  # the n-grams of sample_chars characters of each language
    langs = sorted(set(got["lang"]))
    at = {lang: i for i, lang in enumerate(langs)}
    total: Counter = Counter()
    letters: dict[str, np.ndarray] = {}
    for lang, f, n in zip(got["lang"], got["feature"], got["n"], strict=True):
        if f[0] == "g":
            total[f[1:]] += n
        else:
            letters.setdefault(f[1:], np.zeros(len(langs)))[at[lang]] += n
    no = {g: i for i, g in enumerate(sorted(total, key=lambda g: (-total[g], g)))}
    counts = np.zeros((len(no) + 1, len(langs)))
    for lang, f, n in zip(got["lang"], got["feature"], got["n"], strict=True):
        if f[0] == "g" and f[1:] in no:
            counts[no[f[1:]], at[lang]] += n
    logp = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts))) if langs else counts
    share = sum(letters.values()) if letters else np.zeros(len(langs))
    return Model(langs, no, logp, {s: v >= OWN_SCRIPT * np.maximum(share, 1) for s, v in letters.items()})


class Labeller:
    """Numbers of words with their scores, kept for a bounded number of words, and Viterbi over many texts at a time."""

    def __init__(self, model: Model, switch: float):
        self.m, self.switch = model, switch
        self.chunks: dict[bytes, bytes] = {}  # what white space separates: the numbers of its words
        self.words: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)))
        self.size, self.count = np.zeros(0), 0

    def _add(self, chunks: list[bytes]) -> None:
        words, new = self.words, []
        for chunk in chunks:
            bare = chunk.rstrip(b".,;:!?")
            found = (bare.decode().lower(),) if bare.isalpha() else LETTERS.findall(chunk.decode("utf-8", "replace").lower())
            numbers = array("i")
            for w in found:
                n = words.get(w)
                if n is None:
                    n = words[w] = len(words)
                    new.append(w)
                numbers.append(n)
            self.chunks[chunk] = numbers.tobytes()
        for k in range(0, len(new), NEW_WORDS):
            self._score(new[k : k + NEW_WORDS])

    def _score(self, words: list[str]) -> None:
        get, flat, starts = self.m.gram_no.get, [], []
        for w in words:
            starts.append(len(flat))
            flat += [get(g, -1) for g in grams(w)]
        score = np.add.reduceat(self.m.logp[flat], starts, axis=0)
        for k, w in enumerate(words):  # languages that don't use the word's script are out, unless none does
            own = self.m.scripts.get(script_of(w[0]))
            if own is not None and not own.all() and own.any():
                score[k, ~own] = score[k, own].max() + FLOOR
        score = np.maximum(score - score.max(1, keepdims=True), FLOOR)
        end = self.count + len(words)
        if end > len(self.scores):  # room grows by halves
            room = max(end, 3 * len(self.scores) // 2)
            self.scores = np.concatenate([self.scores, np.zeros((room - len(self.scores), self.scores.shape[1]))])
            self.size = np.concatenate([self.size, np.zeros(room - len(self.size))])
        self.scores[self.count : end], self.size[self.count : end], self.count = score, [len(w) for w in words], end

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each text the letters that got each language, and the labels of its words."""
        if len(self.words) > CACHE or len(self.chunks) > 2 * CACHE:
            self.chunks.clear()
            self.words.clear()
            self.scores, self.size, self.count = self.scores[:0], self.size[:0], 0
        return self._viterbi([self._numbers(t) for t in texts] if max(map(len, texts), default=0) > PIECE else self._numbers_of_all(texts))

    def _numbers_of_all(self, texts: list[bytes]) -> list[np.ndarray]:
        chunks = self.chunks
        split = [t.split() for t in texts]
        new: set[bytes] = set()
        for words in split:
            new.update([w for w in set(words) if w not in chunks])
        self._add(list(new))
        get = chunks.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]

    def _numbers(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, a piece of it at a time."""
        return np.concatenate([np.empty(0, np.int32), *(x for piece in pieces(text, PIECE) for x in self._numbers_of_all([piece]))])

    def _viterbi(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Back-pointers are one block of a byte (two above 127 languages) for each word and language."""
        langs = len(self.m.langs)
        kind = np.int8 if langs < 128 else np.int16
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        lengths = np.array([len(seqs[i]) for i in order], np.int64)
        letters = np.zeros((len(seqs), langs))
        top = int(lengths[0]) if len(lengths) else 0
        words = seqs[order[0]] if len(order) == 1 else np.concatenate([seqs[i] for i in order]) if top else np.empty(0, np.int32)
        start = np.cumsum(lengths) - lengths
        state = np.zeros((len(order), langs))
        came = np.empty((len(words), langs), kind)  # by place, then text
        own, row = np.arange(langs, dtype=kind), np.arange(len(order))
        n, at = len(order), 0
        for t in range(top):
            while lengths[n - 1] <= t:  # texts with a word at this place
                n -= 1
            s = state[:n]
            best = s.argmax(1)
            other = s[row[:n], best] - self.switch
            jump = s < other[:, None]
            came[at : at + n] = np.where(jump, best[:, None].astype(kind), own)
            at += n
            state[:n] = np.where(jump, other[:, None], s) + self.scores[words[start[:n] + t]]
        out = np.empty(len(words), kind)
        now = state.argmax(1)
        n = 0
        for t in range(top - 1, -1, -1):
            while n < len(order) and lengths[n] > t:
                n += 1
            out[start[:n] + t] = now[:n]
            at -= n
            now[:n] = came[at + row[:n], now[:n]]
        labels = [out[:0]] * len(order)
        for k, i in enumerate(order):
            labels[i] = part = out[start[k] : start[k] + lengths[k]]
            for a in range(0, len(part), PLACES):
                letters[i] += np.bincount(part[a : a + PLACES], weights=self.size[words[start[k] + a : start[k] + min(a + PLACES, len(part))]], minlength=langs)
        return letters, labels


def groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in their order, TEXTS and TEXT_BYTES at a time."""
    part, size = [], 0
    for t in texts:
        if part and (len(part) >= TEXTS or size + len(t) > TEXT_BYTES):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def identify(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id (and the columns in `keep`), lang_pred (the language of most letters; of equal ones the first by name),
    score (its share of the letters: no probability), and with `spans` the runs of words with one label.

    A task holds TEXTS texts and TEXT_BYTES of them, or one longer text; for these, each word takes 8 bytes and one more for
    each language, and each different word its text and a score for each language.

    Null texts, texts without a letter and every text under a model without languages get `und` and score 0; null ids
    stay null; repeated rows are labelled each; an empty table gives an empty table; other columns are not read.
    """
    prepared(spark)
    shared: Broadcast = spark.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__text"), "lang_pred string", "score double", *(["spans array<struct<lang:string,first_word:int,words:int>>"] if spans else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labeller = Labeller(m, switch) if m.langs else None
        for b in joined(batches, TEXTS, TEXT_BYTES):
            texts = column_bytes(b, "__text")
            if labeller:
                parts = [labeller.label(part) for part in groups(texts)]
                letters, labels = np.concatenate([p[0] for p in parts] or [np.zeros((0, len(m.langs)))]), [x for p in parts for x in p[1]]
                whole = letters.sum(1)
                best = letters.argmax(1)
                pred = [m.langs[k] if n else UNKNOWN for k, n in zip(best, whole, strict=True)]
                score = letters[np.arange(len(texts)), best] / np.maximum(whole, 1)
            else:
                labels, pred, score = [np.empty(0, np.int16)] * len(texts), [UNKNOWN] * len(texts), np.zeros(len(texts))
            cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != "__text"]
            cols += [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            names = [n for n in b.schema.names if n != "__text"] + ["lang_pred", "score"]
            if spans:
                found = []
                for x in labels:
                    cuts = np.flatnonzero(np.diff(x)) + 1 if len(x) else np.empty(0, int)
                    edges = [0, *cuts.tolist(), len(x)] if len(x) else []
                    found.append([{"lang": m.langs[x[p]], "first_word": p, "words": q - p} for p, q in zip(edges, edges[1:], strict=False)])
                cols.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(base, run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_fold(id_col, 4) == 2, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs, ~held_out())
    return identify(spark, docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

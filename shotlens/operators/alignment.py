"""Monotone alignment of subtitle segments with dialogue segments: a dynamic program, one movie at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.functions.text import normalize_for_match
from shotlens.operators.similarity import least_recall


#: Pairs of spans, and cells of the spans' words, up to which a movie is matched as a whole (some 200 MB); longer ones are
#: matched row by row.
SMALL, SMALL_WORDS = 4_000_000, 16_000_000


@dataclass(frozen=True)
class AlignmentRules:
    raw_span: int = 4
    dialogue_span: int = 4
    skip_raw: float = 0.15
    skip_dialogue: float = 0.15
    least_score: float = 0.45
    confident: float = 0.60


def _spans(norms: list[str], longest: int) -> list[list[tuple[frozenset, int]]]:
    words = [n.split() for n in norms]
    return [[(frozenset(w for part in words[i : i + k] for w in part), sum(map(len, words[i : i + k]))) for k in range(1, min(longest, len(words) - i) + 1)] for i in range(len(words))]


def _score(a: tuple[frozenset, int], b: tuple[frozenset, int]) -> tuple[float, float, float, float, float]:
    both = len(a[0] & b[0])
    if not both:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    recall, precision = both / len(a[0]), both / len(b[0])
    f1 = 2 * recall * precision / (recall + precision)
    lengths = min(a[1], b[1]) / max(a[1], b[1])
    return max(0.0, min(1.0, 0.50 * recall + 0.35 * f1 + 0.15 * lengths)), recall, precision, f1, lengths


class _Matches:
    """Spans that can be matched, row by row. For each length of a dialogue span an index of words tells at which places
    such a span has the word: summed over a raw span's words it gives the overlaps with all places, and with them the
    scores of those that have words enough for `least_score`, by the sums that _score makes."""

    def __init__(self, raw: list[str], dialogue: list[str], rules: AlignmentRules):
        self.rules, self.rs, self.ds = rules, _spans(raw, rules.raw_span), _spans(dialogue, rules.dialogue_span)
        self.recall, self.m = least_recall(rules.least_score), len(dialogue)
        self.words, self.length = np.ones((2, rules.dialogue_span, self.m))
        where: dict[str, list[int]] = {}  # places of counts[b, j], as of one long row
        for j, spans in enumerate(self.ds):
            for b in range(rules.dialogue_span):
                words, length = spans[min(b, len(spans) - 1)]
                self.words[b, j], self.length[b, j] = len(words), length
                for w in words:
                    where.setdefault(w, []).append(b * self.m + j)
        self.where = {w: np.array(x, np.int32) for w, x in where.items()}
        self.found = self._all() if self.small(len(raw), self.m, len(where), rules) else None

    @staticmethod
    def small(n: int, m: int, words: int, rules: AlignmentRules) -> bool:
        return n * m * rules.raw_span * rules.dialogue_span <= SMALL and (rules.raw_span * n + rules.dialogue_span * m) * words <= SMALL_WORDS

    def _all(self) -> list[list[tuple[int, int, int, float]]]:
        """`of` for every row: the overlaps of all spans are one product, and the sums are those of `of`."""
        word = {w: v for v, w in enumerate(self.where)}
        n, a, b = len(self.rs), self.rules.raw_span, self.rules.dialogue_span
        mine, theirs = np.zeros((n, a, len(word)), np.float32), np.zeros((self.m, b, len(word)), np.float32)
        size, length, exists = np.ones((n, a, 1)), np.ones((n, a, 1)), np.zeros((n, a, 1), bool)
        for side, spans in ((mine, self.rs), (theirs, self.ds)):
            for i, parts in enumerate(spans):
                for k, (words, _) in enumerate(parts):
                    side[i, k, [word[w] for w in words if w in word]] = 1
        for i, parts in enumerate(self.rs):
            for k, (words, letters) in enumerate(parts):
                size[i, k], length[i, k], exists[i, k] = len(words), letters, True
        size, length, exists = size[:, None], length[:, None], exists[:, None]
        both = (mine.reshape(n * a, -1) @ theirs.reshape(self.m * b, -1).T).astype(float).reshape(n, a, self.m, b).transpose(0, 2, 1, 3)
        other_words, other = self.words.T[None, :, None, :], self.length.T[None, :, None, :]
        whole = (np.arange(self.m)[:, None] + np.arange(b) < self.m)[None, :, None, :]
        i, j, k, z = np.nonzero(exists & whole & (both >= np.maximum(1, np.ceil(self.recall * size))))
        both, size, length = both[i, j, k, z], size[i, 0, k, 0], length[i, 0, k, 0]
        recall, precision, other = both / size, both / other_words[0, j, 0, z], other[0, j, 0, z]
        f1 = 2 * recall * precision / (recall + precision)
        lengths = np.minimum(length, other) / np.maximum(length, other)
        score = np.maximum(0.0, np.minimum(1.0, 0.50 * recall + 0.35 * f1 + 0.15 * lengths))
        found: list[list] = [[] for _ in range(n)]
        for x in np.flatnonzero(score >= self.rules.least_score):
            found[i[x]].append((int(j[x]), int(k[x]) + 1, int(z[x]) + 1, float(score[x])))
        return found

    def of(self, i: int, upto: int) -> list[tuple[int, int, int, float]]:
        """(j, raw segments, dialogue segments, score) of row i in their order, for spans that end up to place `upto`."""
        if self.found is not None:
            return [x for x in self.found[i] if x[0] + x[2] <= upto]
        counts, seen, found = np.zeros((self.rules.dialogue_span, self.m), np.int16), set(), []
        long = counts.reshape(-1)
        for a, (words, length) in enumerate(self.rs[i], 1):
            for w in words - seen:
                if (at := self.where.get(w)) is not None:
                    long[at] += 1
            seen |= words
            need = max(1, math.ceil(self.recall * len(words)))
            some = np.flatnonzero(counts[-1, :upto] >= need)  # the longest span has most words
            for b in range(self.rules.dialogue_span if len(some) else 0):
                at = some[(some < upto - b) & (counts[b, some] >= need)]
                if not len(at):
                    continue
                both = counts[b, at].astype(float)
                recall, precision, other = both / len(words), both / self.words[b, at], self.length[b, at]
                f1 = 2 * recall * precision / (recall + precision)
                lengths = np.minimum(length, other) / np.maximum(length, other)
                score = np.maximum(0.0, np.minimum(1.0, 0.50 * recall + 0.35 * f1 + 0.15 * lengths))
                good = score >= self.rules.least_score
                found += zip(at[good].tolist(), [a] * int(good.sum()), [b + 1] * int(good.sum()), score[good].tolist(), strict=True)
        return sorted(found)


def _along(row: np.ndarray, move: np.ndarray, cost: float) -> None:
    """Skips along a row, in place: a cell takes what its left neighbour has less the cost if that is more. The sums are
    made one after the other, so that they are the same numbers as in a loop over the cells."""
    stays = np.flatnonzero(row[1:] < row[:-1] - cost) + 1  # where a neighbour that keeps its own sum is better
    k, m = 0, len(row)
    while k < len(stays):
        at, size = int(stays[k]) - 1, 64
        while True:  # from `at` on skips win, until a cell has as much of its own
            end = min(at + size, m - 1)
            run = np.full(end - at + 1, cost)
            run[0] = row[at]
            run = np.subtract.accumulate(run)
            own = np.flatnonzero(row[at + 1 : end + 1] >= run[1:])
            stop = at + 1 + int(own[0]) if len(own) else end + 1
            row[at + 1 : stop], move[at + 1 : stop] = run[1 : stop - at], 1
            if len(own) or end == m - 1:
                break
            at, size = end, 4 * size
        k = int(np.searchsorted(stays, stop + 1))


class _Rows:
    """The rows of sums that are still open, and their moves: 8 * raw + dialogue segments of the step into a cell, 0 for
    none. A row is complete when all before it are."""

    def __init__(self, matches: _Matches, n: int, m: int):
        self.matches, self.rules, self.n, self.m, self.i = matches, matches.rules, n, m, 0
        self.best = [np.full(m + 1, -np.inf) for _ in range(self.rules.raw_span + 1)]
        self.move = [np.zeros(m + 1, np.uint8) for _ in range(self.rules.raw_span + 1)]
        self.best[0][0] = 0.0

    def saved(self) -> tuple:
        return self.i, [x.copy() for x in self.best[:-1]], [x.copy() for x in self.move[:-1]]

    def restore(self, saved: tuple, upto: int) -> None:
        """Go back to a saved state, with the cells up to column `upto` only."""
        self.i, self.m = saved[0], upto
        self.best = [x[: upto + 1].copy() for x in saved[1]] + [np.full(upto + 1, -np.inf)]
        self.move = [x[: upto + 1].copy() for x in saved[2]] + [np.zeros(upto + 1, np.uint8)]

    def next(self) -> np.ndarray:
        """Complete row i and pass its sums on; its moves."""
        row, moves, i = self.best[0], self.move[0], self.i
        _along(row, moves, self.rules.skip_dialogue)
        if i < self.n:
            for j, a, b, s in self.matches.of(i, self.m):
                if row[j] + s > self.best[a][j + b]:
                    self.best[a][j + b], self.move[a][j + b] = row[j] + s, 8 * a + b
            down = row - self.rules.skip_raw
            better = down > self.best[1]
            self.best[1][better], self.move[1][better] = down[better], 8
        self.best = self.best[1:] + [np.full(self.m + 1, -np.inf)]
        self.move = self.move[1:] + [np.zeros(self.m + 1, np.uint8)]
        self.i += 1
        return moves


def align_spans(raw: list[str], dialogue: list[str], rules: AlignmentRules = AlignmentRules(), every: int | None = None) -> list[dict]:
    """Steps from the first segments to the last: match, skip_raw or skip_dialogue, with their ranges and scores.

    A cell keeps the first move that reaches its best sum; moves are tried in the order skip_raw, skip_dialogue, spans.
    Spans are of at most 7 segments. Moves are not kept for all cells: the open rows are saved at every `every`-th row, and
    on the way back one stretch of rows at a time is computed again, up to the column that the path has reached. With n raw
    and m dialogue segments that takes about 6 m sqrt(raw_span n) bytes, and the spans' words some 5 KB a segment; measured
    for 20,000 of each: 250 MB and 107 s."""
    if not 1 <= min(rules.raw_span, rules.dialogue_span) <= max(rules.raw_span, rules.dialogue_span) <= 7:
        raise ValueError("spans are of 1 to 7 segments")
    n, m = len(raw), len(dialogue)
    if not n or not m:
        return []
    every = every or math.ceil(math.sqrt(9 * rules.raw_span * n))
    matches = _Matches(raw, dialogue, rules)
    rows, saved = _Rows(matches, n, m), []
    first, moves = n + 1, []  # the stretch of rows whose moves are known
    if matches.found is not None:  # few cells: all moves are kept
        first, moves = 0, [rows.next() for _ in range(n + 1)]
    while rows.i < n:
        if rows.i % every == 0:
            saved.append(rows.saved())
        rows.next()
    steps, i, j = [], n, m
    while i or j:
        if i < first:
            k = min(i // every, len(saved) - 1)
            first = k * every
            rows.restore(saved[k], j)
            moves = [rows.next() for _ in range(i - first + 1)]
        a, b = divmod(int(moves[i - first][j]), 8)
        i, j = i - a, j - b
        step = {"type": "skip_raw" if not b else "skip_dialogue" if not a else "match", "raw_start": i if a else None, "raw_end": i + a - 1 if a else None, "dialogue_start": j if b else None, "dialogue_end": j + b - 1 if b else None}
        scores = _score(matches.rs[i][a - 1], matches.ds[j][b - 1]) if a and b else (None,) * 5
        steps.append(step | dict(zip(("match_score", "overlap_recall", "overlap_precision", "token_f1", "length_ratio"), scores, strict=True)) | {"is_confident_match": bool(a and b and scores[0] >= rules.confident)})
    return steps[::-1]


STEPS = "step_idx int, type string, raw_start int, raw_end int, dialogue_start int, dialogue_end int, match_score double, overlap_recall double, overlap_precision double, token_f1 double, length_ratio double, is_confident_match boolean"
ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def align(raw: DataFrame, dialogue: DataFrame, keys: Sequence[str], order: str, raw_text: str, dialogue_text: str, rules: AlignmentRules = AlignmentRules()) -> DataFrame:
    """Alignment steps of each movie: keys, step_idx and STEPS. A movie with an empty side has no steps.

    The recurrence of one movie runs in one task (some thousand segments); movies run in parallel. Segments of a movie lie
    side by side in a partition, in their order (equal `order`: by text), so that a task holds one movie at a time."""
    kinds = [(k, raw.schema[k].dataType.simpleString()) for k in keys]

    def movies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], list[str]]]:
        now, sides = None, ([], [])
        for batch in batches:
            for key, side, text in zip(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True), batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield now, *sides
                    now, sides = key, ([], [])
                sides[side].append(text)
        if now is not None:
            yield now, *sides

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=schema)

        def read() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for b in batches:
                schema = pa.schema([b.schema.field(i) for i in range(len(keys))] + [pa.field(n, ARROW[t]) for n, t in (x.split() for x in STEPS.split(", "))])
                yield b

        for key, mine, theirs in movies(read()):
            out += [dict(zip(keys, key, strict=True)) | {"step_idx": i} | step for i, step in enumerate(align_spans(mine, theirs, rules))]
            if len(out) >= 4096:
                yield batch()
                out = []
        if out:
            yield batch()

    side = lambda df, n, text: df.select(*keys, F.lit(n).alias("__side"), F.col(order).alias("__o"), F.coalesce(normalize_for_match(F.col(text)), F.lit("")).alias("__t"))
    both = side(raw, 0, raw_text).unionByName(side(dialogue, 1, dialogue_text))
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes make much work, so they are not to be coalesced
    dealt = both.repartition(parts, *keys).sortWithinPartitions(*keys, "__side", F.col("__o").asc_nulls_last(), "__t")
    return dealt.select(*keys, "__side", "__t").mapInArrow(run, ", ".join([*(f"`{k}` {t}" for k, t in kinds), STEPS]))

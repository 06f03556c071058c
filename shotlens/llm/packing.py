"""Packing documents into fixed-length token sequences by first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.llm.bpe import WordEncoder
from shotlens.llm.common import batch_of, column_bytes, map_arrow, prepared, table

#: Documents of a group, and groups that are filled at a time; both bound a task's memory, whatever the input.
GROUP_DOCS, OPEN_GROUPS = 1024, 4
#: A task numbers its sequences from its partition's number times this.
SEQUENCES = 1 << 36


@dataclass(slots=True)
class Piece:
    doc: int  # position in the buffer
    start: int
    length: int


class Tournament:
    """Capacities of bins in a complete binary tree whose inner nodes hold the larger child: the first bin that has room
    is found, and filled, in a walk from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        found = at - self.leaves
        best[at] -= size
        while at > 1:
            at //= 2
            room = max(best[2 * at], best[2 * at + 1])
            if best[at] == room:
                break
            best[at] = room
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of the sizes in each bin; equal sizes in their order. Every size is from 1 to the capacity."""
    tree = Tournament(len(sizes), capacity)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = tree.place(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def fill_up(bins: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Cut the pieces of the emptiest bins into the gaps of the fullest, until one bin at most isn't full; that one is
    split into sequences whose lengths are powers of two, which need no padding."""
    bins = sorted(bins, key=lambda b: -sum(p.length for p in b))
    used = [sum(p.length for p in b) for b in bins]
    i, j = 0, len(bins) - 1
    while i < j:
        gap = capacity - used[i]
        if not gap:
            i += 1
            continue
        p = bins[j][-1]
        take = min(gap, p.length)
        bins[i].append(Piece(p.doc, p.start + p.length - take, take))
        used[i] += take
        used[j] -= take
        p.length -= take
        if not p.length:
            bins[j].pop()
            if not bins[j]:
                j -= 1
    out = [b for b, n in zip(bins, used, strict=True) if n == capacity]
    for b, n in zip(bins, used, strict=True):
        if 0 < n < capacity:
            for k in range(n.bit_length() - 1, -1, -1):
                if not n >> k & 1:
                    continue
                part, need = [], 1 << k
                while need:
                    p = b[0]
                    take = min(need, p.length)
                    part.append(Piece(p.doc, p.start, take))
                    p.start += take
                    p.length -= take
                    need -= take
                    if not p.length:
                        b.pop(0)
                out.append(part)
    return out


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, sequence_length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", group_docs: int = GROUP_DOCS, seed: int = 17, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' tokens (each document's own, then `end_id`) with the sequence and the place they got.

    Each task deals its documents at random into groups of `group_docs` and packs each group by itself: whole sequences
    that a long document fills go out at once, the rests by first-fit decreasing, and the gaps then take cut pieces, so
    that only lengths of powers of two stay below `sequence_length`. Nothing is shuffled, and no task holds more than
    OPEN_GROUPS groups of rests. Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    `with_ids` ids array<int>. Null text is empty (`end_id` alone); null ids stay null; repeated rows are packed each;
    an empty table gives an empty table; further columns are not read.
    """
    prepared(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    end = np.array([end_id], np.uint32).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, part])
        next_id = part * SEQUENCES
        held: list[tuple[object, int, int, bytes]] = []  # id, tokens of the document, start of the rest, its ids
        rows: list[tuple] = []

        def emit(key, start: int, ids: memoryview | bytes, tokens: int, sequence: int, offset: int) -> None:
            rows.append((key, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset, *([np.frombuffer(ids, np.int32)] if with_ids else [])))

        def flush() -> None:
            nonlocal next_id
            for group in np.array_split(rng.permutation(len(held)), max(1, -(-len(held) // group_docs))):
                members = group.tolist()
                sizes = [len(held[i][3]) // 4 for i in members]
                bins = [[Piece(members[k], 0, sizes[k]) for k in b] for b in first_fit_decreasing(sizes, sequence_length)]
                for b in fill_up(bins, sequence_length):
                    offset = 0
                    for p in b:
                        key, tokens, start, ids = held[p.doc]
                        emit(key, start + p.start, ids[4 * p.start : 4 * (p.start + p.length)], tokens, next_id, offset)
                        offset += p.length
                    next_id += 1
            held.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [docs_type, *[pa.int64()] * 6, *([pa.list_(pa.int32())] if with_ids else [])]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
            out = batch_of(**{n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})
            rows.clear()
            return out

        docs_type = None
        for b in batches:
            docs_type = b.schema.field(0).type
            keys, texts = b.column(0).to_pylist(), column_bytes(b, "text")
            for at in range(0, len(texts), 256):
                for key, ids in zip(keys[at : at + 256], enc.encode_all(texts[at : at + 256]), strict=True):
                    ids += end
                    tokens = len(ids) // 4
                    whole = tokens - tokens % sequence_length
                    for start in range(0, whole, sequence_length):
                        emit(key, start, memoryview(ids)[4 * start : 4 * (start + sequence_length)], tokens, next_id, 0)
                        next_id += 1
                    if whole < tokens:
                        held.append((key, tokens, whole, ids[4 * whole :]))
                if len(held) >= group_docs * OPEN_GROUPS:
                    flush()
                if rows:
                    yield batch()
        if held:
            flush()
            yield batch()

    return map_arrow(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")), pack, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

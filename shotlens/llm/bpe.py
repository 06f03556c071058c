"""BPE encoding and decoding of whole texts with the tokenizers library's files.

Encoders keep the ids of the pieces of text between certain boundaries, positions where no token of any text can begin
before and end behind, in a cache of bounded size; new pieces go to the library. Long pieces without such a boundary are
encoded by tree concatenation: equal parts as one batch, then pairwise joins, each of which re-encodes a window around
the join that grows until its first and its last token are those that both sides had there. A sequence of tokens is
the encoding of its text if and only if each two neighbours are, so that such a join is exact.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.llm.common import batch_of, column_bytes, map_arrow, prepared, table, trim

#: A word of Latin letters, which neither normalising nor splitting changes or cuts, with a mark that may follow it.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([,.]?)")
#: Entries of the cache of pieces at most, and bytes of a piece from which tree concatenation takes over.
CACHE, LEAF = 200_000, 2048
#: Characters of a text beyond which its parts are encoded by several tasks.
PARALLEL_CHARS = 4_000_000
#: UTF-8 of what any reading of "white space" may hold: after a space these make no boundary.
_WHITE = rb"[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf"


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordEncoder:
    """For tokenizers that lower the case and drop white space: pieces are what ASCII white space separates, with A-Z
    lowered. Ids are uint32 bytes. A plain Latin word goes straight to the library's BPE model, all else through the
    whole library."""

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self.model = self.tok.model
        self.visible = byte_alphabet()
        self.cache: dict[bytes, bytes] = {}
        self.marks = {m: self._library([m])[0] for m in (",", ".")} | {"": b""}

    def _library(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _add(self, pieces: list[bytes]) -> None:
        cache, tokenize, visible, rest = self.cache, self.model.tokenize, self.visible, []
        for p in pieces:
            w = p.decode("utf-8", "replace")
            m = _WORD.fullmatch(w)
            if not m or "\u0130" in w:
                rest.append((p, w))
                continue
            word, mark = m.groups()
            bare = p[:-1] if mark else p
            ids = cache.get(bare)
            if ids is None:
                if not word.isascii():
                    word = "".join([visible[b] for b in word.lower().encode()])
                ids = cache[bare] = array("I", [t.id for t in tokenize(word)]).tobytes()
            if mark:
                cache[p] = ids + self.marks[mark]
        for (p, _), ids in zip(rest, self._library([w for _, w in rest]) if rest else [], strict=True):
            cache[p] = ids

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        cache = self.cache
        trim(cache, CACHE)
        split = [t.lower().split() for t in texts]
        new: set[bytes] = set()
        for words in split:
            new.update([w for w in set(words) if w not in cache])
        self._add(list(new))
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in split]


class ByteEncoder:
    """For byte-level BPE whose tokens take the space before a word: a boundary is a space before any character but
    white space. Strings of special tokens in a text are those tokens, as the library has it."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.tok, self.leaf = _tokenizer(path), leaf
        self.spaced: dict[bytes, bytes] = {}
        self.other: dict[bytes, bytes] = {}
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content.encode(): i for i, t in added.items()}
        names = b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.find_special = re.compile(b"(" + names + b")") if names else None
        self.odd = re.compile(b" (?:" + _WHITE + (b"|" + names if names else b"") + rb"|\Z)")
        self.boundary = re.compile(b" (?!" + _WHITE + (b"|" + names if names else b"") + rb"|\Z)")
        self.visible = byte_alphabet()
        self.marks = {m: array("I", self.tok.encode(m, add_special_tokens=False).ids).tobytes() for m in ("", ",", ".")}
        to_byte = {c: b for b, c in self.visible.items()}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode()
        self.decimal = [b"%d" % i for i in range(len(self.bytes_of))]

    # pieces

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a whole text."""
        if self.find_special and self.find_special.search(text):
            parts = self.find_special.split(text)
            return np.concatenate([self._plain(p) if k % 2 == 0 else np.array([self.special[p]], np.uint32) for k, p in enumerate(parts)])
        return self._plain(text)

    def _plain(self, text: bytes) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        trim(self.spaced, CACHE)
        trim(self.other, CACHE // 10)
        first, *rest = self.boundary.split(text) if self.odd.search(text) else text.split(b" ")
        head = self.other.get(first)
        if head is None:
            head = self.other[first] = self._piece(first)
        spaced = self.spaced
        self._add([p for p in set(rest) if p not in spaced])
        return np.frombuffer(head + b"".join(map(self.spaced.__getitem__, rest)), np.uint32)

    def _add(self, pieces: list[bytes]) -> None:
        spaced, tokenize, rest = self.spaced, self.tok.model.tokenize, []
        for p in pieces:
            w = p.decode("utf-8", "replace")
            if len(p) >= self.leaf:
                spaced[p] = self._piece(b" " + p)
            elif m := _WORD.fullmatch(w):
                word, mark = m.groups()
                bare = p[:-1] if mark else p
                ids = spaced.get(bare)
                if ids is None:
                    if not word.isascii():
                        word = "".join([self.visible[b] for b in word.encode()])
                    ids = spaced[bare] = array("I", [t.id for t in tokenize(self.visible[32] + word)]).tobytes()
                if mark:
                    spaced[p] = ids + self.marks[mark]
            else:
                rest.append((p, " " + w))
        for (p, _), e in zip(rest, self.tok.encode_batch_fast([w for _, w in rest], add_special_tokens=False) if rest else [], strict=True):
            spaced[p] = array("I", e.ids).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        if len(piece) < self.leaf:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = []
            for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text):
                ids += self.tree(text[a:b])
        return np.array(ids, np.uint32).tobytes()

    # tree concatenation

    def tree(self, run: str) -> list[int]:
        """Ids of one unsplit run, that is one that the library's own splitting keeps whole."""
        step = max(1, self.leaf // 4)
        parts = [e.ids for e in self.tok.encode_batch_fast([run[i : i + step] for i in range(0, len(run), step)], add_special_tokens=False)]
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        n = 4
        while True:
            a, b = min(n, len(left)), min(n, len(right))
            raw = b"".join(self.bytes_of[i] for i in left[len(left) - a :] + right[:b])
            n *= 2
            try:
                text = raw.decode()
            except UnicodeDecodeError:  # a character's bytes are cut
                if a == len(left) and b == len(right):
                    raise
                continue
            new = self.tok.encode(text, add_special_tokens=False).ids
            if (a == len(left) or new[0] == left[-a]) and (b == len(right) or new[-1] == right[b - 1]):
                return left[: len(left) - a] + new + right[b:]

    # parts of long texts

    def part(self, text: bytes) -> tuple[bytes, np.ndarray | None, bytes]:
        """What stands before the first boundary, the ids up to the last one (None: there is no boundary), the rest."""
        margin = max([16, *(len(s) + 3 for s in self.special)])
        spots = [m.start() for m in self.boundary.finditer(text, 0, len(text)) if m.start() < len(text) - margin]
        if not spots:
            return text, None, b""
        return text[: spots[0]], self.encode(text[spots[0] : spots[-1]]), text[spots[-1] :]

    def concat(self, parts: Iterator[tuple[bytes, np.ndarray | None, bytes]]) -> np.ndarray:
        """Ids of a text from its parts in order; around each join the text between two boundaries is encoded anew."""
        out, raw = [], b""
        for head, ids, tail in parts:
            raw += head
            if ids is not None:
                out += [self.encode(raw), ids]
                raw = tail
        return np.concatenate([*out, self.encode(raw)])

    # back

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the library's decode(ids, skip_special_tokens=False)."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        listed = ids.tolist()
        return len(listed), hashlib.sha256(b",".join(map(self.decimal.__getitem__, listed))).hexdigest(), hashlib.sha256(self.decode(listed)).hexdigest()


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's visible character of each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, parallel_chars: int = PARALLEL_CHARS) -> DataFrame:
    """Encode and decode each row's whole text: the id, n_tokens and the digests of the ids (decimal, with commas) and of
    the decoded text; with `with_ids` also ids array<int>.

    Texts of over `parallel_chars` characters are cut into parts that different tasks encode; the parts come together
    by tree concatenation in one task per text. Null text is empty (0 tokens); a null id stays null; repeated rows are
    encoded each; an empty table gives an empty table; further columns are not read.
    """
    prepared(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {SCHEMA}" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def results(key: pa.Array, all_ids: list[np.ndarray], enc: ByteEncoder) -> pa.RecordBatch:
        n, a, b = zip(*map(enc.digests, all_ids), strict=True) if all_ids else ((), (), ())
        more = {"ids": pa.array([x.astype(np.int32) for x in all_ids], pa.list_(pa.int32()))} if with_ids else {}
        return batch_of(**{id_col: key}, n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(a, pa.string()), decoded_sha256=pa.array(b, pa.string()), **more)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ByteEncoder(tokenizer_path)
        for b in batches:
            texts = column_bytes(b, "text")
            for i in range(0, len(texts), 256):
                yield results(b.column(0).slice(i, 256), [enc.encode(t) for t in texts[i : i + 256]], enc)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ByteEncoder(tokenizer_path)
        for b in batches:
            done = [enc.part(t) for t in column_bytes(b, "part")]
            yield batch_of(
                text_no=b.column(b.schema.get_field_index("text_no")), **{id_col: b.column(b.schema.get_field_index(id_col))}, part_no=b.column(b.schema.get_field_index("part_no")),
                head=pa.array([d[0] for d in done], pa.binary()), ids=pa.array([None if d[1] is None else d[1].tobytes() for d in done], pa.binary()), tail=pa.array([d[2] for d in done], pa.binary()),
            )

    def together(t: pa.Table) -> pa.Table:
        enc = ByteEncoder(tokenizer_path)
        t = t.sort_by("part_no")
        cols = [t.column(c).to_pylist() for c in ("head", "ids", "tail")]
        ids = enc.concat((h, None if i is None else np.frombuffer(i, np.uint32), x) for h, i, x in zip(*cols, strict=True))
        return pa.Table.from_batches([results(t.column(id_col).combine_chunks().slice(0, 1), [ids], enc)])

    short = map_arrow(rows.where(F.length("text") <= parallel_chars), whole, schema)
    n = F.lit(parallel_chars)
    cut = (
        rows.where(F.length("text") > parallel_chars).withColumn("text_no", F.monotonically_increasing_id())
        .select("text_no", id_col, "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / n).cast("int"))).alias("part_no"))
        .select("text_no", id_col, "part_no", F.col("text").substr(F.col("part_no") * n + 1, n).alias("part"))
        .repartition("text_no", "part_no")
    )
    long = map_arrow(cut, parts, f"text_no long, `{id_col}` {kind}, part_no int, head binary, ids binary, tail binary").groupBy("text_no").applyInArrow(together, schema)
    return short.unionByName(long)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""Ops 2 and 6 against the library and against exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shotlens.llm.bpe import ByteEncoder, WordEncoder, encode_documents
from shotlens.llm.packing import Tournament, fill_up, first_fit_decreasing, Piece, pack_documents

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\n ", "a", "the", " the", "'s", "é", "日本", "1", "22", "###", "<|endoftext|>", " <|endoftext|>", "\t", "ion", "\x1c", "!", "ing,", "\u00a0", "İ", "Σ", "\u0301"]


def texts(seed, n=400):
    rng = random.Random(seed)
    for k in range(n):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        if k % 7 == 0:
            s = "".join(rng.choice("abcdetion") for _ in range(rng.randint(100, 900))) + s
        yield s


@pytest.mark.parametrize("leaf", [64, 2048])
def test_byte_encoder_is_the_library(leaf):
    tok, enc = Tokenizer.from_file(BYTE), ByteEncoder(BYTE, leaf)
    for s in texts(leaf):
        want = tok.encode(s, add_special_tokens=False).ids
        assert enc.encode(s.encode()).tolist() == want
        assert enc.decode(want).decode() == tok.decode(want, skip_special_tokens=False)
        parts = [s[i : i + 29] for i in range(0, len(s), 29)]
        assert enc.concat(enc.part(p.encode()) for p in parts).tolist() == want


def test_tree_concatenation_of_one_unsplit_run():
    tok, enc, rng = Tokenizer.from_file(BYTE), ByteEncoder(BYTE, 128), random.Random(1)
    for alphabet in ("ab", "the", "abcdefghij", "éàü", "日本語", "#!?", "0123456789"):
        run = "".join(rng.choice(alphabet) for _ in range(3000))
        assert enc.tree(run) == tok.encode(run, add_special_tokens=False).ids


def test_word_encoder_is_the_library():
    tok, enc = Tokenizer.from_file(WORD), WordEncoder(WORD)
    for s in [*texts(5), "Word. word, WORD", "Ñandú, ÉCOLE. <|startoftext|>x"]:
        assert np.frombuffer(enc.encode_all([s.encode()])[0], np.uint32).tolist() == tok.encode(s, add_special_tokens=False).ids


def test_encode_documents_whole_and_in_parts(spark, corpus, no_rows):
    tok = Tokenizer.from_file(BYTE)
    rows = sorted((str(r["doc_id"]), r["text"] or "") for r in corpus.collect())
    for limit in (4_000_000, 1000):
        got = encode_documents(spark, corpus, BYTE, with_ids=True, parallel_chars=limit).collect()
        assert len(got) == len(rows)
        want = sorted((k, len(ids := tok.encode(t, add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for k, t in rows)
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert encode_documents(spark, no_rows, BYTE).count() == 0


def test_first_fit_decreasing_against_a_scan():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        bins: list[list[int]] = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b in bins if sum(sizes[k] for k in b) + sizes[i] <= 100), None)
            if b is None:
                bins.append(b := [])
            b.append(i)
        assert first_fit_decreasing(sizes, 100) == bins
    assert Tournament(1, 5).place(5) == 0


def test_fill_up_leaves_only_powers_of_two():
    bins = fill_up([[Piece(i, 0, n)] for i, n in enumerate([60, 50, 33, 7])], 64)
    used = [sum(p.length for p in b) for b in bins]
    assert sum(used) == 150 and all(u == 64 or u & (u - 1) == 0 for u in used)


def test_packing_places_every_token_once(spark, corpus, no_rows):
    tok = Tokenizer.from_file(WORD)
    got = pack_documents(spark, corpus.coalesce(1), WORD, sequence_length=256, with_ids=True, group_docs=8).collect()
    by_doc: dict = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], np.uint32).tobytes())
        by_doc.setdefault(r["doc_id"], []).append(r)
    for row in corpus.dropDuplicates(["doc_id"]).collect():
        pieces = sorted(by_doc[row["doc_id"]], key=lambda r: r["start"])
        want = tok.encode(row["text"] or "", add_special_tokens=False).ids + [2]
        times = len(pieces) and sum(p["length"] for p in pieces) // len(want)
        flat = [x for p in pieces for x in p["ids"]]
        assert sorted(flat) == sorted(want * times) and all(p["doc_tokens"] == len(want) for p in pieces)
    by_seq: dict = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 256 or at & (at - 1) == 0
    assert pack_documents(spark, no_rows, WORD).count() == 0

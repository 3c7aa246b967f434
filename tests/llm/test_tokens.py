"""Packing, id matrices and byte-level BPE against the library and brute force."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spinledger.llm import bpe, packing, token_output
from spinledger.llm.word_ids import WordIds

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "",
    " ",
    "\n\n  \t x",
    "It's he'll WE'RE don't 'S",
    "a<|endoftext|>b <|ENDOFTEXT|> <|endoftext|>",
    "étude ÉT İstanbul ΣΣ ß",
    " a  b c\x1cd \x85e",
    "aaaa aaaaaaa aaaaaaaaaaaaaaaaa",
    "\U0001f600 \U0001f469‍\U0001f4bb 12345 3.14 x²",
    "tab\tend  \n",
    "a  b   c \n \n d",
    "%%%and### the.*** Of….",
    "café. café, naïve!",
    "x" * 3000,
]


def some_texts():
    made = random.Random(5)
    signs = "abcdeEé \n'.,!<|>\t12ß́中"
    return ODD + ["".join(made.choices(signs, k=made.randint(1, 60))) for _ in range(400)]


def test_word_ids_match_the_library():
    library = Tokenizer.from_file(WORD_FILE)
    texts = some_texts()
    for text, ids in zip(texts, WordIds(WORD_FILE).encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_byte_bpe_matches_the_library_and_decodes():
    library, own = Tokenizer.from_file(BYTE_FILE), bpe.ByteBpe(BYTE_FILE)
    texts = some_texts()
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert own.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_decode_of_broken_utf8():
    library, own = Tokenizer.from_file(BYTE_FILE), bpe.ByteBpe(BYTE_FILE)
    ids = [int(own._of_byte[b]) for b in b"\xe4\xb8a\xff\xc3\xa9"]
    assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def naive_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    made = random.Random(seed)
    capacity = made.choice([7, 16, 50])
    lengths = [made.randint(1, capacity) for _ in range(made.randint(0, 300))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    runs, sequences = packing.best_fit_decreasing(counts, capacity)
    used = [[] for _ in range(sequences)]
    ranks = {x: [] for x in counts}
    for run in runs:
        for turn in range(run.end_rank - run.first_rank):
            ranks[run.length].append(run.first_rank + turn)
            used[run.first_sequence + turn // run.per].append((run.offset + turn % run.per * run.length, run.length))
    assert all(sorted(ranks[x]) == list(range(n)) for x, n in counts.items())
    for pieces in used:
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert 0 < end <= capacity
    assert sorted(capacity - sum(x for _, x in pieces) for pieces in used) == naive_best_fit(lengths, capacity)


def test_packing_rejects_lengths_beyond_the_capacity():
    with pytest.raises(ValueError):
        packing.best_fit_decreasing({9: 1}, 8)


SCHEMA = "doc_id bigint, text string, bucket string, length int"


def test_packing_is_lossless_and_gapless(spark):
    texts = [None, "", "one two three " * 900, *ODD, "same words here", "same words here"]
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in enumerate(texts)] + [(len(texts) - 1, texts[-1], "b", 1), (None, "x", "b", 1)], SCHEMA)
    rows = packing.pack_documents(docs, WORD_FILE, 64, 0).collect()
    library = Tokenizer.from_file(WORD_FILE)
    for i, text in enumerate(texts[:-1]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 64)))
        for r in own:
            assert r.start == 64 * r.piece and r.length == len(ids[r.start : r.start + 64])
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + 64].tobytes())
    assert sum(r.doc_id == len(texts) - 1 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by_sequence) == len(naive_best_fit([r.length for r in rows], 64))


def test_packing_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(docs, WORD_FILE).count() == 0
    assert token_output.packed_matrix(docs, WORD_FILE).count() == 0


def test_matrix_restores_every_document(spark, tmp_path):
    texts = [None, "alpha beta", "many words " * 700, *ODD]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    token_output.write_matrix(token_output.packed_matrix(docs, WORD_FILE, 128, 0), str(tmp_path / "matrix"))
    rows = spark.read.parquet(str(tmp_path / "matrix")).collect()
    found = {}
    for row in rows:
        ids, positions = np.frombuffer(row.ids, "<u2"), np.frombuffer(row.positions, "<u2")
        assert len(ids) == len(positions) == 128 and row.cu_seqlens[-1] == row.n_tokens
        for k, (a, b) in enumerate(zip(row.cu_seqlens, row.cu_seqlens[1:])):
            assert positions[a:b].tolist() == list(range(b - a))
            found.setdefault(row.doc_ids[k], {})[row.starts[k]] = ids[a:b].tolist()
        assert not ids[row.n_tokens :].any() and not positions[row.n_tokens :].any()
    library = Tokenizer.from_file(WORD_FILE)
    for i, text in enumerate(texts):
        whole = [x for start in sorted(found[i]) for x in found[i][start]]
        assert whole == [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_digests_of_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "a", 1), (3, "x y", "a", 1), (3, "x y", "a", 1)], SCHEMA)
    rows = bpe.encode_digests(docs, BYTE_FILE).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows[:2]] == [0, 0] and rows[0][1:] == rows[1][1:] and rows[2] == rows[3]
    full = {r.doc_id: r for r in bpe.encode_documents(docs, BYTE_FILE).collect()}
    assert full[3].decoded == "x y" and len(full[3].ids) == 4 * rows[2].n_tokens
    assert bpe.encode_digests(docs.filter(F.lit(False)), BYTE_FILE).count() == 0


def test_ids_that_do_not_fit_are_refused(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    for bad in ({"end_id": 70_000}, {"pad_id": 65_536}, {"id_type": "u1"}):
        with pytest.raises(ValueError, match="do not fit"):
            token_output.packed_matrix(docs, WORD_FILE, 128, **bad)
    (row,) = token_output.packed_matrix(docs, WORD_FILE, 128, end_id=70_000, id_type="<u4").collect()
    assert np.frombuffer(row.ids, "<u4")[row.n_tokens - 1] == 70_000

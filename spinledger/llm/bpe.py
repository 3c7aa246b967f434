"""Byte-level BPE encoding by batched merge rounds, and decoding.

Symbols of many words lie in one flat array. A round finds for each word the pair of
neighbours of lowest rank, by binary search of the new pairs in the sorted pair keys,
and merges it wherever it stands in that word; words without a pair leave the array.
Each distinct word is merged once, and each process remembers words it has seen.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks remembered by one process; beyond it the memory starts anew.
REMEMBERED = 400_000

# Fixed value: the pattern of the published byte-level vocabulary.
WORD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: A word always ends between a sign and the blank or line end behind it.
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_NO_RANK = np.iinfo(np.int64).max


def byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: itself where it is printable
    Latin-1, else the next free sign from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder of a byte-level vocabulary in a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, signs = spec["model"]["vocab"], byte_signs()
        self._of_byte = np.array([vocab[s] for s in signs], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order
        self._merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)  # by rank
        byte_of = {s: b for b, s in enumerate(signs)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = {content: np.uint32(i).astype("<u4").tobytes() for content, i in added.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        size = 1 + max([*vocab.values(), *added.values()])
        self._bytes = [b""] * size
        for token, i in [*vocab.items(), *added.items()]:
            self._bytes[i] = bytes(byte_of[s] for s in token)
        self._chunks: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NO_RANK)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word; no word may be empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self._of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(sym), _NO_RANK)
        same = word[1:] == word[:-1]
        rank[:-1][same] = self._rank(sym[:-1][same], sym[1:][same])
        out: list[bytes] = [b""] * len(words)
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            done = lowest == _NO_RANK
            if done.any():
                flat = sym[np.repeat(done, size)].astype("<u4").tobytes()
                ends = 4 * size[done].cumsum()
                for w, a, b in zip(word[first[done]].tolist(), (ends - 4 * size[done]).tolist(), ends.tolist(), strict=True):
                    out[w] = flat[a:b]
                stay = np.repeat(~done, size)
                sym, word, rank = sym[stay], word[stay], rank[stay]
                lowest, size = lowest[~done], size[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            # a run of one sign gives overlapping pairs; every second one merges, from the left
            run = np.concatenate(([True], (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = self._merged[rank[at]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            sym, word, rank = sym[stay], word[stay], rank[stay]
            at = moved[at]
            for left in (at, at[at > 0] - 1):
                has = left + 1 < len(sym)
                has[has] = word[left[has]] == word[left[has] + 1]
                rank[left[~has]] = _NO_RANK
                left = left[has]
                rank[left] = self._rank(sym[left], sym[left + 1])
        return out

    def _learn(self, chunks: set[str]) -> None:
        split = {chunk: WORD.findall(chunk) for chunk in chunks}
        words = list({word for found in split.values() for word in found})
        if words:
            ids = dict(zip(words, self.merge([word.encode() for word in words]), strict=True))
            for chunk, found in split.items():
                self._chunks[chunk] = b"".join(map(ids.__getitem__, found))

    def _pieces(self, text: str) -> list[str]:
        return WORD.findall(text) if _OTHER_SPACE.search(text) else _CHUNK.findall(text)

    def encode_batch(self, texts: list[str | None], block: int = 500) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text; strings of added tokens become them."""
        out: list[bytes] = []
        for i in range(0, len(texts), block):
            rows = []
            for text in texts[i : i + block]:
                parts = self._split.split(text) if text and self._split else [text or ""]
                rows.append([part if k % 2 else self._pieces(part) for k, part in enumerate(parts)])
            if len(self._chunks) > REMEMBERED:
                self._chunks = {}
            new: set[str] = set()
            for row in rows:
                for part in row[::2]:
                    new.update(part)
            self._learn(new.difference(self._chunks))
            get = self._chunks.__getitem__
            out += [
                b"".join(self._special[part] if k % 2 else b"".join(map(get, part)) for k, part in enumerate(row))
                for row in rows
            ]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        pieces = map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(pieces).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each process and file."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids and decoded text of each document: doc_id, ids (binary, 32-bit little-endian), decoded.

    A null text is encoded as the empty one. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                ids = bpe.encode_batch(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    schema = "doc_id bigint, ids binary, decoded string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, schema)


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of what ``encode_documents`` gives, so that no ids leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            rows = []
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                for doc, ids in zip(part["doc_id"], bpe.encode_batch(part["text"].tolist()), strict=True):
                    decoded = hashlib.sha256(bpe.decode(ids).encode()).hexdigest()
                    rows.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, schema)

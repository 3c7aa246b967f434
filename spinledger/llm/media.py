"""A media column of lossless WebP images that hold whole texts, read back and described.

A text's UTF-8 bytes, filled up with zeros to a multiple of 64, become grey tiles of 64
samples a row and at most 128 rows. Each tile is one WebP file with prefix codes and with
back-references to lines that the tile has had before; where at most 16 bytes occur, a
palette packs several samples into one. The files of a text stand one behind the other;
each begins with its own length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.llm import webp

WIDTH, TILE = 64, 64 * 128
#: Lines of at least so many bytes are copied when they come again.
LEAST_COPY = 16
#: Bytes of payload that are encoded or decoded together.
ENCODE_BYTES, DECODE_BYTES = 1_000_000, 16_000_000


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(max(64, 64 * -(-len(data) // 64)) - len(data))


def _copies(tile: bytes) -> list[tuple[int, int, int]]:
    """(position, length, distance) of lines that stood earlier in the tile, longest stretches first joined."""
    seen: dict[bytes, int] = {}
    found: list[tuple[int, int, int]] = []
    at = 0
    for line in tile.split(b"\n"):
        n = min(len(line) + 1, len(tile) - at)
        if n >= LEAST_COPY:
            before = seen.setdefault(line, at)
            if before < at and before + n <= at:
                if found and sum(found[-1][:2]) == at and found[-1][2] == at - before and found[-1][1] + n <= webp.LONGEST_COPY:
                    found[-1] = (found[-1][0], found[-1][1] + n, found[-1][2])
                elif n <= webp.LONGEST_COPY:
                    found.append((at, n, at - before))
        at += n
    return found


def encode_tiles(tiles: list[bytes]) -> list[bytes]:
    """A WebP file of each tile; all bit fields of the batch are packed together."""
    values, bits, first, at = [], [], [], 0
    for tile in tiles:
        pixels = np.frombuffer(tile, np.uint8)
        used = np.flatnonzero(np.bincount(pixels, minlength=256))
        fields = webp.Fields()
        webp.put_head(fields, WIDTH, len(tile) // WIDTH)
        green, copies = pixels, []
        if webp.bundle_bits(len(used)):
            colors = (used.astype(np.uint32) << 8) | np.uint32(webp.OPAQUE_BLACK)
            webp.put_palette(fields, colors)
            image = (pixels.astype(np.uint32) << 8 | np.uint32(webp.OPAQUE_BLACK)).reshape(-1, WIDTH)
            green = (webp.do_palette(image, colors) >> 8 & 255).ravel().astype(np.uint8)
        else:
            copies = _copies(tile)
        literal, ahead = np.ones(len(green), dtype=bool), []
        for position, length, back in copies:
            literal[position : position + length] = False
            ahead.append((position, webp.prefix_of(length), webp.prefix_of(back + len(webp.NEAR))))
        if ahead:
            where, kept = np.flatnonzero(literal), green[literal]
        else:
            kept = green
        counts = [np.bincount(kept, minlength=280), np.zeros(40, dtype=np.int64)]
        for _, length, back in ahead:
            counts[0][256 + length[0]] += 1
            counts[1][back[0]] += 1
        if np.count_nonzero(counts[0]) <= 2 and counts[0][256:].any():
            counts[0][:3] += 1
        lengths = [webp.code_lengths(c) for c in counts[: 1 + bool(ahead)]]
        codes = [webp.canonical_codes(x) for x in lengths]
        fields.put(0, 3)  # no more transforms, no colour cache, one group of codes
        webp.put_prefix_code(fields, lengths[0])
        for lone in (0, 0, 255):  # red, blue and alpha never change
            webp.put_simple_code(fields, [lone])
        if ahead:
            webp.put_prefix_code(fields, lengths[1])
        else:
            webp.put_simple_code(fields, [0])
        own = [n if np.count_nonzero(n) > 1 else np.zeros_like(n) for n in lengths]
        first.append(at)
        head = [np.array(fields.values), np.array(fields.bits)]
        body = [codes[0][kept], own[0][kept]]
        if ahead:
            place = np.searchsorted(where, [p for p, _, _ in ahead])
            extra = np.array(
                [
                    pair
                    for _, n, d in ahead
                    for pair in ((codes[0][256 + n[0]], own[0][256 + n[0]]), (n[2], n[1]), (codes[1][d[0]], own[1][d[0]]), (d[2], d[1]))
                ]
            )
            body = [np.insert(body[k], np.repeat(place, 4), extra[:, k]) for k in (0, 1)]
        values += [head[0], body[0]]
        bits += [head[1], body[1]]
        at += len(head[0]) + len(body[0])
    packed = webp.pack_fields(np.concatenate(values), np.concatenate(bits), np.array(first))
    return [webp.file_of(data) for data in packed]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload."""
    tiles = [(k, p[a : a + TILE]) for k, p in enumerate(payloads) for a in range(0, len(p), TILE)]
    files: list[list[bytes]] = [[] for _ in payloads]
    begin = 0
    while begin < len(tiles):
        end, size = begin, 0
        while end < len(tiles) and size < ENCODE_BYTES:
            size += len(tiles[end][1])
            end += 1
        for (k, _), file in zip(tiles[begin:end], encode_tiles([t for _, t in tiles[begin:end]]), strict=True):
            files[k].append(file)
        begin = end
    return [b"".join(f) for f in files]


def split_files(media: bytes) -> list[bytes]:
    files, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        files.append(media[at : at + size])
        at += size
    return files


def decode_payloads(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each stored form, rows of 64."""
    files = [(k, f) for k, m in enumerate(media) for f in split_files(m)]
    rows: list[list[np.ndarray]] = [[] for _ in media]
    for (k, _), pixels in zip(files, webp.decode_batch([f for _, f in files]), strict=True):
        rows[k].append((pixels >> 8 & 255).astype(np.uint8))
    return [np.concatenate(r) if len(r) > 1 else r[0] for r in rows]


def feature_of(samples: np.ndarray) -> str:
    """Mean, number of levels and an average hash: which of the 64 columns are brighter than the mean."""
    flat = samples.ravel()
    columns = samples.sum(axis=0, dtype=np.int64)
    brighter = columns * WIDTH > columns.sum()
    levels = np.count_nonzero(np.bincount(flat, minlength=256))
    return f"{columns.sum() / flat.size:.4f}/{levels}/{int.from_bytes(np.packbits(brighter).tobytes(), 'big'):016x}"


def _groups(sizes: list[int], order: list[int]) -> Iterator[list[int]]:
    group, size = [], 0
    for k in order:
        group.append(k)
        size += sizes[k]
        if size >= DECODE_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _each_group(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[int], list[bytes], list[bytes]]]:
    for batch in batches:
        ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
        sizes = [len(t or "") for t in texts]
        for group in _groups(sizes, sorted(range(len(texts)), key=sizes.__getitem__)):  # alike sizes share lanes best
            payloads = [payload_of(texts[k]) for k in group]
            yield [ids[k] for k in group], [len((texts[k] or "").encode()) for k in group], payloads, encode_payloads(payloads)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each whole text as lossless WebP files. Null is the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, sizes, _, media in _each_group(batches):
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_bytes": sizes, "media": media})

    return _narrow(docs).mapInPandas(run, "doc_id bigint, n_bytes bigint, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the pixel array (``samples``, rows of ``width``) of a media column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = batch["media"].tolist()
            for group in _groups([len(m) for m in forms], list(range(len(forms)))):
                part = batch.iloc[group]
                samples = [s.tobytes() for s in decode_payloads([forms[k] for k in group])]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_bytes": part["n_bytes"].array, "width": WIDTH, "samples": samples})

    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, "doc_id bigint, n_bytes bigint, width int, samples binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each whole text, read the stored bytes back and give digests and a feature of them.

    A null text is the empty one, whose payload is 64 zeros. Equal texts give equal
    values; repeated rows give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, sizes, _, media in _each_group(batches):
            rows = []
            for doc, n, form, samples in zip(ids, sizes, media, decode_payloads(media), strict=True):
                read = samples.tobytes()
                digests = hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(form), hashlib.sha256(form).hexdigest()
                rows.append((doc, n, len(read), *digests, feature_of(samples)))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.assign(doc_id=pd.array(ids, dtype="Int64"))

    schema = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string"
    )
    return _narrow(docs).mapInPandas(run, schema)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

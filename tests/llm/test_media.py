"""Lossless WebP: round trips of every feature, and whole texts as images."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from spinledger.llm import media, webp

# Fixed value: the widely published smallest lossless sample.
SAMPLE = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")


def picture(seed, height=23, width=37):
    made = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    smooth = np.stack([x * 3 + y, y * 5, x + y * 2, 255 - x], -1) + made.integers(0, 4, (height, width, 4))
    return np.ascontiguousarray(smooth % 256, dtype=np.uint8).view("<u4")[..., 0]


def test_published_sample():
    assert webp.decode(SAMPLE).shape == (1, 1)


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert webp.NEAR[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    image = picture(mode)
    modes = np.full((6, 10), mode)
    assert (webp.decode(webp.encode(image, predictor=(modes, 2))) == image).all()


def test_every_transform_together():
    image, made = picture(1), np.random.default_rng(2)
    modes = made.integers(0, 14, (3, 5))
    factors = made.integers(0, 2**24, (6, 10)).astype(np.uint32) | np.uint32(0xFF000000)
    for cache in (0, 1, 6, 11):
        file = webp.encode(image, (modes, 3), (factors, 2), True, False, cache)
        assert (webp.decode(file) == image).all()


@pytest.mark.parametrize("colors", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palettes(colors):
    made = np.random.default_rng(colors)
    table = made.choice(2**32, colors, replace=False).astype(np.uint32)
    image = table[np.concatenate((np.arange(colors), made.integers(0, colors, 23 * 37 - colors))).reshape(23, 37)]
    assert (webp.decode(webp.encode(image, palette=True)) == image).all()


def test_back_references_near_far_and_overlapping():
    row = picture(3, 1, 40)[0]
    flat = np.concatenate((row, row, np.repeat(row[:1], 50), row[:30]))
    image = np.resize(flat, (4, 40)).astype(np.uint32)
    copies = {40: (40, webp.NEAR.index((0, 1)) + 1), 81: (49, 120 + 1), 131: (29, 120 + 130)}
    for position, (length, code) in copies.items():
        back = webp.distance(code, 40)
        flat_image = image.ravel()
        assert all(flat_image[position + i] == flat_image[position + i - back] for i in range(length))
    for cache in (0, 5):
        assert (webp.decode(webp.encode(image, cache_bits=cache, copies=copies)) == image).all()


def test_lanes_of_many_sizes_agree_with_single_decoding():
    images = [picture(k, 1 + 7 * k % 20, 1 + 5 * k % 33) for k in range(30)]
    files = [webp.encode(x, palette=False, cache_bits=4 * (k % 3 == 0)) for k, x in enumerate(images)]
    for image, read in zip(images, webp.decode_batch(files), strict=True):
        assert (image == read).all()


@pytest.mark.parametrize("broken", [b"", b"RIFF0000WEBPVP8 ", SAMPLE[:22], SAMPLE[:20] + b"\x00" + SAMPLE[21:]])
def test_broken_files_are_refused(broken):
    with pytest.raises(webp.WebpError):
        webp.decode(broken)


def texts():
    made = random.Random(1)
    words = ["the", "of", "ßen", "éau", "thention", "中文", "ox"]
    long = " ".join(made.choices(words, k=12000))
    lines = "\n".join(made.choices(["a line that comes again and again", "another one, rather long, too", "short"], k=900))
    return [None, "", "a", "ab" * 40, "x" * 5000, long, lines, "\x00\x01" * 33, "".join(map(chr, range(1, 300))), lines[:700]]


def test_copies_stay_in_their_tile():
    payload = media.payload_of(texts()[6])
    assert media._copies(payload[: media.TILE])
    for form, size in zip(media.encode_payloads([payload]), [len(payload)], strict=True):
        assert len(media.split_files(form)) == -(-size // media.TILE) and len(form) < size / 4


def test_digests(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(texts())] + [(5, texts()[5], "x", 0), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, media string, n_bytes int")
    found = media.media_digests(docs).collect()
    assert len(found) == len(rows)
    stored = {r.doc_id: r for r in media.media_column(docs).collect()}
    for i, text in enumerate(texts()):
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        for row in (r for r in found if r.doc_id == i):
            assert row.n_bytes == len(data) and row.payload_bytes == len(payload)
            assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
            assert row.tail_crc32 == zlib.crc32(payload[-64:])
            assert row.media_sha256 == hashlib.sha256(stored[i].media).hexdigest() and row.media_bytes == len(stored[i].media)
    nulls = [r for r in found if r.doc_id in (None, 0, 1)]
    assert len({r[1:] for r in nulls}) == 1
    assert media.media_digests(docs.limit(0)).count() == 0


def test_reading_the_column_back(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string")
    for row in media.read_media(media.media_column(docs)).collect():
        assert row.samples == media.payload_of(texts()[row.doc_id]) and row.width == 64

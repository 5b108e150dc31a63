"""Round trips of the lossless WebP codec through every tool of the format."""

from __future__ import annotations

import numpy as np
import pytest

from glyphlake.llm import media, webp


def image(rng, height, width, colours=0):
    if colours:
        return rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, (height, width))]
    smooth = np.add.outer(np.arange(height) * 3, np.arange(width) * 5)
    noise = rng.integers(0, 9, (height, width, 4))
    return ((smooth[..., None] * [1, 2, 3, 0] + noise + [0, 0, 0, 200]) % 256).astype(np.uint8).view("<u4")[..., 0].astype(np.uint32)


@pytest.mark.parametrize("height,width", [(1, 1), (1, 9), (7, 1), (13, 17), (5, 64)])
def test_plain_and_green(height, width):
    rng = np.random.default_rng(1)
    for green in (False, True):
        for references in (False, True):
            for bits in (0, 1, 5, 11):
                x = image(rng, height, width)
                assert (webp.decode(webp.encode(x, green=green, references=references, cache_bits=bits)) == x).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palette(colours):
    rng = np.random.default_rng(colours)
    for height, width in ((1, 1), (6, 7), (9, 33)):
        x = image(rng, height, width, colours)
        assert (webp.decode(webp.encode(x, palette=True, cache_bits=3)) == x).all()


def test_every_predictor():
    rng = np.random.default_rng(3)
    for mode in range(16):
        x = image(rng, 11, 10)
        tiles = np.full((3, 3), mode << 8 | 0xFF000000, np.uint32)
        assert (webp.decode(webp.encode(x, predictor_mode=tiles)) == x).all(), mode
    tiles = (rng.integers(0, 14, (3, 3)).astype(np.uint32) << 8).astype(np.uint32)
    assert (webp.decode(webp.encode(x, predictor_mode=tiles)) == x).all()


def test_fast_predictors_are_the_slow_ones():
    rng = np.random.default_rng(4)
    for mode in (0, 1, 2):
        residual = rng.integers(0, 2**32, (6, 9), dtype=np.uint32)
        one = webp.predictor(residual, np.full((2, 3), mode << 8, np.uint32), 2, False)
        assert (webp.predictor(one, np.full((2, 3), mode << 8, np.uint32), 2, True) == residual).all()


def test_cross_colour_and_all_transforms():
    rng = np.random.default_rng(5)
    for _ in range(5):
        x = image(rng, 9, 14)
        factors = rng.integers(0, 2**24, (3, 4), dtype=np.uint32)
        modes = (rng.integers(0, 14, (3, 4)).astype(np.uint32) << 8).astype(np.uint32)
        assert (webp.decode(webp.encode(x, factors=factors)) == x).all()
        assert (webp.decode(webp.encode(x, predictor_mode=modes, factors=factors, green=True, cache_bits=4)) == x).all()


def test_cross_colour_by_hand():
    # green 100, red 10, blue 20; green to red 32 (x1), green to blue 64 (x2), red to blue -32 (x-1)
    pixel = np.array([[0xFF << 24 | 10 << 16 | 100 << 8 | 20]], np.uint32)
    factors = np.array([[(-32 & 255) << 16 | 64 << 8 | 32]], np.uint32)
    got = int(webp.cross_colour(pixel, factors, 2, False)[0, 0])
    assert got == 0xFF << 24 | 110 << 16 | 100 << 8 | (20 + 200 - 110) % 256


def test_back_references_overlap_and_near_codes():
    for period in (1, 2, 3, 7, 8, 64):
        x = np.tile(np.arange(period, dtype=np.uint32) * 7 << 8, 400)[:320].reshape(20, 16)
        data = webp.encode(x, references=True)
        assert (webp.decode(data) == x).all()
        assert len(data) < 160 or period > 8


def test_groups_of_codes():
    """Two groups, chosen by tile: written by hand, as the encoder uses one."""
    w = webp.header(8, 4)
    w.write(0, 1)
    w.write(0, 1)
    w.write(1, 1)
    w.write(0, 3)  # tiles of 4 pixels: 2 x 1
    webp.write_image(w, np.array([0, 1 << 8], np.uint32), 2, False)
    tables = []
    for pair in ((5, 9), (6, 200)):
        tables.append(webp.write_code(w, dict.fromkeys(pair, 1)))
        for _ in range(4):
            webp.write_code(w, {})
    want = np.zeros((4, 8), np.uint32)
    for y in range(4):
        for x in range(8):
            s = ((5, 9), (6, 200))[x // 4][(x + y) % 2]
            w.write(*tables[x // 4][s])
            want[y, x] = s << 8
    assert (webp.decode(webp.file_of(w.bytes())) == want).all()


def test_payloads():
    rng = np.random.default_rng(6)
    samples = [b"", b"a" * 64, b"ab" * 300, bytes(range(256)) * 3, rng.integers(0, 256, 5000).astype(np.uint8).tobytes(), "naïve \U0001f600 text ".encode() * 700, b"x" * 300_000]
    for raw in samples:
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert media.restored(media.stored(payload)) == payload


def test_tall_payload():
    payload = np.random.default_rng(7).integers(0, 100, 64 * (webp.MOST_SIDE + 3)).astype(np.uint8).tobytes()
    data = media.stored(payload)
    assert media.restored(data) == payload
    assert [webp.decode(x).shape for x in webp.files(data)] == [(webp.MOST_SIDE, 64), (3, 64)]


def tools(data):
    """What a stream of `media` is made of: bits of the palette, the cache, symbols of the main image that are used."""
    seen = {}

    def read(r, n, width, green, far, cache_bits, rest):
        at = r.at
        out = real(r, n, width, green, far, cache_bits, rest)
        end, r.at, symbols, pixels = r.at, at, [], 0
        while pixels < n:
            symbols.append(green.read(r))
            if 256 <= symbols[-1] < 256 + webp.LENGTHS:
                pixels += webp.read_number(r, symbols[-1] - 256)
                webp.read_number(r, far.read(r))
            else:
                pixels += 1
        assert r.at == end and pixels == n
        seen.update(lengths=len(set(green.counts)), cache=cache_bits, symbols=symbols, green=green)
        return out

    real = webp._read_samples
    webp._read_samples = read
    try:
        webp.decode(data)
    finally:
        webp._read_samples = real
    return seen


def test_every_payload_uses_the_tools():
    """Short and long texts: fitted codes of several lengths, back-references, the cache, and the palette that leaves few bits."""
    rng = np.random.default_rng(9)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(300)]
    for n in (60, 400, 3000, 40_000):
        text = " ".join(words[k] for k in rng.zipf(1.4, n) % 300)
        payload, _ = media.payload_of(text)
        data = media.stored(payload)
        assert media.restored(data) == payload
        found = tools(data)
        symbols = np.array(found["symbols"])
        assert found["cache"] == media.CACHE_BITS and (symbols >= 256 + webp.LENGTHS).any()
        assert ((symbols >= 256) & (symbols < 256 + webp.LENGTHS)).sum() > n / 40
        assert found["lengths"] > 2 and symbols[symbols < 256].max() < 30
        assert len(data) < 0.75 * len(payload)


def test_random_payloads_of_every_make():
    rng = np.random.default_rng(10)
    for _ in range(300):
        n, colours = 64 * int(rng.integers(1, 40)), int(rng.choice([1, 2, 3, 5, 17, 60, 256]))
        x = rng.integers(0, 256, colours).astype(np.uint8)[rng.integers(0, colours, n)]
        for _ in range(int(rng.integers(0, 12))):  # repeats, some of them overlapping
            d, length = int(rng.integers(1, 200)), int(rng.integers(1, 300))
            at = int(rng.integers(0, n))
            for k in range(max(at, d), min(n, at + length)):
                x[k] = x[k - d]
        assert media.restored(media.stored(x.tobytes())) == x.tobytes()


def test_broken_files():
    good = webp.encode(image(np.random.default_rng(8), 9, 9))
    for bad in (b"", b"RIFF", good[:40], good.replace(b"VP8L", b"VP8 ")):
        with pytest.raises((ValueError, KeyError, IndexError)):
            webp.decode(bad)

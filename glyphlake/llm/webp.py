"""Lossless WebP (VP8L): a whole decoder, and an encoder that can use every tool of the format.

The format is public (WebP Lossless Bitstream Specification). `decode` reads any VP8L stream: prefix codes, back-references,
colour cache, groups of codes, and the predictor, cross-colour, subtract-green and palette transforms, and gives a
uint32 array of ARGB pixels. A last image whose green channel alone varies, as that of a palette, is read and written by arrays.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np

SIGNATURE, MOST_SIDE, MOST_LENGTH = 0x2F, 1 << 14, 15
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS, DISTANCES, CACHE_FACTOR = 24, 40, 0x1E35A7BD
#: Fixed values of the format: the order of code lengths, and the near distances (x, y) of codes 1 to 120.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Reader:
    """Bits, the lowest of a byte first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        at = self.at
        if at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)


@cache
def _reversed(width: int) -> np.ndarray:
    """The numbers of width bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for k in range(width):
        out = np.concatenate([out, out + (1 << (width - 1 - k))])
    return out


@dataclass
class Code:
    """A canonical prefix code: counts and symbols by length; one symbol alone takes no bits."""

    symbols: list[int]
    counts: list[int]
    known: tuple[np.ndarray, int] | None = None

    @classmethod
    def of(cls, lengths: list[int]) -> Code:
        return cls.of_pairs([(n, s) for s, n in enumerate(lengths) if n])

    @classmethod
    def of_pairs(cls, pairs: list[tuple[int, int]]) -> Code:
        """From (length, symbol) of the symbols that are used; even codes, which are few, are kept."""
        even = len(pairs) > 15 and pairs[0][0] == pairs[-1][0] == pairs[len(pairs) // 2][0]
        return _code(tuple(pairs)) if even else cls.made(sorted(pairs))

    @classmethod
    def made(cls, used: list[tuple[int, int]]) -> Code:
        if len(used) <= 1:
            return cls([used[0][1]] if used else [0], [])
        counts = [0] * (used[-1][0] + 1)
        for n, _ in used:
            counts[n] += 1
        if sum([c << (MOST_LENGTH - n) for n, c in enumerate(counts)]) != 1 << MOST_LENGTH:
            raise ValueError("a prefix code isn't complete")
        return cls([s for _, s in used], counts)

    def read(self, r: Reader) -> int:
        if not self.counts:
            return self.symbols[0]
        code = first = index = 0
        data, at = r.data, r.at
        for c in self.counts[1:]:
            code |= data[at >> 3] >> (at & 7) & 1 if at >> 3 < len(data) else 0
            at += 1
            if code - first < c:
                r.at = at
                return self.symbols[index + code - first]
            index += c
            first = (first + c) << 1
            code <<= 1
        raise ValueError("no such code")

    def table(self) -> tuple[np.ndarray, int]:
        """16 * symbol + length for every value of the next bits, and their number."""
        if self.known is None:
            self.known = self._table()
        return self.known

    def _table(self) -> tuple[np.ndarray, int]:
        longest = len(self.counts) - 1 if self.counts else 0
        if not longest:
            return np.array([16 * self.symbols[0]]), 0
        lengths = np.repeat(np.arange(longest + 1), self.counts)
        table = np.repeat(16 * np.array(self.symbols) + lengths, 1 << (longest - lengths))
        return table[_reversed(longest)], longest


#: Bits of code lengths that are looked at together.
PIECE = 512


@lru_cache(maxsize=4096)
def _length_code(n: int, bits: int) -> tuple[list[int], int]:
    """The table of the code of code lengths from its n lengths of three bits, and the mask of its bits."""
    used = sorted([(bits >> 3 * k & 7, LENGTH_ORDER[k]) for k in range(n) if bits >> 3 * k & 7])
    if len(used) <= 1:
        return [16 * used[0][1] if used else 0], 0
    wide = used[-1][0]
    table, turned, at = [0] * (1 << wide), _turned(wide), 0
    for length, symbol in used:
        end = at + (1 << wide - length)
        for k in turned[at:end]:
            table[k] = 16 * symbol + length
        at = end
        if at > 1 << wide:
            break
    if at != 1 << wide:
        raise ValueError("a prefix code isn't complete")
    return table, (1 << wide) - 1


@lru_cache(maxsize=256)
def _code(pairs: tuple[tuple[int, int], ...]) -> Code:
    return Code.made(sorted(pairs))


#: The code whose only symbol is 0.
_NOTHING = Code([0], [])


def read_code(r: Reader, size: int) -> Code:
    if r.data[r.at >> 3 : (r.at >> 3) + 2] and int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 2], "little") >> (r.at & 7) & 15 == 1:
        r.at += 4
        return _NOTHING
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        symbols = [r.read(8 if wide else 1)] + [r.read(8) for _ in range(two)]
        if max(symbols) >= size:
            raise ValueError("a symbol is outside its alphabet")
        return Code(symbols[:1], []) if len(set(symbols)) == 1 else Code(sorted(symbols), [0, 2])
    n = 4 + r.read(4)
    table, mask = _length_code(n, r.read(3 * n))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    pairs, at, last, taken, ahead = [], 0, 8, 0, None
    while at < size and left:
        if ahead is None or taken >= PIECE - 16:  # a step takes 14 bits at most
            r.at += taken
            ahead, taken = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + PIECE // 8 + 1], "little") >> (r.at & 7), 0
        left -= 1
        step = table[ahead & mask]
        n, s = step & 15, step >> 4
        ahead >>= n
        taken += n
        if s < 16:
            if s:
                pairs.append((s, at))
                last = s
            at += 1
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
        n = least + (ahead & ((1 << extra) - 1))
        ahead >>= extra
        taken += extra
        if s == 16:
            pairs += [(last, k) for k in range(at, at + n)]
        at += n
    if at > size:
        raise ValueError("code lengths run over")
    r.at += taken
    if r.at > 8 * len(r.data):
        raise ValueError("the stream ends early")
    return Code.of_pairs(pairs)


def read_number(r: Reader, prefix: int) -> int:
    """A length or distance from its prefix."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as flat ARGB pixels."""
    n = width * height
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11 or n > 1 << 28:
        raise ValueError("bad image header")
    tile, groups, across = 0, np.zeros(1, np.int64), 1
    if main and r.read(1):
        tile = r.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        groups = (read_image(r, across, (height + (1 << tile) - 1) >> tile, False) >> np.uint32(8)).astype(np.int64) & 0xFFFF
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(r, s) for s in sizes] for _ in range(int(groups.max()) + 1)]
    green, red, blue, alpha, far = codes[0]
    if len(codes) == 1 and not (red.counts or blue.counts or alpha.counts):
        found = _read_samples(r, n, width, green, far, cache_bits, red.symbols[0] << 16 | blue.symbols[0] | alpha.symbols[0] << 24)
        if found is not None:
            return found
    pixels = [0] * n
    cache = [0] * (1 << cache_bits)
    at = kept = 0
    while at < n:
        green, red, blue, alpha, far = codes[groups[(at // width >> tile) * across + (at % width >> tile)]] if tile else codes[0]
        s = green.read(r)
        if s < 256:
            pixels[at] = s << 8 | red.read(r) << 16 | blue.read(r) | alpha.read(r) << 24
            at += 1
        elif s < 256 + LENGTHS:
            length = read_number(r, s - 256)
            d = read_number(r, far.read(r))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            if d >= length:
                pixels[at : at + length] = pixels[at - d : at - d + length]
            else:
                for k in range(at, at + length):
                    pixels[k] = pixels[k - d]
            at += length
        else:
            while kept < at:
                cache[(CACHE_FACTOR * pixels[kept] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[kept]
                kept += 1
            pixels[at] = cache[s - 256 - LENGTHS]
            at += 1
    return np.array(pixels, np.uint32)


@cache
def _slots(rest: int, bits: int) -> np.ndarray:
    """The colour cache's slot of each green value."""
    colours = (np.arange(256, dtype=np.uint64) << np.uint64(8)) | np.uint64(rest)
    return ((colours * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.uint16)


def _same_before(keys: np.ndarray) -> np.ndarray:
    """For each place the last one before it with an equal key, -1 if there is none.

    Numbers of 64 bits are sorted by 32 bits of a product and their place, so a chance neighbour may hide an equal one.
    """
    if keys.itemsize <= 2:
        order = np.argsort(keys, kind="stable")
    else:
        order = (keys * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000) | np.arange(len(keys), dtype=np.uint64)
        order.sort()
        order = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    out = np.full(len(keys), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


@cache
def _near(width: int) -> tuple[np.ndarray, dict[int, int]]:
    """Distances of the near codes, and the first code of each distance."""
    far = [max(1, x + y * width) for x, y in NEAR]
    return np.array(far), {d: k + 1 for k, d in reversed(list(enumerate(far)))}


#: Of each prefix of a length or distance: extra bits, and the value without them.
_EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(DISTANCES)])
_LEAST = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(DISTANCES)])


#: Bytes of a stream that are looked at together.
AHEAD = 1 << 12


def _steps(data: bytes, at: int, n: int, green: Code, far: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbol, pixels and distance code (0: none) of each step of an image of n pixels from bit `at`, and the bit after them.

    What would be read is looked up at every bit of a stretch, and the steps that are taken are those on the path from the
    first bit.
    """
    table, bits = green.table()
    mask = (1 << bits) - 1
    copies = green.symbols[-1] >= 256 or max(green.symbols) >= 256
    if not copies and len(green.symbols) in (1, 1 << bits):  # all values take the same number of bits, which may be none
        ends = at + n * bits
        if ends > 8 * len(data):
            raise ValueError("the stream ends early")
        drawn = np.unpackbits(np.frombuffer(data, np.uint8, (ends + 7 >> 3) - (at >> 3), at >> 3), bitorder="little")[at & 7 :][: n * bits].reshape(n, bits)
        symbol = table[drawn.astype(np.int64) @ (1 << np.arange(bits))] >> 4 if bits else np.full(n, green.symbols[0])
        return symbol, np.ones(n, np.int64), np.zeros(n, np.int64), ends
    far_table, far_bits = far.table()
    # Bits of each code, with a mark for copies.
    taken = ((table & 15) | np.where((table >= 16 * 256) & (table < 16 * (256 + LENGTHS)), 128, 0)).astype(np.uint8)
    parts, left = [], n
    while left > 0:
        first = at >> 3
        stretch = min(AHEAD, 8 * left + 8, len(data) - first)
        if stretch <= 0:
            raise ValueError("the stream ends early")
        raw = np.frombuffer(data[first : first + stretch + 8].ljust(stretch + 8, b"\0"), np.uint8).astype(np.int64)
        words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        windows = (words[:, None] >> _EIGHT).ravel()  # 25 bits from each place at least
        size, top = 8 * stretch, len(windows) - 1
        windows_now = windows & mask
        bits_now = taken[windows_now]
        after = _places(len(windows)) + (bits_now & 15)
        copy = length = back = None
        if copies:
            copy = np.flatnonzero(bits_now & 128)
            prefix = (table[windows_now[copy]] >> 4) - 256
            place = after[copy]
            extra = _EXTRA[prefix]
            length = _LEAST[prefix] + (windows[np.minimum(place, top)] & ((1 << extra) - 1))
            place += extra
            step = far_table[windows[np.minimum(place, top)] & ((1 << far_bits) - 1)]
            place += step & 15
            prefix = step >> 4
            extra = _EXTRA[prefix]
            back = _LEAST[prefix] + (windows[np.minimum(place, top)] & ((1 << extra) - 1))
            after[copy] = place + extra
        # Eight steps at once: the last place stays where it is.
        start = at & 7
        after[-64:] = np.minimum(after[-64:], top)
        jumps = [after]
        for _ in range(3):
            jumps.append(jumps[-1][jumps[-1]])
        follow, heads = memoryview(jumps[3]), []
        for _ in range(-(-left // 8)):
            if start >= size:
                break
            heads.append(start)
            start = follow[start]
        path = np.array(heads)[:, None]
        for k in (2, 1, 0):
            path = np.stack([path, jumps[k][path]], axis=2).reshape(len(heads), -1)
        path = path.ravel()
        path = path[: min(left, int(np.searchsorted(path, size)))]
        symbol = table[windows_now[path]] >> 4
        count, far_code = np.ones(len(path), np.int64), np.zeros(len(path), np.int64)
        if copies:
            copied = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTHS))
            which = np.searchsorted(copy, path[copied])
            count[copied], far_code[copied] = length[which], back[which]
        ends = np.cumsum(count)
        steps = int(np.searchsorted(ends, left)) + 1
        if steps <= len(path):
            symbol, count, far_code = symbol[:steps], count[:steps], far_code[:steps]
        else:
            steps = len(path)
        parts.append((symbol, count, far_code))
        left -= int(ends[steps - 1])
        at = 8 * first + int(after[path[steps - 1]])
    if left or at > 8 * len(data):
        raise ValueError("the stream ends early, or a back-reference leaves the image")
    symbol, count, far_code = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
    return symbol, count, far_code, at


_EIGHT = np.arange(8)


@cache
def _counting() -> np.ndarray:
    return np.arange(8 * AHEAD + 64)


def _places(n: int) -> np.ndarray:
    return _counting()[:n]


def _read_samples(r: Reader, n: int, width: int, green: Code, far: Code, cache_bits: int, rest: int) -> np.ndarray | None:
    """An image of which only the green values have bits: by arrays, with every code, reference and cache.

    Pixels are known by their slots of the cache, which copies and hits keep. None if a slot is that of several colours, or hit
    before it holds one: then each pixel depends on the one before, and nothing is read.
    """
    symbol, count, far_code, end = _steps(r.data, r.at, n, green, far)
    if len(symbol) == n and not cache_bits:  # every pixel is written out
        r.at = end
        return symbol.astype(np.uint32) << np.uint32(8) | np.uint32(rest)
    places = np.cumsum(count) - count
    copied = np.flatnonzero(far_code)
    back, near = far_code[copied], _near(width)[0]
    back = np.where(back > len(NEAR), back - len(NEAR), near[np.minimum(back, len(NEAR)) - 1])
    if (back > places[copied]).any():
        raise ValueError("a back-reference leaves the image")
    single = symbol < 256
    written, at = symbol[single], places[single]
    kinds = _slots(rest, cache_bits) if cache_bits else _SELF
    slots = np.zeros(n, np.uint16)
    slots[at] = kinds[written]
    colour = np.zeros(1 << (cache_bits or 8), np.uint32)
    colour[kinds[written]] = written
    if cache_bits:
        first = np.full(len(colour), n)
        first[kinds[written][::-1]] = at[::-1]
        hit = np.flatnonzero(symbol >= 256 + LENGTHS)
        held = symbol[hit] - (256 + LENGTHS)
        if (colour[kinds[written]] != written).any() or (first[held] >= places[hit]).any():
            return None
        slots[places[hit]] = held
    if len(copied):
        pixels = bytearray(slots)
        for at, left, d in zip((2 * places[copied]).tolist(), (2 * count[copied]).tolist(), (2 * back).tolist(), strict=True):
            while left > d:  # what lies before is there, so overlapping copies go by doubling steps
                pixels[at : at + d] = pixels[at - d : at]
                at, left, d = at + d, left - d, 2 * d
            pixels[at : at + left] = pixels[at - d : at - d + left]
        slots = np.frombuffer(pixels, np.uint16)
    r.at = end
    return colour[slots] << np.uint32(8) | np.uint32(rest)


_SELF = np.arange(256, dtype=np.uint16)


def _average(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def predict(mode: int, left: list[int], top: list[int], right: list[int], corner: list[int]) -> list[int]:
    """The predicted channels of a pixel from those left, above, above right and above left."""
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7):
        return _average(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return _average(top, corner if mode == 8 else right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner, strict=True)]
    half = _average(left, top)
    return [min(255, max(0, h + int((h - c) / 2))) for h, c in zip(half, corner, strict=True)]


def _channels(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def _pixels(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view("<u4")[..., 0]


def predictor(image: np.ndarray, tiles: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Residuals of an image (forward), or the image of residuals."""
    height, width = image.shape
    modes = (tiles >> np.uint32(8)) & np.uint32(15)
    given = _channels(image)
    only = {int(m) for m in np.unique(modes)}
    if not forward and only <= {0, 1}:
        out = given.copy()
        out[0, 0, 3] += np.uint8(255)
        out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
        if only == {1} or height == 1:
            return _pixels(np.cumsum(out, axis=1, dtype=np.uint8))
    if not forward and only == {2}:
        out = given.copy()
        out[0, 0, 3] += np.uint8(255)
        out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
        return _pixels(np.cumsum(out, axis=0, dtype=np.uint8))
    done = [[[0, 0, 0, 0]] * width for _ in range(height)]
    source = given.tolist()
    whole = source if forward else done
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = whole[0][x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = whole[y - 1][0]
            else:
                after = whole[y - 1][x + 1] if x + 1 < width else whole[y][0]
                guess = predict(int(modes[y >> bits, x >> bits]), whole[y][x - 1], whole[y - 1][x], after, whole[y - 1][x - 1])
            sign = -1 if forward else 1
            done[y][x] = [(v + sign * g) & 255 for v, g in zip(source[y][x], guess, strict=True)]
    return _pixels(np.array(done, np.uint8))


def cross_colour(image: np.ndarray, tiles: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    height, width = image.shape
    factors = _channels(np.repeat(np.repeat(tiles, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]).view(np.int8).astype(np.int32)
    c = _channels(image).astype(np.int32)

    def signed(x: np.ndarray) -> np.ndarray:
        return (x & 255).astype(np.uint8).view(np.int8).astype(np.int32)

    def delta(t: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (t * signed(x)) >> 5

    sign = -1 if forward else 1
    green, red, blue = c[..., 1], c[..., 2], c[..., 0]
    new_red = red + sign * delta(factors[..., 0], green)
    blue = blue + sign * (delta(factors[..., 1], green) + delta(factors[..., 2], red if forward else new_red))
    return _pixels(np.stack([blue & 255, green, new_red & 255, c[..., 3]], axis=-1).astype(np.uint8))


def subtract_green(image: np.ndarray, forward: bool) -> np.ndarray:
    c = _channels(image).copy()
    for k in (0, 2):
        c[..., k] = c[..., k] - c[..., 1] if forward else c[..., k] + c[..., 1]
    return _pixels(c)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(image: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = _bundle_bits(len(table))
    index = (image >> np.uint32(8)) & np.uint32(255)
    if bits:
        each = 8 >> bits
        shifts = np.arange(1 << bits, dtype=np.uint32) * np.uint32(each)
        index = ((index[..., None] >> shifts) & np.uint32((1 << each) - 1)).reshape(image.shape[0], -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode_stream(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width) of a VP8L chunk."""
    r = Reader(data)
    if r.read(8) != SIGNATURE:
        raise ValueError("no VP8L signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in {u[0] for u in undo}:
            raise ValueError("a transform is repeated")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            across, down = (now + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            undo.append((kind, read_image(r, across, down, False).reshape(down, across), bits))
        elif kind == PALETTE:
            n = r.read(8) + 1
            table = _pixels(np.cumsum(_channels(read_image(r, n, 1, False)), axis=0, dtype=np.uint8))
            undo.append((kind, table, now))
            now = (now + (1 << _bundle_bits(n)) - 1) >> _bundle_bits(n)
        else:
            undo.append((kind, None, 0))
    image = read_image(r, now, height, True).reshape(height, now)
    for kind, what, extra in reversed(undo):
        if kind == PREDICTOR:
            image = predictor(image, what, extra, False)
        elif kind == CROSS_COLOUR:
            image = cross_colour(image, what, extra, False)
        elif kind == SUBTRACT_GREEN:
            image = subtract_green(image, False)
        else:
            image = _unpalette(image, what, extra)
    return image


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The first chunk of each name in a RIFF WEBP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    out, at = {}, 12
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        out.setdefault(data[at : at + 4], data[at + 8 : at + 8 + n])
        at += 8 + n + n % 2
    return out


def files(data: bytes) -> list[bytes]:
    """RIFF files that follow each other."""
    out, at = [], 0
    while at < len(data) or not out:
        n = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        out.append(data[at : at + n])
        at += n
    return out


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width) of a lossless WebP file."""
    return decode_stream(chunks(data)[b"VP8L"])


class Writer:
    def __init__(self) -> None:
        self.value, self.n, self.parts = 0, 0, []

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 4096:
            self.flush()

    def flush(self) -> None:
        whole = self.n >> 3
        self.parts.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
        self.value >>= 8 * whole
        self.n -= 8 * whole

    def fields(self, values: np.ndarray, widths: np.ndarray) -> None:
        """The last numbers, of widths bits each (32 at most), the lowest bit first."""
        ends = np.cumsum(widths)
        ends += self.n
        at = ends - widths
        size = int(ends[-1])
        words = np.zeros((size >> 6) + 2, np.uint64)
        head = (self.n + 63) // 64
        words[:head] = np.frombuffer(self.value.to_bytes(8 * head, "little"), np.uint64)
        shift, place = (at & 63).astype(np.uint64), at >> 6
        values = values.astype(np.uint64)
        # Bits don't meet, so the numbers that begin in a word add up; one at most goes on in the next.
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        words[place[first]] += np.add.reduceat(values << shift, first)
        over = np.flatnonzero((at & 63) + widths > 64)
        words[place[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        self.parts.append(words.tobytes()[: (size + 7) >> 3])
        self.value = self.n = 0

    def whole(self) -> tuple[int, int]:
        """All bits so far as one number, and how many there are."""
        before = b"".join(self.parts)
        return int.from_bytes(before, "little") | self.value << 8 * len(before), 8 * len(before) + self.n

    def bytes(self) -> bytes:
        self.n = (self.n + 7) & ~7
        self.flush()
        return b"".join(self.parts)


def code_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Huffman lengths of at most `most` bits."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    n = len(counts)
    least = sum(counts.values()) >> (most - 1)  # rarer symbols would get longer codes
    while True:
        ordered = sorted([(c if c > least else least + 1, s) for s, c in counts.items()])
        # Leaves in order, and inner nodes, which come into being in order.
        weights = [c for c, _ in ordered]
        above, leaf, inner = [0] * (2 * n - 1), 0, n
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (inner >= node or weights[leaf] <= weights[inner]):
                    took, leaf = leaf, leaf + 1
                else:
                    took, inner = inner, inner + 1
                above[took] = node
                total += weights[took]
            weights.append(total)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[above[node]] + 1
        if max(depth[:n]) <= most:
            return {s: depth[k] for k, (_, s) in enumerate(ordered)}
        counts = {s: (c + 1) >> 1 for c, s in ordered}
        least >>= 1


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (bits as written, number of bits)."""
    if len(lengths) < 2:
        return dict.fromkeys(lengths, (0, 0))
    code = last = 0
    out = {}
    for n, s in sorted([(n, s) for s, n in lengths.items()]):
        code <<= n - last
        out[s] = (_turned(n)[code], n)
        code, last = code + 1, n
    return out


@cache
def _turned(width: int) -> list[int]:
    return _reversed(width).tolist()


def write_code(w: Writer, lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Write a code and give its table. Few symbols below 256 are written in the simple form."""
    if not lengths or lengths.keys() == {0}:  # the symbol 0 alone
        w.write(1, 4)
        return {0: (0, 0)}
    symbols = sorted(lengths)
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.write(1, 1)
        w.write(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        w.write(wide, 1)
        w.write(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            w.write(symbols[1], 8)
        return canonical(dict.fromkeys(symbols, 1))
    steps, last, at = [], 8, 0
    for s in symbols:
        # Zeros up to the symbol, in runs as long as they may be.
        gap, at = s - at, s + 1
        while gap:
            run = min(gap, 138)
            if run < 3:
                steps += [(0, 0, 0)] * run
            else:
                steps.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
            gap -= run
        n = lengths[s]
        if n == last and len(steps) >= 3 and steps[-1] == steps[-2] == steps[-3] == (n, 0, 0):
            steps[-3:] = [(n, 0, 0), (16, 0, 2)]
        elif n == last and len(steps) >= 2 and steps[-1][0] == 16 and steps[-1][1] < 3:
            steps[-1] = (16, steps[-1][1] + 1, 2)
        else:
            steps.append((n, 0, 0))
        last = n
    own = code_lengths(Counter([s for s, _, _ in steps]), 7)
    order = [own.get(s, 0) for s in LENGTH_ORDER]
    used = max([4, *[k + 1 for k, n in enumerate(order) if n]])
    # The steps up to the last symbol are counted; the rest of the alphabet has no codes.
    count = len(steps)
    if count < 2:
        raise ValueError("a code of one step")
    width = max(2, (count - 2).bit_length() + 1 & ~1)
    value, bits = (used - 4) << 1, 5
    for n, wide in [*((n, 3) for n in order[:used]), (1, 1), ((width - 2) // 2, 3), (count - 2, width)]:
        value |= n << bits
        bits += wide
    table = canonical(own)
    for s, extra, n in steps:
        code, wide = table[s]
        value |= (code | extra << wide) << bits
        bits += wide + n
    w.write(value, bits)
    return canonical(lengths)


def number_prefix(v: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number for a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    high = v.bit_length() - 1
    return 2 * high + (v >> (high - 1) & 1), v & ((1 << (high - 1)) - 1), high - 1


_NEAR_CODE = {xy: k + 1 for k, xy in reversed(list(enumerate(NEAR)))}


def _distance_code(d: int, width: int) -> int:
    for y in range(8):
        for x in (d - y * width,):
            if (x, y) in _NEAR_CODE:
                return _NEAR_CODE[x, y]
    return d + len(NEAR)


def write_image(w: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, least: int = 4) -> None:
    """An entropy-coded image with one group of codes; greedy back-references to the last equal run of `least` pixels."""
    values = pixels.tolist()
    n, at, kept = len(values), 0, 0
    cache, seen = [None] * (1 << cache_bits), {}
    steps: list[tuple] = []
    while at < n:
        length = far = 0
        if references and at + least <= n:
            before = seen.get(tuple(values[at : at + least]))
            if before is not None:
                far = at - before
                length = least
                while at + length < n and length < 4096 and values[at + length] == values[at + length - far]:
                    length += 1
        if cache_bits:
            while kept < at:
                cache[(CACHE_FACTOR * values[kept] & 0xFFFFFFFF) >> (32 - cache_bits)] = values[kept]
                kept += 1
        slot = (CACHE_FACTOR * values[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length:
            steps.append((256 + number_prefix(length)[0], number_prefix(length), number_prefix(_distance_code(far, width))))
        elif cache_bits and cache[slot] == values[at]:
            steps.append((256 + LENGTHS + slot,))
        else:
            v = values[at]
            steps.append((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24))
        if references:
            for k in range(at, min(at + max(1, length), n - least + 1)):
                seen[tuple(values[k : k + least])] = k
        at += max(1, length)
    w.write(1 if cache_bits else 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if main:
        w.write(0, 1)
    counts = [Counter() for _ in range(5)]
    for s in steps:
        counts[0][s[0]] += 1
        if len(s) == 4:
            for k in (1, 2, 3):
                counts[k][s[k]] += 1
        elif len(s) == 3:
            counts[4][s[2][0]] += 1
    tables = [write_code(w, code_lengths(c, MOST_LENGTH) if c else {}) for c in counts]
    for s in steps:
        w.write(*tables[0][s[0]])
        if len(s) == 4:
            for k in (1, 2, 3):
                w.write(*tables[k][s[k]])
        elif len(s) == 3:
            w.write(s[1][1], s[1][2])
            w.write(*tables[4][s[2][0]])
            w.write(s[2][1], s[2][2])


#: Pixels of a back-reference at least, and at most; longest code, which keeps the reader's tables small.
LEAST_MATCH, MOST_MATCH, SAMPLE_BITS = 8, 4096, 12
#: Colours with a share of the pixels of one in so many are taken from the cache.
CACHED_SHARE = 32


def _matches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of back-references in samples: from each place the last equal run, greedily."""
    none = np.zeros(0, np.int64)
    m = len(x) - LEAST_MATCH + 1
    if m < 2:
        return none, none, none
    keys = np.ndarray((m,), "<u8", np.ascontiguousarray(x), strides=(1,))  # the next eight samples at each place
    before = _same_before(keys)
    found = np.flatnonzero(before >= 0)
    if not len(found):
        return none, none, none
    # Places in a row with one distance are one run.
    d = found - before[found]
    last = np.flatnonzero(np.append((np.diff(found) != 1) | (np.diff(d) != 0), True))
    reach = found[last[np.searchsorted(last, np.arange(len(found)))]] + LEAST_MATCH
    places, lengths, k, ends, starts = [], [], 0, reach.tolist(), found.tolist()
    after = np.searchsorted(found, reach).tolist()
    while k < len(starts):
        at, end = starts[k], ends[k]
        places.append(k)
        if end - at > MOST_MATCH:
            lengths.append(MOST_MATCH)
            k += MOST_MATCH
            if k >= len(starts) or ends[k] != end or starts[k] != at + MOST_MATCH:
                k = after[places[-1]]
        else:
            lengths.append(end - at)
            k = after[k]
    places = np.array(places)
    return found[places], np.array(lengths), d[places]


def _prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number for lengths or distances."""
    prefix = np.searchsorted(_LEAST, v, side="right") - 1
    return prefix, v - _LEAST[prefix], _EXTRA[prefix]


def write_samples(w: Writer, x: np.ndarray, width: int, main: bool, cache_bits: int = 0) -> None:
    """An image of green values (the other channels are 0) with fitted codes, back-references and a colour cache."""
    n = len(x)
    at, length, d = _matches(x)
    near = _near(width)[1]
    far = np.array([near.get(v, v + len(NEAR)) for v in d.tolist()], np.int64)
    inside = np.zeros(n + 1, np.int64)
    inside[at] = 1
    inside[at + length] -= 1
    alone = np.flatnonzero(np.cumsum(inside[:n]) == 0)
    own = x[alone].astype(np.int64)
    w.write(1 if cache_bits else 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
        kinds = _slots(0, cache_bits)
        counts = np.bincount(x, minlength=256)
        some = np.flatnonzero(counts)
        # Frequent colours are taken from the cache; others keep one code, as a code that is written costs bits itself.
        often = counts * CACHED_SHARE >= n
        if len(set(kinds[some].tolist())) == len(some):  # a colour stays in its slot
            first = np.zeros(256, np.int64)
            first[x[::-1]] = _places(n)[::-1] if n <= 8 * AHEAD else np.arange(n - 1, -1, -1)
            hit = often[own] & (first[own] < alone)
        else:
            before = _same_before(kinds[x])[alone]
            hit = often[own] & (before >= 0) & (x[before] == x[alone])
        own = np.where(hit, 256 + LENGTHS + kinds[own].astype(np.int64), own)
    if main:
        w.write(0, 1)
    length_prefix, length_more, length_bits = _prefixes(length)
    far_prefix, far_more, far_bits = _prefixes(far)
    # Steps in order: a reference comes after the single pixels before it.
    reference = np.searchsorted(alone, at)
    reference += np.arange(len(at))
    symbols = np.empty(len(alone) + len(at), np.int64)
    single = np.ones(len(symbols), bool)
    single[reference] = False
    symbols[single], symbols[reference] = own, 256 + length_prefix
    tables = []
    for used in (symbols, far_prefix):
        counts = np.bincount(used)
        some = np.flatnonzero(counts)
        counts = dict(zip(some.tolist(), counts[some].tolist(), strict=True))
        codes = write_code(w, code_lengths(counts, SAMPLE_BITS) if counts else {})
        table = np.zeros((max(codes) + 1, 2), np.int64)
        table[list(codes)] = list(codes.values())
        tables.append(table.T)
        if used is symbols:
            w.write(1 | 1 << 4 | 1 << 8, 12)  # red, blue and alpha: the symbol 0 alone
    # Of each step its symbol; of a reference also the length's extra bits, the distance and its extra bits.
    if not len(at):
        value, bits = (t[symbols] for t in tables[0])
    else:
        value, bits = np.zeros((2, len(symbols) + 3 * len(at)), np.int64)
        # Three more fields after each reference move what follows.
        moved = np.zeros(len(symbols), np.int64)
        moved[reference[reference + 1 < len(symbols)] + 1] = 3
        place = np.arange(len(symbols)) + np.cumsum(moved)
        value[place], bits[place] = tables[0][0][symbols], tables[0][1][symbols]
        place = place[reference]
        value[place + 1], bits[place + 1] = length_more, length_bits
        value[place + 2], bits[place + 2] = tables[1][0][far_prefix], tables[1][1][far_prefix]
        value[place + 3], bits[place + 3] = far_more, far_bits
    if bits.any():
        w.fields(value, bits)


def file_of(stream: bytes, more: dict[bytes, bytes] | None = None) -> bytes:
    body = b"WEBP"
    for name, data in {b"VP8L": stream, **(more or {})}.items():
        body += name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def header(width: int, height: int) -> Writer:
    w = Writer()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.write(value, n)
    return w


def write_palette(w: Writer, table: np.ndarray) -> None:
    """The palette transform: ARGB colours as differences."""
    c = _channels(table)
    steps = np.concatenate([c[:1], np.diff(c, axis=0)])
    w.write(1, 1)
    w.write(PALETTE, 2)
    w.write(len(table) - 1, 8)
    if steps[:, [0, 2, 3]].any():
        write_image(w, _pixels(steps), len(table), False)
    else:  # without a cache, with an even code
        green = steps[:, 1]
        bits = max(4, int(green.max()).bit_length())
        w.write(0, 1)
        w.write(*_even_code(bits))
        w.write(1 | 1 << 4 | 1 << 8 | 1 << 12, 16)
        drawn = (green[:, None] >> np.arange(bits - 1, -1, -1)) & 1
        w.write(int.from_bytes(np.packbits(drawn.astype(np.uint8), bitorder="little").tobytes(), "little"), bits * len(table))


@cache
def _even_code(bits: int) -> tuple[int, int]:
    """The bits of a green code whose first values have so many bits each, and their number."""
    w = Writer()
    write_code(w, dict.fromkeys(range(1 << bits), bits))
    return w.whole()


def bundled(index: np.ndarray, colours: int) -> np.ndarray:
    """Rows of palette indices, several in a pixel if the palette is small."""
    bits = _bundle_bits(colours)
    if not bits:
        return index
    each = 1 << bits
    padded = np.pad(index, ((0, 0), (0, -index.shape[1] % each))).reshape(index.shape[0], -1, each)
    return (padded << (np.arange(each) * (8 >> bits))).sum(axis=2)


def encode(image: np.ndarray, predictor_mode: np.ndarray | None = None, factors: np.ndarray | None = None, tile: int = 2, green: bool = False, palette: bool = False, cache_bits: int = 0, references: bool = True) -> bytes:
    """A lossless WebP file of ARGB pixels (height, width) with the transforms that are asked for.

    predictor_mode, factors: the ARGB pixels of the transform's tiles of 2**tile pixels.
    """
    height, width = image.shape
    w = header(width, height)
    now = image.astype(np.uint32)
    if palette:
        table, index = np.unique(now, return_inverse=True)
        write_palette(w, table.astype(np.uint32))
        now = bundled(index.reshape(height, width), len(table)).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    if predictor_mode is not None:
        now = predictor(now, predictor_mode, tile, True)
        w.write(1, 1)
        w.write(PREDICTOR, 2)
        w.write(tile - 2, 3)
        write_image(w, predictor_mode.ravel().astype(np.uint32), predictor_mode.shape[1], False)
    if factors is not None:
        now = cross_colour(now, factors, tile, True)
        w.write(1, 1)
        w.write(CROSS_COLOUR, 2)
        w.write(tile - 2, 3)
        write_image(w, factors.ravel().astype(np.uint32), factors.shape[1], False)
    if green:
        now = subtract_green(now, True)
        w.write(1, 1)
        w.write(SUBTRACT_GREEN, 2)
    w.write(0, 1)
    write_image(w, now.ravel(), now.shape[1], True, cache_bits, references)
    return file_of(w.bytes())

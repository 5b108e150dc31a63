"""Media columns: payloads in lossless WebP files, and pixel arrays read back from them.

A text's UTF-8 bytes, padded with 0 to a positive multiple of 64, become 8-bit samples: the green channel of rows of 64
pixels. The samples are stored through the palette transform, with prefix codes that fit them, back-references and a
colour cache, whatever their number. A file holds the format's highest number of rows, 2**20 samples; longer payloads are a file after
another. `webp.decode` reads any VP8L stream, with its predictor, cross-colour, subtract-green and palette transforms and
groups of codes, through `pixels`.

Defined cases: a null text counts as empty and is stored as 64 zero bytes; equal texts give equal files; a file that
can't be read gives null pixels; repeated rows are stored each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import webp
from .common import map_rows, prepare

#: With 10 bits no two of the 256 places of a palette have one slot of the colour cache.
ALIGN, CACHE_BITS = 64, 10


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    size = max(ALIGN, -(-len(raw) // ALIGN) * ALIGN)
    return raw.ljust(size, b"\0"), len(raw)


def _file(samples: np.ndarray) -> bytes:
    w = webp.header(ALIGN, len(samples) // ALIGN)
    used = np.flatnonzero(np.bincount(samples, minlength=256))
    place = np.zeros(256, np.uint8)
    place[used] = np.arange(len(used))
    index = webp.bundled(place[samples].reshape(-1, ALIGN), len(used))
    webp.write_palette(w, used.astype(np.uint32) << np.uint32(8))
    w.write(0, 1)
    webp.write_samples(w, index.ravel().astype(np.uint8), index.shape[1], True, CACHE_BITS)
    return webp.file_of(w.bytes())


def stored(payload: bytes) -> bytes:
    """The WebP file of a payload, or several, one after another."""
    samples, most = np.frombuffer(payload, np.uint8), ALIGN * webp.MOST_SIDE
    return b"".join(_file(samples[i : i + most]) for i in range(0, len(samples), most))


def decoded(media: bytes) -> np.ndarray:
    """The pixels of one or more files of one width, below each other."""
    images = [webp.decode(x) for x in webp.files(media)]
    return images[0] if len(images) == 1 else np.concatenate(images)


def restored(media: bytes) -> bytes:
    """The payload of a file that `stored` made."""
    return ((decoded(media) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, deviation and entropy of the samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n[n > 0] / n.sum()
    mean = float((n * np.arange(256)).sum() / n.sum())
    deviation = float(np.sqrt((n * (np.arange(256) - mean) ** 2).sum() / n.sum()))
    return f"{len(payload)}:{mean:.6f}:{deviation:.6f}:{float(-(p * np.log2(p)).sum()) + 0.0:.6f}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the file) for every row of docs(doc_id, text)."""
    prepare(docs.sparkSession)

    def run(c):
        found = [payload_of(x) for x in c["text"]]
        return {"doc_id": c["doc_id"], "n_bytes": [n for _, n in found], "media": [stored(p) for p, _ in found]}

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", run)


def pixels(files: DataFrame, column: str = "media") -> DataFrame:
    """width, height and argb (an array, row by row) of each file in `column`, which stays; null for what can't be read."""
    prepare(files.sparkSession)

    def run(c):
        out = {column: c[column], "width": [], "height": [], "argb": []}
        for data in c[column]:
            try:
                image = decoded(data)
            except (ValueError, KeyError, IndexError, TypeError):
                image = None
            out["width"].append(None if image is None else image.shape[1])
            out["height"].append(None if image is None else image.shape[0])
            out["argb"].append(None if image is None else image.ravel().tolist())
        return out

    return map_rows(files.select(column), f"{column} binary, width int, height int, argb array<long>", run)


def digests(docs: DataFrame) -> DataFrame:
    """Each payload stored, read back and described: the columns of the media contract."""
    prepare(docs.sparkSession)

    def run(c):
        out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for text in c["text"]:
            payload, n = payload_of(text)
            data = stored(payload)
            back = restored(data)
            row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature(back))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": c["doc_id"], **out}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(docs.select("doc_id", "text"), schema, run)

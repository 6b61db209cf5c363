"""Media columns: signature sniffing.

An Aho-Corasick automaton over all magic numbers finds the places where a file may begin; a validator per format then
walks the structure there and confirms it together with its length. The confirmed file at offset 0 corrects the
declared type, every further one is carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magic bytes (with their distance from the start of the file) and the type they announce.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"MThd", 0, "audio/midi"),
    (b"ftyp", 4, "video/mp4"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
]
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


class Content:
    """Bytes under inspection, with what validators learn about them. A text can hold a magic number at every few
    places, so nothing may walk or search the rest of the content once per magic number: places of a needle are found
    once, and every step of a walk is taken once, whichever start it belongs to."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._known: dict = {}

    def once(self, name, make):
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    def places(self, pattern: bytes) -> list[int]:
        return self.once(pattern, lambda: [m.start() for m in re.finditer(pattern, self.raw)])

    def first(self, pattern: bytes, at: int, end: int | None = None) -> int:
        """The first match that begins in at..end-1, or -1."""
        found = self.places(pattern)
        i = bisect_left(found, at)
        return found[i] if i < len(found) and (end is None or found[i] < end) else -1

    def walk(self, step, state) -> int:
        """step(state) gives (next state, None) or (None, result); the result of the walk from `state`."""
        seen, path = self.once(step, dict), []
        while state not in seen:
            path.append(state)
            state, result = step(self.raw, state) if step not in _WITH_CONTENT else step(self, state)
            if state is None:
                break
        else:
            result = seen[state]
        for s in path:
            seen[s] = result
        return result


@lru_cache(64)
def _zeros(k: int) -> list[list[int]]:
    """What 2^k zero bytes do to a CRC-32, as a table for each of its four bytes (the register is linear over bits)."""
    if k == 0:
        one = lambda c: zlib.crc32(b"\0", c ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        columns = [one(1 << i) for i in range(32)]
    else:
        columns = [_shifted(_shifted(1 << i, k - 1), k - 1) for i in range(32)]
    tables = []
    for byte in range(4):
        t = [0] * 256
        for i in range(8):
            for v in range(1 << i):
                t[(1 << i) | v] = t[v] ^ columns[8 * byte + i]
        tables.append(t)
    return tables


def _shifted(crc: int, k: int) -> int:
    t = _zeros(k)
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


class _Checksums:
    """CRC-32 of any part of the content from those of its beginnings: constant work in the length of the part."""

    STEP = 1024

    def __init__(self, raw: bytes):
        self.raw, self.known, crc = raw, [0], 0
        for i in range(0, len(raw) - self.STEP + 1, self.STEP):
            crc = zlib.crc32(raw[i : i + self.STEP], crc)
            self.known.append(crc)

    def _upto(self, p: int) -> int:
        i = p // self.STEP
        return zlib.crc32(self.raw[i * self.STEP : p], self.known[i])

    def of(self, lo: int, hi: int) -> int:
        if hi - lo <= self.STEP:
            return zlib.crc32(self.raw[lo:hi])
        crc, n, k = self._upto(lo), hi - lo, 0
        while n:
            if n & 1:
                crc = _shifted(crc, k)
            n, k = n >> 1, k + 1
        return crc ^ self._upto(hi)


def _png_step(c: Content, p: int):
    b = c.raw
    if p + 12 > len(b):
        return None, 0
    n = int.from_bytes(b[p : p + 4], "big")
    end, kind = p + 12 + n, b[p + 4 : p + 8]
    if end > len(b) or not kind.isalpha() or c.once("crc", lambda: _Checksums(b)).of(p + 4, end - 4) != int.from_bytes(b[end - 4 : end], "big"):
        return None, 0
    return (None, end) if kind == b"IEND" else (end, None)


def _png(c: Content, at: int) -> int:
    head = c.raw[at + 8 : at + 16]
    return max(0, c.walk(_png_step, at + 8) - at) if head == b"\0\0\0\rIHDR" else 0


#: A marker in entropy-coded data: neither stuffing nor a restart.
_JPEG_MARKER = rb"\xff(?=[^\x00\xd0-\xd7])"


def _jpeg_step(c: Content, state: tuple[int, bool]):
    b, (p, frame) = c.raw, state
    if p + 4 > len(b) or b[p] != 0xFF:
        return None, 0
    kind = b[p + 1]
    if kind == 0xFF:
        return (p + 1, frame), None
    n = int.from_bytes(b[p + 2 : p + 4], "big")
    if n < 2 or kind in (0x00, 0x01, 0xD8, 0xD9) or 0xD0 <= kind <= 0xD7:
        return None, 0
    frame |= kind in (0xC0, 0xC1, 0xC2)
    p += 2 + n
    if kind == 0xDA:
        p = c.first(_JPEG_MARKER, p)
        if p < 0:
            return None, 0
        if b[p + 1] == 0xD9:
            return None, p + 2 if frame else 0
    return (p, frame), None


def _jpeg(c: Content, at: int) -> int:
    return max(0, c.walk(_jpeg_step, (at + 2, False)) - at)


def _gif_block(b: bytes, p: int):
    """The end of a chain of sub-blocks, or -1."""
    if p >= len(b):
        return None, -1
    return (p + 1 + b[p], None) if b[p] else (None, p + 1)


def _gif_step(c: Content, state: tuple[int, bool]):
    b, (p, image) = c.raw, state
    if not 0 <= p < len(b):
        return None, 0
    if b[p] == 0x3B:
        return None, p + 1 if image else 0
    if b[p] == 0x21:
        return (c.walk(_gif_block, p + 2), image), None
    if b[p] == 0x2C and p + 10 < len(b):
        return (c.walk(_gif_block, p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)), True), None
    return None, 0


def _gif(c: Content, at: int) -> int:
    b = c.raw
    if at + 13 > len(b):
        return 0
    return max(0, c.walk(_gif_step, (at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0), False)) - at)


def _bmp(c: Content, at: int) -> int:
    b = c.raw
    if at + 30 > len(b) or b[at + 6 : at + 10] != b"\0\0\0\0":
        return 0
    size, pixels, header = struct.unpack_from("<I4xII", b, at + 2)
    return size if header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= pixels <= size <= len(b) - at else 0


class _Chain:
    """Places and the next place of each, as trees towards the places that have none: every node also knows one far ahead
    and its distance from the root, so that a node is found from any other on its way in logarithmic time."""

    def __init__(self, after):
        """after(p): the next place, always a later one, or None."""
        self.after, self.node = after, {}

    def _grow(self, p: int) -> None:
        path, node = [], self.node
        while p not in node:
            q = self.after(p)
            if q is None:
                node[p] = (p, p, 0)
                break
            path.append((p, q))
            p = q
        for p, ahead in reversed(path):
            _, far, depth = node[ahead]
            even = depth - node[far][2] == node[far][2] - node[node[far][1]][2]
            node[p] = (ahead, node[far][1] if even else ahead, depth + 1)

    def depth(self, p: int) -> int:
        """Steps from p to the place that has no next one."""
        self._grow(p)
        return self.node[p][2]

    def last(self, p: int, fits) -> int:
        """The last place from p on that fits; from the first that does not fit on, none may (p itself does)."""
        self._grow(p)
        while True:
            ahead, far, depth = self.node[p]
            if depth and fits(far):
                p = far
            elif depth and fits(ahead):
                p = ahead
            else:
                return p


def _riff_chunks(b: bytes) -> _Chain:
    """RIFF chunks; they begin at even places, seen from the file's start."""

    def after(p: int):
        if p + 8 > len(b):
            return None
        q = p + 8 + int.from_bytes(b[p + 4 : p + 8], "little")
        return q + ((q ^ p) & 1)

    return _Chain(after)


def _riff(c: Content, at: int) -> int:
    b = c.raw
    if at + 12 > len(b) or b[at + 8 : at + 12] not in RIFF_FORMS:
        return 0
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b) or at + 20 > end:
        return 0
    chunks = c.once("chunks", lambda: _riff_chunks(b))
    return end - at if chunks.after(chunks.last(at + 12, lambda p: p <= end - 8)) in (end, end + 1) else 0


def _flac_step(b: bytes, p: int):
    if p + 4 > len(b) or b[p] & 0x7F > 6:
        return None, 0
    q = p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
    if b[p] >> 7:  # frames follow up to the end: their number is not written in the header
        return None, len(b) if q <= len(b) and (q == len(b) or b[q] == 0xFF) else 0
    return q, None


def _flac(c: Content, at: int) -> int:
    first = c.raw[at + 4 : at + 8]
    return max(0, c.walk(_flac_step, at + 4) - at) if len(first) == 4 and first[0] & 0x7F == 0 and first[1:] == b"\0\0\x22" else 0


def _ogg_step(b: bytes, p: int):
    if b[p : p + 5] != b"OggS\0" or p + 27 > len(b):
        return None, 0
    n = b[p + 26]
    end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
    if p + 27 + n > len(b) or end > len(b):
        return None, 0
    return (None, end) if b[p + 5] & 4 else (end, None)


def _ogg(c: Content, at: int) -> int:
    return max(0, c.walk(_ogg_step, at) - at)


def _midi_tracks(b: bytes) -> _Chain:
    return _Chain(lambda p: p + 8 + int.from_bytes(b[p + 4 : p + 8], "big") if b[p : p + 4] == b"MTrk" and p + 8 <= len(b) else None)


def _midi(c: Content, at: int) -> int:
    b = c.raw
    if at + 14 > len(b) or b[at + 4 : at + 8] != b"\0\0\0\6":
        return 0
    tracks, p = int.from_bytes(b[at + 10 : at + 12], "big"), at + 14
    chain = c.once("tracks", lambda: _midi_tracks(b))
    left = chain.depth(p) - tracks
    if not tracks or left < 0:
        return 0
    p = chain.last(p, lambda q: chain.node[q][2] >= left)
    return p - at if p <= len(b) else 0


_BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"meta", b"uuid", b"styp", b"pdin")


def _mp4_step(b: bytes, state: tuple[int, bool, bool]):
    """state: place, whether ftyp was seen, whether media was."""
    p, kind, media = state
    found = b[p + 4 : p + 8]
    if p + 8 <= len(b) and found in _BOXES:
        n = int.from_bytes(b[p : p + 4], "big")
        n = int.from_bytes(b[p + 8 : p + 16], "big") if n == 1 else n or len(b) - p
        if n >= 8 and p + n <= len(b):
            return (p + n, kind or found == b"ftyp", media or found in (b"moov", b"mdat", b"moof")), None
    return None, p if kind and media else 0


def _mp4(c: Content, at: int) -> int:
    return max(0, c.walk(_mp4_step, (at, False, False)) - at)


def _pdf_ends(c: Content) -> list[int]:
    """For each end mark the last one that belongs to the same file: updates append a startxref and an end mark."""
    ends = c.places(rb"%%EOF")
    out = list(ends)
    for i in range(len(ends) - 2, -1, -1):
        if c.first(rb"startxref", ends[i], ends[i + 1] - 8) >= 0 and c.first(rb"%PDF-", ends[i], ends[i + 1] - 4) < 0:
            out[i] = out[i + 1]
    return out


def _pdf(c: Content, at: int) -> int:
    ends = c.places(rb"%%EOF")
    i = bisect_left(ends, at)
    if not c.raw[at + 5 : at + 6].isdigit() or i == len(ends) or c.first(rb"startxref", at, ends[i] - 8) < 0:
        return 0
    return c.once("pdf", lambda: _pdf_ends(c))[i] + 5 - at


def _zip_ends(c: Content) -> dict[int, int]:
    """Where archives end, by their beginning: every end record names the place of its directory."""
    b, out = c.raw, {}
    for p in c.places(rb"PK\x05\x06"):
        if p + 22 <= len(b):
            size, start, note = struct.unpack_from("<IIH", b, p + 12)
            at = p - start - size
            if at >= 0 and p + 22 + note <= len(b) and b[at + start : at + start + 4] == b"PK\x01\x02":
                out.setdefault(at, p + 22 + note)
    return out


def _zip(c: Content, at: int) -> int:
    return max(0, c.once("zip", lambda: _zip_ends(c)).get(at, 0) - at)


#: Steps that need more than the bytes.
_WITH_CONTENT = frozenset((_jpeg_step, _gif_step, _png_step))
VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/flac": _flac, "audio/ogg": _ogg, "audio/midi": _midi, "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip}


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, back, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, kind))
    found.make_automaton()
    return found


def sniff(content: bytes | None) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each confirmed file, outermost only, in order of offset.

    Null and empty contents give an empty list. A magic number whose structure does not check out is ignored."""
    out, done = [], 0
    if not content:
        return out
    held = Content(content)
    starts = sorted((end - back, kind) for end, (back, kind) in _automaton().iter(content.decode("latin-1")) if end >= back)
    for at, kind in starts:
        if at >= done and (n := VALIDATORS[kind](held, at)):
            out.append((RIFF_FORMS[content[at + 8 : at + 12]] if kind == "riff" else kind, at, n))
            done = at + n
    return out


SNIFFED = "struct<declared:string,detected:string,corrected:boolean,media:array<struct<type:string,offset:bigint,length:bigint>>>"


def sniff_columns(df: DataFrame, content: str, declared: str | None = None, into: str = "sniffed") -> DataFrame:
    """Add struct `into`: the declared type, the type of the file at offset 0 (null if none is confirmed), whether the
    declaration was wrong, and every confirmed file with offset and length. Other columns stay as they are."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf(SNIFFED)
    def look(contents, types):
        import pandas as pd

        rows = []
        for raw, said in zip(contents, types, strict=True):
            media = sniff(bytes(raw) if raw is not None else None)
            real = media[0][0] if media and media[0][1] == 0 else None
            rows.append((said, real, real is not None and said != real, [{"type": t, "offset": o, "length": n} for t, o, n in media]))
        return pd.DataFrame(rows, columns=["declared", "detected", "corrected", "media"])

    return df.withColumn(into, look(F.col(content), F.col(declared) if declared else F.lit(None).cast("string")))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit PCM in a RIFF file, one sample a byte."""
    pad = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def wav_samples(content: bytes) -> bytes:
    """The samples of the data chunk, found by walking the chunks."""
    p = 12
    while p + 8 <= len(content):
        n = int.from_bytes(content[p + 4 : p + 8], "little")
        if content[p : p + 4] == b"data":
            return content[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("a WAV file without a data chunk")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _feature(kind: str, samples: bytes, carved: int) -> str:
    import numpy as np

    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    cross = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"type={kind};samples={len(x)};sum={int(x.sum())};power={int((x * x).sum())};crossings={cross};low={int(x.min())};high={int(x.max())};carved={carved}"


def store_and_sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as an 8-bit WAV with an unknown declared type; sniffed, carved and read back."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8")
            stored = to_wav(raw + b"\0" * ((-len(raw) % 64) or (0 if raw else 64)))
            media = sniff(stored)
            kind, at, n = media[0]
            samples = wav_samples(stored[at : at + n])
            rows.append((doc_id, len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), _feature(kind, samples, len(sniff(samples)))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(DIGEST), DIGEST, strict=True)], schema=DIGEST)


def media_digest(docs: DataFrame) -> DataFrame:
    """One row per document. Null text counts as empty; an empty text is stored as 64 zero bytes; repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(store_and_sniff, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

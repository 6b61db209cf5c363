import hashlib
import struct
import zlib

from tessella.llm import media
from tests.llm.common import docs, empty, rows


def png(n=3):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", n, n, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (n * n + n))) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"


def test_carves_confirmed_files_only():
    wav = media.to_wav(b"abc")
    raw = b"BM junk RIFF" + png() + b"GIF89a no gif" + gif() + b"\xff\xd8\xff no jpeg" + wav
    found = media.sniff(raw)
    assert [t for t, _, _ in found] == ["image/png", "image/gif", "audio/wav"]
    for kind, at, n in found:
        assert raw[at : at + n] == {"image/png": png(), "image/gif": gif(), "audio/wav": wav}[kind]
    assert media.sniff(png()[:-1]) == [] and media.sniff(None) == [] and media.sniff(b"") == []


def test_wav_round_trip():
    for payload in (b"", b"x", bytes(range(256)) * 3, b"RIFF" * 5):
        assert media.wav_samples(media.to_wav(payload)) == payload


def test_more_formats():
    import gzip
    import io
    import zipfile

    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    mp4 = box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", b"12345")
    midi = b"MThd\0\0\0\6\0\0\0\1\0\x60MTrk\0\0\0\4\0\xff\x2f\0"
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\1\2\3\0"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "text")
    for kind, raw in (("video/mp4", mp4), ("audio/midi", midi), ("image/bmp", bmp), ("application/pdf", pdf), ("application/zip", held.getvalue())):
        assert media.sniff(b"..." + raw + b"...") == [(kind, 3, len(raw))]
    assert media.sniff(gzip.compress(b"x")) == []


def test_columns_correct_declared_types(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "image/jpeg"), (2, bytearray(gif()), "image/gif"), (3, None, "x"), (4, bytearray(b""), None)], "id int, body binary, said string")
    got = {r.id: r.sniffed for r in media.sniff_columns(df, "body", "said").collect()}
    assert (got[1].detected, got[1].corrected) == ("image/png", True)
    assert (got[2].detected, got[2].corrected) == ("image/gif", False)
    assert got[3].media == [] and got[3].detected is None and not got[4].corrected


def test_digest(spark):
    got = media.media_digest(docs(spark)).collect()
    want = []
    for r in rows():
        raw = (r[1] or "").encode()
        padded = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        want.append((r[0], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert media.media_digest(empty(spark)).count() == 0


def test_many_magic_numbers_take_linear_time():
    """A few megabytes of starts that all look far ahead, or walk the same chain."""
    import time

    units = (b"%PDF-1 ", b"PK\x03\x04", b"%PDF-1 startxref %%EOF", b"GIF89a0000000!00", b"\0\0\0\x08ftyp", b"\xff\xd8\xff\xc0\x00\x04xy\xff\xda\x00\x02", b"RIFF\xf0\xff\x0f\0WAVEAAAA\0\0\0\0", b"fLaC\0\0\0\x22" + b"\0" * 34, b"OggS\0" + b"\0" * 22)
    part = lambda kind, body, n=None: struct.pack(">I", len(body) if n is None else n) + kind + body
    head = part(b"IHDR", b"\0\0\0\1\0\0\0\1\1\0\0\0\0")
    png_start = b"\x89PNG\r\n\x1a\n" + head + struct.pack(">I", zlib.crc32(head[4:]))
    units += (b"MTrk\0\0\0\x0eMThd\0\0\0\6\0\1\x7f\x7f\0\1", b"MThd\0\0\0\6\0\1\0\2\0\1MTrk\0\0\0\0", b"BM" + struct.pack("<I4xII", 10**6, 54, 40) + b"\0" * 8, png_start + part(b"IDAT", b"", 2_000_000), png_start + part(b"IDAT", b"", 1000), b"GIF87a" + b"\0" * 7)
    assert {m[0] for m in media.MAGIC} <= {m[0] for m in media.MAGIC if any(m[0] in u for u in units)}
    for unit in units:
        raw = unit * (4_000_000 // len(unit))
        began = time.time()
        found = media.sniff(raw)
        assert time.time() - began < 5, unit
        if b"BM" in unit:  # a header claims its own size
            assert len(found) == 3
            continue
        if unit.startswith(b"MTrk"):  # chains long enough for the tracks that a header counts
            assert {n for _, _, n in found} == {14 + 0x7F7F * 22} and len(found) == 5
            continue
        assert len(found) == (4_000_000 // len(unit) if b"startxref" in unit else 0)


def naive(raw):
    """PDF, ZIP and RIFF files by looking from each place to the end."""
    out, done = [], 0
    for at in range(len(raw)):
        n, kind = 0, None
        if raw[at : at + 5] == b"%PDF-" and raw[at + 5 : at + 6].isdigit():
            end = raw.find(b"%%EOF", at)
            if end >= 0 and raw.find(b"startxref", at, end) >= 0:
                while (more := raw.find(b"%%EOF", end + 5)) > 0 and raw.find(b"startxref", end, more) >= 0 and raw.find(b"%PDF-", end, more) < 0:
                    end = more
                n, kind = end + 5 - at, "application/pdf"
        elif raw[at : at + 4] == b"PK\x03\x04":
            for p in range(at, len(raw) - 21):
                size, start, note = struct.unpack_from("<IIH", raw, p + 12)
                if raw[p : p + 4] == b"PK\x05\x06" and at + start + size == p and p + 22 + note <= len(raw) and raw[at + start : at + start + 4] == b"PK\x01\x02":
                    n, kind = p + 22 + note - at, "application/zip"
                    break
        elif raw[at : at + 4] == b"RIFF" and raw[at + 8 : at + 12] == b"WAVE":
            end, p, chunks = at + 8 + int.from_bytes(raw[at + 4 : at + 8], "little"), at + 12, 0
            while end <= len(raw) and p + 8 <= end:
                p += 8 + int.from_bytes(raw[p + 4 : p + 8], "little")
                p, chunks = p + ((p - at) & 1), chunks + 1
            if chunks and end <= len(raw) and p in (end, end + 1):
                n, kind = end - at, "audio/wav"
        elif raw[at : at + 8] == b"MThd\0\0\0\6" and at + 14 <= len(raw):
            tracks, p = int.from_bytes(raw[at + 10 : at + 12], "big"), at + 14
            k = tracks
            while k and raw[p : p + 4] == b"MTrk" and p + 8 <= len(raw):
                p, k = p + 8 + int.from_bytes(raw[p + 4 : p + 8], "big"), k - 1
            if tracks and not k and p <= len(raw):
                n, kind = p - at, "audio/midi"
        elif raw[at : at + 8] == b"\x89PNG\r\n\x1a\n" and raw[at + 8 : at + 16] == b"\0\0\0\rIHDR":
            p = at + 8
            while p + 12 <= len(raw):
                end = p + 12 + int.from_bytes(raw[p : p + 4], "big")
                if end > len(raw) or not raw[p + 4 : p + 8].isalpha() or zlib.crc32(raw[p + 4 : end - 4]) != int.from_bytes(raw[end - 4 : end], "big"):
                    break
                if raw[p + 4 : p + 8] == b"IEND":
                    n, kind = end - at, "image/png"
                    break
                p = end
        if n and at >= done:
            out.append((kind, at, n))
            done = at + n
    return out


def test_checksums_of_parts():
    import random

    rng = random.Random(1)
    raw = rng.randbytes(9000)
    sums = media._Checksums(raw)
    for _ in range(500):
        lo, hi = sorted((rng.randrange(9001), rng.randrange(9001)))
        assert sums.of(lo, hi) == zlib.crc32(raw[lo:hi])


def test_equals_a_naive_search():
    import io
    import random
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a", "t")
    pieces = [media.to_wav(b"abc"), media.to_wav(b"abcd")[:-3], b"%PDF-1 ", b"startxref", b"%%EOF", held.getvalue(), b"PK\x03\x04", b"PK\x05\x06", b"RIFF\x18\0\0\0WAVE", b"aaaa\x01\0\0\0", b"data\0\0\0\0", b"x", png(), png()[:-12], b"MThd\0\0\0\6\0\1\0\2\0\1", b"MTrk\0\0\0\4abcd", b"MTrk\0\0\0\0"]
    rng, hits = random.Random(4), 0
    for _ in range(1500):
        raw = bytearray(b"".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))))
        for _ in range(rng.choice([0, 0, 1, 2])):
            raw[rng.randrange(len(raw))] = rng.choice([0, 1, 8, 255])
        found = naive(bytes(raw))
        assert media.sniff(bytes(raw)) == found, bytes(raw)
        hits += len(found)
    assert hits > 500


def test_every_column_of_the_digest(spark):
    """media_bytes, media_sha256 and feature against the standard library's WAV module."""
    import io
    import wave

    got = sorted(map(tuple, media.media_digest(docs(spark)).collect()), key=str)
    want = []
    for r in rows():
        raw = (r[1] or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        x = [b - 128 for b in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
        feature = f"type=audio/wav;samples={len(x)};sum={sum(x)};power={sum(v * v for v in x)};crossings={crossings};low={min(x)};high={max(x)};carved=0"
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(held.getvalue()), hashlib.sha256(held.getvalue()).hexdigest(), feature))
    assert got == sorted(want, key=str)

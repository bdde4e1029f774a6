"""Media columns: signature sniffing, carving and lossless payloads.

An Aho-Corasick automaton finds every magic number in one pass over the bytes; a validator of
the format then confirms structure and length, so that a number that stands there by chance
is no medium. What is confirmed corrects a declared type, and media inside other bytes are
carved out. Payloads are stored as 8-bit samples of WAVE, PNG or bitmap files and read back
through the same sniffing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import materialise, table

UNIT = 64
RATE = 8000


@dataclass(frozen=True)
class Medium:
    """A confirmed medium: its type and where its bytes lie, end exclusive."""

    kind: str
    start: int
    end: int


# --- validators: the end of a medium that starts at ``at``, or None ---------------------------


def _riff(raw: bytes, at: int) -> tuple[str, int] | None:
    if len(raw) < at + 12:
        return None
    size, form = struct.unpack_from("<I", raw, at + 4)[0], raw[at + 8 : at + 12]
    end = at + 8 + size + (size & 1)
    if form not in (b"WAVE", b"WEBP", b"AVI ") or end > len(raw) or size < 4:
        return None
    pos, names = at + 12, set()
    while pos + 8 <= at + 8 + size:
        length = struct.unpack_from("<I", raw, pos + 4)[0]
        names.add(raw[pos : pos + 4])
        pos += 8 + length + (length & 1)
    if pos not in (at + 8 + size, at + 8 + size + 1) or form == b"WAVE" and not {b"fmt ", b"data"} <= names:
        return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[form], end


def _png(raw: bytes, at: int) -> tuple[str, int] | None:
    pos, first = at + 8, True
    while pos + 12 <= len(raw):
        length, name = struct.unpack_from(">I", raw, pos)[0], raw[pos + 4 : pos + 8]
        end = pos + 12 + length
        if end > len(raw) or first != (name == b"IHDR") or zlib.crc32(memoryview(raw)[pos + 4 : end - 4]) != struct.unpack_from(">I", raw, end - 4)[0]:
            return None
        if name == b"IEND":
            return "image/png", end
        pos, first = end, False
    return None


def _gif(raw: bytes, at: int) -> tuple[str, int] | None:
    if len(raw) < at + 13:
        return None
    flags = raw[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos < len(raw):
        mark = raw[pos]
        if mark == 0x3B:
            return "image/gif", pos + 1
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 < len(raw):
            local = raw[pos + 9]
            pos += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        else:
            return None
        while pos < len(raw) and raw[pos]:
            pos += raw[pos] + 1
        pos += 1
    return None


def _jpeg(raw: bytes, at: int) -> tuple[str, int] | None:
    pos, scanned = at + 2, False
    while pos + 4 <= len(raw):
        if raw[pos] != 0xFF:
            return None
        mark = raw[pos + 1]
        if mark in (0x00, 0x01, 0xD8) or 0xD0 <= mark <= 0xD7:
            return None
        length = struct.unpack_from(">H", raw, pos + 2)[0]
        pos += 2 + length
        if length < 2 or pos > len(raw):
            return None
        if mark == 0xDA:
            scanned = True
            while True:  # entropy-coded bytes: up to a marker that is no stuffing or restart
                pos = raw.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(raw):
                    return None
                if raw[pos + 1] == 0 or 0xD0 <= raw[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
            if raw[pos + 1] == 0xD9:
                return "image/jpeg", pos + 2
    return ("image/jpeg", pos + 2) if scanned and raw[pos : pos + 2] == b"\xff\xd9" else None


def _bmp(raw: bytes, at: int) -> tuple[str, int] | None:
    if len(raw) < at + 30:
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", raw, at + 2)
    planes, depth = struct.unpack_from("<HH", raw, at + 26)
    ok = reserved == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return ("image/bmp", at + size) if ok and 14 + header <= offset <= size and at + size <= len(raw) else None


class Finder:
    """Searches of one run of bytes from places that only grow: each byte is looked at once a needle."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.known: dict[bytes, int] = {}

    def find(self, needle: bytes, at: int) -> int:
        found = self.known.get(needle, 0)
        if 0 <= found < at or needle not in self.known:
            found = self.known[needle] = self.raw.find(needle, at)
        return found


def _pdf(raw: bytes, at: int, finder: Finder) -> tuple[str, int] | None:
    if not raw[at + 5 : at + 6].isdigit():
        return None
    end = finder.find(b"%%EOF", at)
    start = finder.find(b"startxref", at)
    return ("application/pdf", end + 5) if 0 <= start < end else None


def _gzip(raw: bytes, at: int) -> tuple[str, int] | None:
    unpack = zlib.decompressobj(31)
    try:
        pos = at
        while not unpack.eof and pos < len(raw):
            data = raw[pos : pos + 65536]
            pos += len(data)
            while data:
                unpack.decompress(data, 65536)
                data = unpack.unconsumed_tail
        return ("application/gzip", pos - len(unpack.unused_data)) if unpack.eof else None
    except zlib.error:
        return None


def _crc_table(polynomial: int, bits: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial) & mask if c & top else c << 1
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_BLOCKS = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}


def _flac_header(raw: bytes, at: int) -> tuple[int, int] | None:
    """Where a frame's header ends and how many samples its block has."""
    if raw[at : at + 1] != b"\xff" or at + 6 > len(raw) or raw[at + 1] & 0xFE != 0xF8:
        return None
    size, rate, lead = raw[at + 2] >> 4, raw[at + 2] & 15, raw[at + 4]
    if size == 0 or rate == 15 or raw[at + 3] & 1:
        return None
    ones = next((i for i in range(8) if not lead << i & 0x80), 8)
    pos = at + 4 + max(1, ones)
    if ones in (1, 8) or any(b >> 6 != 2 for b in raw[at + 5 : pos]):
        return None
    wide = {6: 1, 7: 2}.get(size, 0)
    block = _BLOCKS.get(size) or int.from_bytes(raw[pos : pos + wide], "big") + 1
    pos += wide + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for b in raw[at:pos]:
        crc = _CRC8[crc ^ b]
    return (pos + 1, block) if pos < len(raw) and raw[pos] == crc else None


def _flac(raw: bytes, at: int) -> tuple[str, int] | None:
    """Metadata blocks, then frames whose checksums hold, up to the number of samples that the first block names."""
    pos, total = at + 4, 0
    while True:
        if pos + 4 > len(raw):
            return None
        last, kind, length = raw[pos] >> 7, raw[pos] & 127, int.from_bytes(raw[pos + 1 : pos + 4], "big")
        if kind == 127 or pos == at + 4 and (kind, length) != (0, 34):
            return None
        if pos == at + 4:
            total = int.from_bytes(raw[pos + 17 : pos + 22], "big") & ((1 << 36) - 1)
        pos += 4 + length
        if last:
            break
    done, end = 0, None
    while (total == 0 or done < total) and (head := _flac_header(raw, pos)):
        crc = 0
        for b in raw[pos : head[0]]:
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b]
        done += head[1]
        for i in range(head[0], len(raw)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ raw[i]]
            # The checksum that closes a frame leaves no remainder; another frame or the end follows.
            if crc == 0 and i > head[0] + 1 and (total and done >= total or _flac_header(raw, i + 1) or not total and i + 1 == len(raw)):
                pos = end = i + 1
                break
        else:
            return None
    return ("audio/flac", end) if end and (not total or done >= total) else None


SIGNATURES: dict[bytes, Callable[..., tuple[str, int] | None]] = {
    b"RIFF": _riff, b"\x89PNG\r\n\x1a\n": _png, b"GIF87a": _gif, b"GIF89a": _gif, b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp, b"%PDF-": _pdf, b"\x1f\x8b\x08": _gzip, b"fLaC": _flac,
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in SIGNATURES:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(raw: bytes) -> list[Medium]:
    """The media in ``raw``, from the left; what lies inside a confirmed medium belongs to it."""
    out, free, finder = [], 0, Finder(raw)
    for last, magic in _automaton().iter(raw.decode("latin-1")):
        at = last + 1 - len(magic)
        if at < free:
            continue
        check = SIGNATURES[magic]
        if got := check(raw, at, finder) if check is _pdf else check(raw, at):
            out.append(Medium(got[0], at, got[1]))
            free = got[1]
    return out


def corrected_type(raw: bytes | None, declared: str | None) -> str | None:
    """The type that the bytes at the start confirm, else the declared one; null bytes keep it."""
    media = sniff(raw) if raw else []
    return media[0].kind if media and media[0].start == 0 else declared


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """``payload`` with zero bytes up to a positive multiple of ``unit``."""
    return payload + b"\0" * (-len(payload) % unit if payload else unit)


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM file; the number of samples is even."""
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(samples)) + b"WAVE" + head + samples


def from_wave(raw: bytes) -> bytes:
    """The samples of an 8-bit mono PCM file."""
    pos = 12
    while pos + 8 <= len(raw):
        name, length = raw[pos : pos + 4], struct.unpack_from("<I", raw, pos + 4)[0]
        if name == b"fmt " and struct.unpack_from("<HH", raw, pos + 8) + struct.unpack_from("<H", raw, pos + 22) != (1, 1, 8):
            raise ValueError("not 8-bit mono PCM")
        if name == b"data":
            return raw[pos + 8 : pos + 8 + length]
        pos += 8 + length + (length & 1)
    raise ValueError("no samples")


def to_bmp(samples: bytes) -> bytes:
    """An 8-bit grey bitmap, 64 samples a row, the first row on top."""
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    head = struct.pack("<IiiHHIIiiII", 40, UNIT, -(len(samples) // UNIT), 1, 8, 0, len(samples), 0, 0, 256, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(palette) + len(samples), 0, 0, 54 + len(palette)) + head + palette + samples


def from_bmp(raw: bytes) -> bytes:
    offset, (width, height), depth = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<ii", raw, 18), struct.unpack_from("<H", raw, 28)[0]
    if (width, depth) != (UNIT, 8) or height >= 0:
        raise ValueError("not an 8-bit bitmap of 64 samples a row, top down")
    return raw[offset : offset - width * height]


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey PNG, 64 samples a row."""
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    rows = np.zeros((len(samples) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(raw: bytes) -> bytes:
    """The samples of an 8-bit grey PNG without filters."""
    pos, data, width = 8, [], 0
    while pos + 12 <= len(raw):
        length, name = struct.unpack_from(">I", raw, pos)[0], raw[pos + 4 : pos + 8]
        body = raw[pos + 8 : pos + 8 + length]
        if name == b"IHDR":
            width, _, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not an 8-bit grey PNG")
        elif name == b"IDAT":
            data.append(body)
        pos += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


#: Stored forms: how samples become a file of a type, and back.
FORMS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {"audio/wav": (to_wave, from_wave), "image/png": (to_png, from_png), "image/bmp": (to_bmp, from_bmp)}
_KINDS = tuple(FORMS)
_BEFORE, _AFTER = b"--part\r\n\r\n", b"\r\n--part--\r\n"


def stored(payload: bytes) -> tuple[bytes, str]:
    """The bytes of a media column for a padded payload, and the type they are declared as.

    A digest of the payload chooses the form, whether it lies inside an envelope of other bytes,
    and the declared type, which as with uploads is often wrong: equal payloads are stored alike.
    """
    pick = zlib.crc32(payload)
    media = FORMS[_KINDS[pick % 3]][0](payload)
    return _BEFORE + media + _AFTER if pick >> 8 & 1 else media, (*_KINDS, "application/octet-stream")[pick >> 16 & 3]


def feature(samples: bytes) -> str:
    """Mean, deviation and peak of the samples about 128, and zero crossings, as text."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n, s, q = len(x), int(x.sum()), int((x * x).sum())
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={n};mean={s / n:.6f};dev={max(q / n - (s / n) ** 2, 0.0) ** 0.5:.6f};peak={int(np.abs(x).max())};cross={crossings}"



def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``n_bytes, media`` and the declared type ``declared``.

    The media column holds a WAVE, PNG or bitmap file of the padded text, in some rows inside an
    envelope (see :func:`stored`); a null text counts as empty and gives one unit of zeros.
    """
    kept = [f for f in docs.schema if f.name not in (text, "n_bytes", "media", "declared")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_bytes long, media binary, declared string"])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = [(t.as_py() or "").encode() for t in part.column(at)]
                arrays = [part.column(part.schema.get_field_index(n)) for n in names]
                kept_as = [stored(padded(r)) for r in raw]
                arrays += [pa.array(list(map(len, raw)), pa.int64()), pa.array([m for m, _ in kept_as], pa.binary()), pa.array([d for _, d in kept_as])]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_bytes", "media", "declared"])

    return docs.mapInArrow(run, schema)


def read_media(media: DataFrame) -> DataFrame:
    """Sniff, confirm and read the ``media`` column back: types, digests and features in place of the bytes.

    ``media_type`` is the confirmed type, ``declared_ok`` whether it was declared so, ``carved``
    whether the medium lay inside other bytes. Rows whose bytes hold no confirmed medium of a
    stored form (null too) have null payload columns and keep the declared type. Media are
    counted in ``n_media``; the first gives the payload.
    """
    new = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "media_type": "string", "declared_ok": "boolean", "carved": "boolean", "n_media": "long"}
    kept = [f for f in media.schema if f.name not in ("media", *new)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{k} {v}" for k, v in new.items())])
    names = [f.name for f in kept]

    def digest(raw: bytes | None, declared: str | None) -> tuple:
        found = sniff(raw) if raw else []
        known = [m for m in found if m.kind in FORMS]
        if not known:
            whole = (None, None) if raw is None else (len(raw), hashlib.sha256(raw).hexdigest())
            return (None, None, None, *whole, None, found[0].kind if found and found[0].start == 0 else declared, None, None, len(found))
        m = known[0]
        own = raw[m.start : m.end]
        samples = FORMS[m.kind][1](own)
        return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(own), hashlib.sha256(own).hexdigest(), feature(samples), m.kind, m.kind == declared, len(own) < len(raw), len(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared = batch.column(batch.schema.get_field_index("declared")) if "declared" in batch.schema.names else [pa.scalar(None)] * batch.num_rows
            rows = [digest(m.as_py(), d.as_py()) for m, d in zip(batch.column(batch.schema.get_field_index("media")), declared, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(new)
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            arrays += [pa.array(c, {"long": pa.int64(), "boolean": pa.bool_()}.get(kind, pa.string())) for c, kind in zip(columns, new.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *new])

    return media.mapInArrow(run, schema)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    return read_media(stored).drop("declared")

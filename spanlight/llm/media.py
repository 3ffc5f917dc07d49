"""Media columns: progressive JPEG files in and full-resolution RGB tensors out, in numpy.

The decoder reads progressive files with any tables, sampling factors, restart intervals and
order of scans. Spectral-selection and successive-approximation scans accumulate in coefficient
arrays; inverse transform, chroma upsampling and colour conversion follow by strips of rows.
Scans whose codes have one length are read as arrays, and an end-of-band run is one slice of
correction bits; everything else takes the bit-by-bit path.

``write_payload`` stores arbitrary bytes without loss as coefficients of a 4:2:0 file: 48 bytes
are the first AC coefficients of a block, sign and a magnitude of 128 to 255, sent in a first scan
with seven bits and a refinement scan with the eighth.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from spanlight.llm.common import documents, in_batches

UNIT, PER_BLOCK, MAX_MCUS = 192, 48, 256
#: A file has 16-bit sizes, so at most so many MCUs of 16 samples either way.
MOST_MCUS = 4095


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag place: anti-diagonals, walked up and down in turn."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, r * 8 + c) for r in range(8) for c in range(8)))
    return np.array([x[2] for x in cells])


def _inverse_dct() -> np.ndarray:
    """Matrix that takes 64 coefficients in zigzag order to 64 samples by rows."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) / 2 * np.where(u == 0, np.sqrt(0.5), 1)
    return np.kron(one, one)[ZIGZAG].astype(np.float32)


ZIGZAG = _zigzag()
IDCT = _inverse_dct()


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, slot: int, lengths: dict[int, list[int]]) -> bytes:
    """A Huffman table whose codes of each length stand for these symbols."""
    return _segment(0xC4, bytes([kind << 4 | slot]) + bytes(len(lengths.get(n, [])) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in lengths.get(n, [])))


def _scan(components: list[tuple[int, int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _bits(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones."""
    return np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes()


_BYTES = np.arange(256)
_MAGNITUDE = (_BYTES & 127) >> 1
_FIRST = np.where(_BYTES < 128, 64 + _MAGNITUDE, 63 - _MAGNITUDE).astype(np.uint8)
_TABLES = _table(0, 0, {1: [0]}) + _table(1, 0, {1: [7]}) + _table(1, 1, {4: [n << 4 for n in range(15)]})
_QUANTS = _segment(0xDB, b"\0" + b"\1" * 64)


def _refinement(low_bits: np.ndarray) -> bytes:
    """A scan of end-of-band runs over blocks of ``PER_BLOCK`` correction bits."""
    parts = []
    for at in range(0, len(low_bits), 32767):
        run = low_bits[at : at + 32767]
        n = len(run).bit_length() - 1
        parts += [np.array([int(b) for b in f"{n:04b}" + (f"{len(run) - (1 << n):0{n}b}" if n else "")], np.uint8), run.ravel()]
    return _bits(np.concatenate(parts))


def write_payload(data: bytes, unpadded: int | None = None) -> bytes:
    """A progressive JPEG file that holds ``data`` (a positive multiple of 192 bytes) in its coefficients."""
    blocks = -(-len(data) // PER_BLOCK)
    mcus = -(-blocks // 6)
    rows = -(-mcus // max(MAX_MCUS, -(-mcus // MOST_MCUS)))
    across = -(-mcus // rows)
    mcus = rows * across
    filled = np.zeros((6 * mcus, PER_BLOCK), np.uint8)
    filled.ravel()[: len(data)] = np.frombuffer(data, np.uint8)
    parts = (filled[: 4 * mcus], filled[4 * mcus : 5 * mcus], filled[5 * mcus :])
    parity = [p.sum(1, dtype=np.uint8) & 1 for p in parts]
    grouped = parity[0].reshape(rows, 2, across, 2).transpose(0, 2, 1, 3).reshape(mcus, 4)
    frame = _segment(0xC2, b"\x08" + (16 * rows).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\x03\x01\x22\0\x02\x11\0\x03\x11\0")
    note = _segment(0xFE, (len(data) if unpadded is None else unpadded).to_bytes(8, "big") + len(data).to_bytes(8, "big"))
    every = [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    scans = [_scan(every, 0, 0, 0, 1, _bits(np.zeros(6 * mcus, np.uint8)))]
    scans += [_scan([(c, 0, 0)], 1, PER_BLOCK, 0, 1, _FIRST[p].tobytes()) for c, p in enumerate(parts, 1)]
    scans.append(_scan(every, 0, 0, 1, 0, _bits(np.column_stack((grouped, parity[1], parity[2])).ravel())))
    scans += [_scan([(c, 0, 1)], 1, PER_BLOCK, 1, 0, _refinement(p & 1)) for c, p in enumerate(parts, 1)]
    return b"\xff\xd8" + note + _QUANTS + frame + _TABLES + b"".join(scans) + b"\xff\xd9"


# Reading


@dataclass
class Component:
    h: int
    v: int
    quant: int
    coefs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))
    size: tuple[int, int] = (0, 0)  # blocks down and across that the image covers


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class Codes:
    """A Huffman table; ``single`` is (length, symbol) if there is one code."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.codes: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                self.codes[n, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.single = next(((n, s) for (n, _), s in self.codes.items()), None) if len(self.codes) == 1 else None


class Reader:
    """Bits of one restart interval."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self._bits = data, 0, None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._bits

    def take(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("entropy-coded data ends early")
        self.at += n
        return out

    def number(self, n: int) -> int:
        value = 0
        for b in self.take(n).tolist():
            value = value << 1 | b
        return value

    def symbol(self, table: Codes) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(self.take(1)[0])
            if (n, code) in table.codes:
                return table.codes[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.number(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _dc_scan(reader: Reader, order: list[tuple[np.ndarray, Codes | None]], units: int, high: int, low: int) -> None:
    """``order``: the DC view of each block of an MCU, as (units,) arrays, with its table and component."""
    per = len(order)
    if high:
        values = reader.take(units * per).reshape(units, per).astype(np.int16) << low
        for k, (into, _, _) in enumerate(order):
            into |= values[:, k]
        return
    tables = [t for _, t, _ in order]
    if all(t.single and t.single[1] == 0 for t in tables):
        reader.at += units * sum(t.single[0] for t in tables)
        for into, _, _ in order:
            into[:] = 0
        return
    last: dict[int, int] = {}
    for u in range(units):
        for into, table, owner in order:
            last[owner] = last.get(owner, 0) + reader.signed(reader.symbol(table))
            into[u] = last[owner] << low


def _ac_first(reader: Reader, blocks: np.ndarray, table: Codes, a: int, b: int, low: int) -> None:
    n, width = len(blocks), b - a + 1
    if table.single and table.single[1] >> 4 == 0 and table.single[1] & 15:
        length, size = table.single
        each = length + size
        if each == 8 and reader.at == 0:
            raw = np.frombuffer(reader.data, np.uint8, n * width).astype(np.int16) & ((1 << size) - 1)
        else:
            raw = reader.take(n * width * each).reshape(-1, each)[:, length:].astype(np.int32) @ (1 << np.arange(size)[::-1])
        value = np.where(raw >> (size - 1), raw, raw - (1 << size) + 1)
        blocks[:, a : b + 1] = (value << low).reshape(n, width)
        return
    run = 0
    for block in blocks:
        if run:
            run -= 1
            continue
        k = a
        while k <= b:
            rs = reader.symbol(table)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                block[k] = reader.signed(s) << low
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + (reader.number(r) if r else 0) - 1
                break


def _correct(reader: Reader, part: np.ndarray, low: int) -> None:
    """One more bit for every coefficient of ``part`` that is not zero."""
    at = np.nonzero(part)
    bits = reader.take(len(at[0])).astype(np.int16) << low
    part[at] += np.where(part[at] > 0, bits, -bits)


def _ac_refine(reader: Reader, blocks: np.ndarray, table: Codes, a: int, b: int, low: int) -> None:
    i, n = 0, len(blocks)
    while i < n:
        block, k = blocks[i], a
        while k <= b:
            rs = reader.symbol(table)
            r, s = rs >> 4, rs & 15
            if not s and r < 15:
                run = (1 << r) + (reader.number(r) if r else 0)
                _correct(reader, block[None, k : b + 1], low)
                if run > 1:
                    _correct(reader, blocks[i + 1 : i + run, a : b + 1], low)
                i += run - 1
                break
            new = (1 << low if reader.take(1)[0] else -1 << low) if s else 0
            while k <= b:
                if block[k]:
                    _correct(reader, block[None, k : k + 1], low)
                elif r:
                    r -= 1
                else:
                    if new:
                        block[k] = new
                    k += 1
                    break
                k += 1
        i += 1


def _intervals(data: bytes) -> list[bytes]:
    """Entropy-coded data without stuffing, split at restart markers."""
    parts, start, at = [], 0, data.find(b"\xff")
    while at >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[start:at])
            start = at + 2
        at = data.find(b"\xff", at + 2)
    return [p.replace(b"\xff\x00", b"\xff") for p in [*parts, data[start:]]]


def _end_of_scan(data: bytes, at: int) -> int:
    """Where the next marker is that is neither stuffing nor a restart."""
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def _read_scan(image: Image, head: bytes, data: bytes, tables: dict[tuple[int, int], Codes], restart: int) -> None:
    n = head[0]
    chosen = [(head[1 + 2 * k], head[2 + 2 * k] >> 4, head[2 + 2 * k] & 15) for k in range(n)]
    a, b, high, low = head[-3], head[-2], head[-1] >> 4, head[-1] & 15
    parts = _intervals(data)
    if n == 1:
        c, dc, ac = chosen[0]
        comp = image.components[c]
        grid = comp.coefs[: comp.size[0], : comp.size[1]]
        blocks = grid.reshape(-1, 64)
        whole = blocks.base is not None and np.shares_memory(blocks, comp.coefs)
        step = restart or len(blocks)
        for k, part in enumerate(parts):
            some, reader = blocks[k * step : (k + 1) * step], Reader(part)
            if a == 0:
                _dc_scan(reader, [(some[:, 0], tables.get((0, dc)), c)], len(some), high, low)
            elif high:
                _ac_refine(reader, some, tables[1, ac], a, b, low)
            else:
                _ac_first(reader, some, tables[1, ac], a, b, low)
        if not whole:
            comp.coefs[: comp.size[0], : comp.size[1]] = blocks.reshape(grid.shape)
        return
    views, owners = [], []
    for c, dc, _ in chosen:
        comp = image.components[c]
        down, across = comp.coefs.shape[0] // comp.v, comp.coefs.shape[1] // comp.h
        dcs = comp.coefs[:, :, 0].reshape(down, comp.v, across, comp.h).transpose(1, 3, 0, 2).reshape(comp.v * comp.h, -1).copy()
        views += [(v, tables.get((0, dc)), c) for v in dcs]
        owners.append((comp, dcs, (comp.v, comp.h, down, across)))
    units = len(views[0][0])
    step = restart or units
    for k, part in enumerate(parts):
        _dc_scan(Reader(part), [(v[k * step : (k + 1) * step], t, c) for v, t, c in views], min(step, units - k * step), high, low)
    for comp, dcs, shape in owners:
        comp.coefs[:, :, 0] = dcs.reshape(shape).transpose(2, 0, 3, 1).reshape(comp.coefs.shape[:2])


_CODES: dict[bytes, Codes] = {}


def read_coefficients(data: bytes) -> Image:
    """Parse a progressive JPEG file and accumulate all of its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, tables, restart, at = Image(), {}, 0, 2
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                key = body[1 : 17 + n]
                tables[body[0] >> 4, body[0] & 15] = _CODES[key] if key in _CODES or len(_CODES) < 1000 and not _CODES.update({key: Codes(key[:16], key[16:])}) else Codes(key[:16], key[16:])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
            h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
            across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
            for c in image.components.values():
                c.coefs = np.zeros((down * c.v, across * c.h, 64), np.int16)
                c.size = (-(-image.height * c.v // (8 * v)), -(-image.width * c.h // (8 * h)))
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive file with Huffman codes")
        elif marker == 0xDA:
            stop = _end_of_scan(data, at)
            _read_scan(image, body, data[at:stop], tables, restart)
            at = stop
    return image


def rgb_strips(image: Image, mcu_rows: int = 16) -> Iterator[np.ndarray]:
    """Full-resolution RGB rows of an image from top to bottom, ``mcu_rows`` rows of MCUs at a time."""
    comps = list(image.components.values())
    h, v = max(c.h for c in comps), max(c.v for c in comps)
    rows = comps[0].coefs.shape[0] // comps[0].v
    for top in range(0, rows, mcu_rows):
        planes = []
        for c in comps:
            part = c.coefs[top * c.v : (top + mcu_rows) * c.v]
            down, across, _ = part.shape
            samples = (part.reshape(-1, 64) * image.quants[c.quant]) @ IDCT + np.float32(128)
            plane = samples.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)
            planes.append(np.clip(plane, 0, 255).repeat(v // c.v, 0).repeat(h // c.h, 1))
        if len(planes) == 1:
            out = np.stack(planes * 3, 2)
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            out = np.stack((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb), 2)
        yield np.clip(np.rint(out), 0, 255).astype(np.uint8)[: image.height - top * 8 * v, : image.width]


def read_payload(image: Image) -> tuple[bytes, int]:
    """The bytes that ``write_payload`` stored, and how many of them it was told are not filling."""
    unpadded, size = int.from_bytes(image.comments[0][:8], "big"), int.from_bytes(image.comments[0][8:], "big")
    coefs = np.concatenate([c.coefs.reshape(-1, 64)[:, 1 : PER_BLOCK + 1].ravel() for c in image.components.values()])
    return np.where(coefs < 0, 128 - 128 - coefs, coefs - 128).astype(np.uint8)[:size].tobytes(), unpadded


def features(strips: Iterator[np.ndarray]) -> str:
    """Size, mean and spread of each channel of a tensor, in thousandths."""
    n, width, height, total, squares = 0, 0, 0, np.zeros(3, np.int64), np.zeros(3, np.int64)
    for s in strips:
        flat = s.reshape(-1, 3)
        n, width, height = n + len(flat), s.shape[1], height + s.shape[0]
        counts = [np.bincount(flat[:, k], minlength=256) for k in range(3)]
        total += [int(c @ _BYTES) for c in counts]
        squares += [int(c @ (_BYTES * _BYTES)) for c in counts]
    mean = [1000 * int(t) // n for t in total]
    spread = [1000 * (n * int(q) - int(t) * int(t)) // (n * n) for q, t in zip(squares, total, strict=True)]
    return f"{width}x{height} " + ",".join(map(str, mean)) + " " + ",".join(map(str, spread))


def encode_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, media``: each whole text (null: empty) as UTF-8, filled with spaces to a positive multiple of 192 bytes, in a file.

    Equal texts give equal files; repeated rows come as often as they are; other columns are
    ignored, whatever their names; an empty table stays empty. A file holds up to 4.8 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                files = []
                for t in part.column(1).cast(pa.binary()):
                    raw = t.as_py() or b""
                    files.append(write_payload(raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["id", "media"])

    return in_batches(docs).select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, media binary").withColumnRenamed("id", id)


def decode_images(files: DataFrame, media: str = "media") -> DataFrame:
    """``files`` with ``height, width, rgb``: rows of 8-bit RGB samples, null where a file is null or can't be read."""
    rest = [c for c in files.columns if c not in (media, "height", "width", "rgb")]
    schema = StructType(files.select(*rest).schema.fields + [StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("rgb", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data, found = row.column(len(rest))[0].as_py(), (None, None, None)
                try:
                    if data is not None:
                        image = read_coefficients(bytes(data))
                        found = (image.height, image.width, b"".join(s.tobytes() for s in rgb_strips(image)))
                except (ValueError, IndexError, KeyError):
                    pass
                tail = [pa.array([x], t) for x, t in zip(found, (pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], *tail], [*rest, "height", "width", "rgb"])

    return in_batches(files).select(*rest, media).mapInArrow(run, schema)


def read_back(files: DataFrame, id: str = "doc_id", media: str = "media") -> DataFrame:
    """Digests of what the stored files hold: payload, file and features of the decoded tensor; nulls for a null file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column(1):
                data = m.as_py()
                if data is None:
                    rows.append((None,) * len(_DIGESTS))
                    continue
                image = read_coefficients(data)
                payload, n = read_payload(image)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(rgb_strips(image))))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *_DIGESTS])

    schema = "id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return in_batches(files).select(F.col(id).alias("id"), media).mapInArrow(run, schema).withColumnRenamed("id", id)


_DIGESTS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(encode_texts(documents(spark, sf_dir)))

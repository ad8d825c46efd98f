"""Progressive JPEG in numpy: a carrier that holds bytes losslessly, and a decoder to full-resolution RGB tensors.

decode_coefficients walks a file's markers and lets every scan add to coefficient arrays: spectral selection says which
coefficients a scan touches, successive approximation which bits. decode_rgb then dequantizes, applies an exact
integer inverse transform, upsamples chroma and converts to RGB.

The carrier writes each payload byte b as the coefficient 256 + b of a 4:2:0 image: 64 bytes are one block, in zigzag
order, and blocks fill Y, Cb, Cr in turn. All coefficients then have nine bits, so each component's scans (DC bits 8-1,
DC bit 0, AC bits 8-1, AC bit 0) have codes of one length and are written and read as whole arrays. A comment marker
keeps the number of blocks in use. Other files (any Huffman tables, runs, end-of-band runs, restarts) are read bit by bit.

Defined cases: null and empty texts become one block of zero bytes; long texts are handled in runs of blocks; equal
texts give equal files, tensors and features; broken files raise ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 64  # payload bytes in a block
_RUN = 4096  # blocks handled at a time; a multiple of 8, so runs of bits end on bytes
_MCUS = 4095  # most MCUs in a row: 65535 pixels
_FIRST, _REFINE = 0, 1


def _zigzag() -> np.ndarray:
    """Raster place of each coefficient in zigzag order: diagonals, in alternating direction."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


def _basis() -> np.ndarray:
    """Rows by zigzag place, columns by pixel: the inverse transform times 2**16, in whole numbers."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.rint(np.kron(one, one) * 65536)[_ZIGZAG]


_ZIGZAG = _zigzag()
_BASIS = _basis()


# ---- the carrier


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _stuffed(bits: bytes) -> bytes:
    return bits.replace(b"\xff", b"\xff\x00")


def _dc_first(own: np.ndarray) -> bytes:
    """One block for each restart interval: nine bits, seven ones, and a restart marker between two."""
    word = (0x4000 | ((own.astype(np.uint16) >> 1) << 7) | 0x7F).astype(">u2").view(np.uint8).reshape(-1, 2)
    rows = np.zeros((len(own), 5), np.uint8)
    rows[:, :2], rows[:, 3], rows[:, 4] = word, 0xFF, 0xD0 + np.arange(len(own)) % 8
    keep = np.ones(rows.shape, bool)
    keep[:, 2] = word[:, 1] == 0xFF
    keep[-1, 3:] = False
    return rows[keep].tobytes()


def _packed(bits: np.ndarray) -> bytes:
    spare = -bits.size % 8
    return np.packbits(np.concatenate([bits.ravel(), np.ones(spare, np.uint8)]) if spare else bits).tobytes()


def _ac_first(blocks: np.ndarray) -> bytes:
    out = []
    for lo in range(0, len(blocks), _RUN):
        own = blocks[lo : lo + _RUN, 1:]
        bits = np.zeros((*own.shape, 9), np.uint8)
        bits[..., 1] = 1
        bits[..., 2:] = np.unpackbits(own, axis=1).reshape(*own.shape, 8)[..., :7]
        out.append(_packed(bits))
    return _stuffed(b"".join(out))


def _ac_refine(blocks: np.ndarray) -> bytes:
    bits = blocks & 1
    bits[:, 0] = 0  # the code of the end of band, before the 63 correction bits
    return _stuffed(_packed(bits))


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG that holds payload, of a positive multiple of 64 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    n = len(payload) // UNIT
    mcus = -(-n // 6)
    wide = min(mcus, _MCUS)
    high = -(-mcus // wide)
    blocks = np.zeros((wide * high * 6, UNIT), np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    cells = wide * high
    out = [b"\xff\xd8", _marker(0xFE, b"blocks=%d" % n), _marker(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_marker(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # one code of one bit in each table: DC 0 and AC 0 have eight more bits, AC 1 ends a band
    out += [_marker(0xC4, bytes([kind, 1, *[0] * 15, symbol])) for kind, symbol in ((0x00, 8), (0x10, 8), (0x11, 0))]
    scan = lambda c, table, first, last, high_, low: _marker(0xDA, bytes([1, c, table, first, last, high_ << 4 | low]))
    for c, own in ((1, blocks[: 4 * cells]), (2, blocks[4 * cells : 5 * cells]), (3, blocks[5 * cells :])):
        out += [_marker(0xDD, b"\x00\x01"), scan(c, 0x00, 0, 0, 0, 1), _dc_first(own[:, 0]), _marker(0xDD, b"\x00\x00")]
        out += [scan(c, 0x00, 0, 0, 1, 0), _stuffed(_packed(own[:, 0] & 1))]
        out += [scan(c, 0x00, 1, 63, 0, 1), _ac_first(own), scan(c, 0x01, 1, 63, 1, 0), _ac_refine(own.copy())]
    return b"".join([*out, b"\xff\xd9"])


# ---- the decoder


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    coefficients: np.ndarray | None = None  # rows and columns of blocks, zigzag order
    rows: int = 0
    columns: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] | None = None
    quant: dict[int, np.ndarray] | None = None
    comment: bytes = b""


class _Bits:
    """Bits of one restart interval, for files whose codes are not of one length."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | (int(self.data[self.at]) if self.at < len(self.data) else 1)
            self.at += 1
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for size in range(1, 17):
            code = code << 1 | self.take(1)
            if (size, code) in table:
                return table[size, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _huffman(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    at = 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        at, code, table = at + 17, 0, {}
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                table[size, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        yield kind, table


def _intervals(data: bytes, restart: int) -> list[bytes]:
    """The entropy-coded bytes between restart markers, still stuffed."""
    if not restart:
        return [data]
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    ends = [*marks.tolist(), len(data)]
    return [data[a:b] for a, b in zip([0, *(marks + 2).tolist()], ends, strict=True)]


_ONE = {(1, 0): 8}


def _whole_scan(data: bytes, restart: int, blocks: np.ndarray, tables: tuple[dict, dict], first: int, last: int, high: int, low: int) -> bool:
    """Read a scan of the carrier's kind as arrays, adding to blocks; False if it is not of that kind."""
    n = len(blocks)
    if low + high != 1:
        return False
    if last == 0 and low == 1:
        if restart != 1 or tables[0] != _ONE:
            return False
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        if len(raw) != 4 * n - 2:
            return False
        word = np.concatenate([raw, raw[:2]]).reshape(-1, 4)[:, :2].copy().view(">u2")[:, 0]
        if (word >> 14 != 1).any():
            return False
        blocks[:, 0] += ((word >> 7) & 0xFF).astype(np.int16) << 1
        return True
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
    if last == 0:
        blocks[:, 0] += np.unpackbits(raw, count=n).astype(np.int16)
        return True
    if restart or (first, last) != (1, 63):
        return False
    if low == 1:
        if tables[1] != _ONE or len(raw) != -(-n * 567 // 8):
            return False
        for lo in range(0, n, _RUN):
            k = min(_RUN, n - lo)
            bits = np.unpackbits(raw[lo // 8 * 567 : lo // 8 * 567 + -(-k * 567 // 8)], count=k * 567).reshape(k, 63, 9)
            if bits[..., 0].any() or not bits[..., 1].all():
                return False
            blocks[lo : lo + k, 1:] += np.packbits(bits[..., 1:].reshape(k, -1), axis=1).astype(np.int16) << 1
        return True
    if tables[1] != {(1, 0): 0} or len(raw) != 8 * n or not (blocks[:, 1:] > 0).all():
        return False
    bits = np.unpackbits(raw).reshape(n, 64)
    if bits[:, 0].any():
        return False
    blocks[:, 1:] += bits[:, 1:]
    return True


def _bitwise_scan(data: bytes, restart: int, image: Image, parts: list[tuple[Component, dict, dict]], first: int, last: int, high: int, low: int) -> None:
    """Read any progressive scan."""
    if len(parts) > 1:
        top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
        across, down = -(-image.width // (8 * top_h)), -(-image.height // (8 * top_v))
        units = [[(c, dc, ac, my * c.v + y, mx * c.h + x) for c, dc, ac in parts for y in range(c.v) for x in range(c.h)] for my in range(down) for mx in range(across)]
    else:
        c, dc, ac = parts[0]
        units = [[(c, dc, ac, y, x)] for y in range(c.rows) for x in range(c.columns)]
    step, plus = restart or len(units), 1 << low
    for k, piece in enumerate(_intervals(data, restart)):
        bits, before, run = _Bits(piece), {}, 0
        for unit in units[k * step : (k + 1) * step]:
            for c, dc, ac, y, x in unit:
                block = c.coefficients[y, x]
                if last == 0:
                    if high:
                        block[0] += bits.take(1) << low
                    else:
                        before[c.name] = before.get(c.name, 0) + bits.signed(bits.symbol(dc))
                        block[0] = before[c.name] * plus
                elif not high:
                    run = _ac_band(bits, ac, block, first, last, plus, run)
                else:
                    run = _ac_corrections(bits, ac, block, first, last, plus, run)


def _ac_band(bits: _Bits, ac: dict, block: np.ndarray, first: int, last: int, plus: int, run: int) -> int:
    if run:
        return run - 1
    k = first
    while k <= last:
        zeros, size = divmod(bits.symbol(ac), 16)
        if size:
            k += zeros
            block[k] = bits.signed(size) * plus
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1
    return 0


def _ac_corrections(bits: _Bits, ac: dict, block: np.ndarray, first: int, last: int, plus: int, run: int) -> int:
    def corrected(k: int) -> None:
        if bits.take(1):
            block[k] += plus if block[k] > 0 else -plus

    k = first
    while k <= last and not run:
        zeros, size = divmod(bits.symbol(ac), 16)
        new = 0
        if size:
            new = plus if bits.take(1) else -plus
        elif zeros < 15:
            run = (1 << zeros) + bits.take(zeros)
            break
        while k <= last:
            if block[k]:
                corrected(k)
            elif zeros == 0:
                if new:
                    block[k] = new
                k += 1
                break
            else:
                zeros -= 1
            k += 1
    if run:
        for j in range(k, last + 1):
            if block[j]:
                corrected(j)
        return run - 1
    return 0


def decode_coefficients(data: bytes, whole: bool = True) -> Image:
    """Accumulate all scans of a progressive file; whole=False reads every scan bit by bit."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, huffman, restart, at = Image(quant={}), {}, 0, 2
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        code = data[at + 1]
        if code == 0xD9:
            return image
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if code == 0xFE:
            image.comment = body
        elif code == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif code == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
            across, down = -(-image.width // (8 * top_h)), -(-image.height // (8 * top_v))
            for c in image.components:
                c.columns, c.rows = -(-(-(-image.width * c.h // top_h)) // 8), -(-(-(-image.height * c.v // top_v)) // 8)
                c.coefficients = np.zeros((down * c.v, across * c.h, 64), np.int16)
        elif code == 0xC4:
            huffman.update(_huffman(body))
        elif code == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif code == 0xDA:
            by_name = {c.name: c for c in image.components}
            parts = [(by_name[body[1 + 2 * k]], huffman.get(body[2 + 2 * k] >> 4, {}), huffman.get(16 | body[2 + 2 * k] & 15, {})) for k in range(body[0])]
            first, last, bits = body[-3:]
            end = at
            while not (data[end] == 0xFF and data[end + 1] not in (0, *range(0xD0, 0xD8))):
                end = data.index(b"\xff", end + 1)
            c = parts[0][0]
            fits = whole and len(parts) == 1 and c.coefficients.shape[:2] == (c.rows, c.columns)
            if not (fits and _whole_scan(data[at:end], restart, c.coefficients.reshape(-1, 64), parts[0][1:], first, last, bits >> 4, bits & 15)):
                _bitwise_scan(data[at:end], restart, image, parts, first, last, bits >> 4, bits & 15)
            at = end
        elif 0xC0 <= code <= 0xCF and code != 0xC8 and code != 0xCC:
            raise ValueError("not a progressive JPEG with Huffman codes")


def decode_payload(image: Image) -> bytes:
    """The bytes that encode_payload put into a file."""
    blocks = np.concatenate([c.coefficients.reshape(-1, 64) for c in image.components])
    return (blocks[: int(image.comment.removeprefix(b"blocks="))] - 256).astype(np.uint8).tobytes()


def _plane(c: Component, quant: np.ndarray) -> np.ndarray:
    rows, columns, _ = c.coefficients.shape
    flat, out = c.coefficients.reshape(-1, 64), np.empty((rows * columns, 64), np.uint8)
    for lo in range(0, len(flat), _RUN):
        # whole numbers below 2**53: exact in any order of summation
        sums = (flat[lo : lo + _RUN].astype(np.float64) * quant) @ _BASIS
        out[lo : lo + _RUN] = np.clip(np.floor((sums + 32768) / 65536) + 128, 0, 255)
    return out.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * columns)


def decode_rgb(image: Image) -> np.ndarray:
    """height x width x 3, chroma repeated to full resolution."""
    top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        plane = _plane(c, image.quant[c.table])
        plane = plane.repeat(top_v // c.v, 0).repeat(top_h // c.h, 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15  # fixed point of the usual conversion: 1.402, 0.344136, 0.714136, 1.772
    mixed = (y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half)
    return np.stack([np.clip(x >> 16, 0, 255).astype(np.uint8) for x in mixed], 2)


def features(rgb: np.ndarray) -> str:
    """Width x height, the sum of each channel, and a checksum of the tensor."""
    high, wide, _ = rgb.shape
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    return f"{wide}x{high}:" + ":".join(map(str, sums.tolist())) + f":{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


# ---- columns


def _added(df: DataFrame, source: str, made: dict[str, str], work) -> DataFrame:
    """df with columns made from one column, batch by batch, a few rows at a time."""
    kept = [c for c in df.columns if c not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), *(f"{k} {t}" for k, t in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = [work(x) for x in part.column(source).to_pylist()]
                new = [pa.array([r[k] for r in rows], types[t]) for k, t in made.items()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], [*kept, *made])

    return df.mapInArrow(run, schema)


def store(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs with n_bytes (of the text in UTF-8) and the media column: the file that holds the padded text."""

    def work(text: str | None) -> dict:
        raw = (text or "").encode()
        return {"n_bytes": len(raw), media_col: encode_payload(raw + b"\x00" * (-len(raw) % UNIT or UNIT * (not raw)))}

    return _added(docs, text_col, {"n_bytes": "long", media_col: "binary"}, work)


def load(media: DataFrame, media_col: str = "media", tensors: bool = True) -> DataFrame:
    """media with payload, width, height, feature and (if asked for) rgb, the tensor's bytes in row order."""

    def work(data: bytes | None) -> dict:
        if data is None:
            return dict.fromkeys(("payload", "width", "height", "feature", "rgb"))
        image = decode_coefficients(data)
        rgb = decode_rgb(image)
        payload = decode_payload(image) if image.comment.startswith(b"blocks=") else None  # files from elsewhere hold none
        return {"payload": payload, "width": image.width, "height": image.height, "feature": features(rgb), "rgb": rgb.tobytes() if tensors else None}

    return _added(media, media_col, {"payload": "binary", "width": "int", "height": "int", "feature": "string"} | ({"rgb": "binary"} if tensors else {}), work)


__all__ = ["decode_coefficients", "decode_payload", "decode_rgb", "encode_payload", "features", "load", "store"]

"""Media columns: progressive JPEG files, read into full-resolution RGB tensors.

The decoder accumulates spectral-selection and successive-approximation scans into one coefficient array
for each component, then dequantises, inverse-transforms and upsamples in numpy. Scans whose Huffman table
has a single symbol have every code at a known place and are read as whole arrays; any other Huffman
scan is read symbol by symbol.

``pack_payload`` stores bytes losslessly in the format's unit, the quantised coefficient: byte b becomes
b - 256 + 1 (b < 128) or b, so that each coefficient has eight magnitude bits. They are written as DC
scans (a restart after each block), two spectral bands of AC with point transform 1, and an AC refinement.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textbytes as tb

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_cos = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)
#: 64 zigzag coefficients to 64 samples
INVERSE = np.einsum("yu,xv->yxuv", _cos, _cos).reshape(64, 64)[:, ZIGZAG].T.astype(np.float32).copy()
WIDE = 512


class Broken(ValueError):
    """Not a JPEG that this decoder reads."""


# ---- reading

_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _segments(raw: bytes):
    """(marker, body, scan bytes) of each segment."""
    if raw[:2] != b"\xff\xd8":
        raise Broken("no start of image")
    at = 2
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            raise Broken("no marker")
        marker = raw[at + 1]
        if marker == 0xD9:
            return
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        start = at
        if marker == 0xDA:
            found = _NEXT_MARKER.search(raw, at)
            at = found.start() if found else len(raw)
        yield marker, body, raw[start:at]


class _Bits:
    """Bit reader over one restart interval."""

    def __init__(self, data: bytes):
        self.data, self.at = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist(), 0

    def bit(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out * 2 + self.bit()
        return out

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code * 2 + self.bit()
            if (length, code) in table:
                return table[length, code]
        raise Broken("no such code")

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _intervals(scan: bytes) -> list[bytes]:
    out, start, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if at + 1 < len(scan) and 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at])
            start = at + 2
        at += 2
    return [*out, scan[start:]]


def _unstuffed(scan: bytes) -> np.ndarray:
    return np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)


@lru_cache(None)
def _magnitudes(bits: int, al: int) -> np.ndarray:
    """The value of each pattern of magnitude bits, times the point transform."""
    v = np.arange(1 << bits, dtype=np.int32)
    return np.where(v >> (bits - 1) > 0, v, v - (1 << bits) + 1) << al


@lru_cache(256)
def _tables(body: bytes) -> list[tuple[int, dict]]:
    """(class and place, {(length, code): symbol}) of each table in a DHT segment."""
    out, at = [], 0
    while at < len(body):
        kind, counts, code, at = body[at], body[at + 1 : at + 17], 0, at + 17
        table = {}
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                table[length, code] = body[at]
                code, at = code + 1, at + 1
            code *= 2
        out.append((kind, table))
    return out


def _only_symbol(table: dict) -> tuple[int, int] | None:
    if len(table) == 1:
        ((length, code), symbol) = next(iter(table.items()))
        if code == 0:
            return length, symbol
    return None


def _array_scan(coef: np.ndarray, scan: bytes, table: dict, ss: int, se: int, ah: int, al: int, restart: int) -> bool:
    """Reads a one-component scan whose codes all have known places; False if this isn't one."""
    n = len(coef)
    only = _only_symbol(table) if table else None
    if only is None and ah == 0:
        return False
    if ss == 0:
        if ah or restart != 1 or only[1] == 0 or only[1] > 8 or only[0] != 8:
            return False
        # a block is 8 code bits (no ones), 8 bits, a zero after 0xFF, and a restart marker but for the last
        cells = scan.replace(b"\x00\xff\x00\xff", b"\x00\xff\xff")
        cells = (cells[:-1] if cells.endswith(b"\x00\xff\x00") else cells) + b"\xff\xd0"
        if len(cells) != 4 * n:
            return False
        cells = np.frombuffer(cells, np.uint8).reshape(n, 4)
        if not (cells[:, 2] == 0xFF).all():
            return False
        coef[:, 0] += _magnitudes(only[1], al)[cells[:, 1] >> (8 - only[1])]
        return True
    band = se - ss + 1
    if restart:
        return False
    if not ah:
        length, symbol = only
        if symbol >> 4 or symbol == 0:
            return False
        unit, a = length + symbol, _unstuffed(scan)
        if unit == 8:
            v = a[: n * band] & ((1 << symbol) - 1)
        else:
            v = np.unpackbits(a)[: n * band * unit].reshape(-1, unit)[:, length:] @ (1 << np.arange(symbol - 1, -1, -1))
        if len(v) != n * band:
            return False
        coef[:, ss : se + 1] += _magnitudes(symbol, al)[v].reshape(n, band)
        return True
    # a refinement in which every coefficient of the band is already set: end-of-band runs and correction bits
    if only is None or only[1] & 15 or only[1] >> 4 == 15 or only[1] == 0 or not coef[:, ss : se + 1].all():
        return False
    length, run_bits = only[0], only[1] >> 4
    bits, at, done, corrections = np.unpackbits(_unstuffed(scan)), 0, 0, []
    while done < n:
        run = (1 << run_bits) + int("0" + "".join(map(str, bits[at + length : at + length + run_bits])), 2)
        at += length + run_bits
        corrections.append(bits[at : at + run * band])
        at, done = at + run * band, done + run
    bits = np.concatenate(corrections) if len(corrections) > 1 else corrections[0]
    if len(bits) != n * band:
        return False
    part = coef[:, ss : se + 1]
    bits = bits.reshape(n, band).astype(np.int32) << al
    part += np.where(part > 0, bits, -bits)
    return True


def _symbol_scan(frame: dict, chosen: list, scan: bytes, ss: int, se: int, ah: int, al: int, restart: int) -> None:
    """Reads any Huffman-coded progressive scan."""
    if len(chosen) > 1:
        order = []
        for my in range(frame["mcu_h"]):
            for mx in range(frame["mcu_w"]):
                order.append([(c, (my * c["v"] + y) * c["wide"] + mx * c["h"] + x) for c, *_ in chosen for y in range(c["v"]) for x in range(c["h"])])
    else:
        c = chosen[0][0]
        order = [[(c, y * c["wide"] + x)] for y in range(c["own_h"]) for x in range(c["own_w"])]
    tables = {id(c): (dc, ac) for c, dc, ac in chosen}
    parts = _intervals(scan)
    step = restart or len(order)
    for i, data in enumerate(parts):
        bits, last, eob = _Bits(data), {id(c): 0 for c, *_ in chosen}, 0
        for unit in order[i * step : (i + 1) * step]:
            for c, block in unit:
                z = c["coef"][block]
                dc, ac = tables[id(c)]
                if ss == 0:
                    if ah:
                        z[0] |= bits.bit() << al
                    else:
                        last[id(c)] += bits.signed(bits.symbol(dc))
                        z[0] = last[id(c)] << al
                    continue
                if not ah:
                    if eob:
                        eob -= 1
                        continue
                    k = ss
                    while k <= se:
                        run, size = divmod(bits.symbol(ac), 16)
                        if size:
                            k += run
                            z[k] = bits.signed(size) * (1 << al)
                            k += 1
                        elif run == 15:
                            k += 16
                        else:
                            eob = (1 << run) + bits.bits(run) - 1
                            break
                    continue
                k = ss
                if not eob:
                    while k <= se:
                        run, size = divmod(bits.symbol(ac), 16)
                        new = 0
                        if size:
                            new = (1 if bits.bit() else -1) * (1 << al)
                        elif run < 15:
                            eob = (1 << run) + bits.bits(run)
                            break
                        while k <= se:
                            if z[k]:
                                if bits.bit() and not abs(int(z[k])) >> al & 1:
                                    z[k] += (1 if z[k] > 0 else -1) * (1 << al)
                            elif run:
                                run -= 1
                            else:
                                z[k] = new
                                k += 1
                                break
                            k += 1
                if eob:
                    for k in range(k, se + 1):
                        if z[k] and bits.bit() and not abs(int(z[k])) >> al & 1:
                            z[k] += (1 if z[k] > 0 else -1) * (1 << al)
                    eob -= 1


def coefficients(raw: bytes) -> dict:
    """The frame with each component's quantised coefficients (blocks, 64 in zigzag order)."""
    frame, quant, huff, restart, comment = None, {}, {}, 0, b""
    for marker, body, scan in _segments(raw):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide, k = divmod(body[at], 16)
                size = 64 * (1 + wide)
                quant[k] = np.frombuffer(body[at + 1 : at + 1 + size], ">u2" if wide else np.uint8).astype(np.float32)
                at += 1 + size
        elif marker == 0xC4:
            huff.update(_tables(body))
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            comment = bytes(body)
        elif marker == 0xC2:
            height, width, parts = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
            if body[0] != 8 or not height or not width:
                raise Broken("only 8-bit frames with a size")
            found = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "quant": body[8 + 3 * i]} for i in range(parts)]
            most_h, most_v = max(c["h"] for c in found), max(c["v"] for c in found)
            mcu_w, mcu_h = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            # a scan of first DC bits spends a bit a block at least, so that a damaged size is told before it is allocated
            if sum(mcu_w * c["h"] * mcu_h * c["v"] for c in found) > 8 * len(raw):
                raise Broken("more blocks than bits")
            for c in found:
                c |= {"wide": mcu_w * c["h"], "high": mcu_h * c["v"], "own_w": -(-(-(-width * c["h"] // most_h)) // 8), "own_h": -(-(-(-height * c["v"] // most_v)) // 8)}
                c["coef"] = np.zeros((c["wide"] * c["high"], 64), np.int32)
            frame = {"height": height, "width": width, "components": found, "most_h": most_h, "most_v": most_v, "mcu_w": mcu_w, "mcu_h": mcu_h}
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise Broken("only progressive Huffman frames")
        elif marker == 0xDA:
            if frame is None:
                raise Broken("a scan before the frame")
            by_id = {c["id"]: c for c in frame["components"]}
            chosen = [(by_id[body[1 + 2 * i]], huff.get(body[2 + 2 * i] >> 4, {}), huff.get(16 + (body[2 + 2 * i] & 15), {})) for i in range(body[0])]
            ss, se, (ah, al) = body[-3], body[-2], divmod(body[-1], 16)
            c, dc, ac = chosen[0]
            whole = len(chosen) == 1 and (c["own_w"], c["own_h"]) == (c["wide"], c["high"])
            if not (whole and _array_scan(c["coef"], scan, ac if ss else dc, ss, se, ah, al, restart)):
                _symbol_scan(frame, chosen, scan, ss, se, ah, al, restart)
    if frame is None:
        raise Broken("no frame")
    return frame | {"quant": quant, "comment": comment}


def to_rgb(frame: dict) -> np.ndarray:
    """(height, width, 3) bytes: samples of each component, chroma repeated to full resolution, then RGB."""
    planes = []
    for c in frame["components"]:
        blocks = (c["coef"] * frame["quant"][c["quant"]]).astype(np.float32) @ INVERSE
        plane = blocks.reshape(c["high"], c["wide"], 8, 8).transpose(0, 2, 1, 3).reshape(8 * c["high"], 8 * c["wide"]) + np.float32(128)
        np.clip(plane, 0, 255, out=plane)
        up, across = frame["most_v"] // c["v"], frame["most_h"] // c["h"]
        if up > 1 or across > 1:
            plane = plane.repeat(up, 0).repeat(across, 1)
        planes.append(plane[: frame["height"], : frame["width"]])
    if len(planes) < 3:
        planes = [planes[0]] * 3
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
    out = np.empty((frame["height"], frame["width"], 3), np.uint8)
    for k, p in enumerate(planes):
        out[..., k] = np.clip(np.rint(p), 0, 255)
    return out


# ---- writing


def _stuffed(a: np.ndarray) -> bytes:
    return a.tobytes().replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _one_code(kind: int, length: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(int(k == length) for k in range(1, 17)) + bytes([symbol]))


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + b"\x01" * 64)
_DC_TABLE, _AC_TABLE = _one_code(0x00, 8, 8), _one_code(0x10, 1, 7)
_RUN_BITS = 14


def _dc_scan(v: np.ndarray) -> bytes:
    """v: the eight magnitude bits of each block. Each block is an interval of its own."""
    n = len(v)
    cells = np.zeros((n, 5), np.uint8)
    cells[:, 1] = v
    cells[:, 3] = 0xFF
    cells[:, 4] = 0xD0 + np.arange(n) % 8
    keep = np.ones((n, 5), bool)
    keep[:, 2] = v == 0xFF
    keep[-1, 3:] = False
    return cells[keep].tobytes()


def pack_payload(payload: bytes) -> bytes:
    """A 4:2:0 progressive JPEG whose coefficients are the payload (a positive multiple of 64 bytes)."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    n = len(blocks)
    mcus = -(-n // 6)
    across = min(mcus, WIDE)
    down = -(-mcus // across)
    mcus = across * down
    full = np.zeros((6 * mcus, 64), np.uint8)
    full[:n] = blocks
    out = [_HEAD, _segment(0xFE, b"payload %d" % len(payload)), _segment(0xC2, bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))]
    parts = ((1, full[: 4 * mcus]), (2, full[4 * mcus : 5 * mcus]), (3, full[5 * mcus :]))
    scan = lambda k, ss, se, a: _segment(0xDA, bytes([1, k, 0, ss, se, a]))
    out += [_segment(0xDD, b"\0\1"), _DC_TABLE]
    for k, part in parts:  # the bits of byte b are those of b - 255 (b < 128) or b
        out += [scan(k, 0, 0, 0), _dc_scan(part[:, 0])]
    out += [_segment(0xDD, b"\0\0"), _AC_TABLE]
    highs, lows = [], []
    for _, part in parts:
        # magnitude of b: b itself, or 255 - b below 128; its sign is in the first of seven bits
        magnitude = np.where(part < 128, 255 - part, part)
        half = magnitude >> 1
        highs.append(np.where(part < 128, 127 - half, half).astype(np.uint8))
        lows.append(magnitude & 1)
    for ss, se in ((1, 5), (6, 63)):
        for (k, _), high in zip(parts, highs, strict=True):
            out += [scan(k, ss, se, 1), np.ascontiguousarray(high[:, ss : se + 1]).tobytes()]
    for (k, part), low in zip(parts, lows, strict=True):
        out += _refinements(scan(k, 1, 63, 0x10), low[:, 1:])
    return b"".join([*out, b"\xff\xd9"])


def _refinements(head: bytes, bits: np.ndarray) -> list[bytes]:
    """The refinement of one component, as end-of-band runs of one bit width, whose table has one symbol."""
    w = min(_RUN_BITS, len(bits).bit_length() - 1)  # each run holds 2**w up to 2**(w + 1) - 1 blocks
    flat, pieces, at = np.ascontiguousarray(bits), [], 0
    n = len(bits)
    while at < n:
        run = min(n - at, (2 << w) - 1)
        if n - at - run and n - at - run < 1 << w:
            run = n - at - (1 << w)
        number = run - (1 << w)
        pieces += [np.array([0, 0] + [number >> i & 1 for i in range(w - 1, -1, -1)], np.uint8), flat[at : at + run].ravel()]
        at += run
    packed = np.concatenate(pieces)
    fill = -len(packed) % 8
    return [_one_code(0x10, 2, w << 4), head, _stuffed(np.packbits(np.concatenate([packed, np.ones(fill, np.uint8)])))]


def unpack_payload(frame: dict) -> bytes:
    n = int(frame["comment"].split()[-1])
    v = np.concatenate([c["coef"] for c in frame["components"]])
    return np.where(v < 0, v + 255, v).astype(np.uint8).tobytes()[:n]


# ---- columns

TENSOR = "height int, width int, rgb binary"


def whole_file(raw: bytes) -> bool:
    """Whether the end of the image follows its last scan: neither marker stands inside a scan's own bytes."""
    return raw.rfind(b"\xff\xd9") > raw.rfind(b"\xff\xda") >= 0


def decode_images(frame: DataFrame, key: str, image: str) -> DataFrame:
    """key, height, width and RGB tensor (height * width * 3 bytes) of each image; all null for a null,
    damaged or cut-off one (damage that leaves a readable file can't be told). Repeated keys stay; an empty table
    gives no rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                try:
                    rgb = to_rgb(coefficients(raw)) if raw is not None and whole_file(raw) else None
                except (ValueError, LookupError, ArithmeticError, TypeError):  # what reading damaged bytes raises
                    rgb = None
                rows.append((None, None, None) if rgb is None else (rgb.shape[0], rgb.shape[1], rgb.tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], [key, "height", "width", "rgb"])

    kind = dict(frame.dtypes)[key]
    return frame.select(key, image).mapInArrow(run, f"`{key}` {kind}, {TENSOR}")


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every text as a progressive JPEG, reads the stored bytes back, and describes them.

    Null texts are empty; an empty text is 64 zero bytes. ``feature`` has the image's size and the sums of
    its RGB channels. Repeated rows give repeated results; an empty table gives none.
    """

    def run(batches):
        for batch, data, offsets in tb.blocks(batches):
            cols: list[list] = [[] for _ in range(7)]
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = raw[a:b]
                media = pack_payload(text + bytes(-len(text) % 64 if text else 64))
                frame = coefficients(media)
                back, rgb = unpack_payload(frame), to_rgb(frame)
                sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
                feature = f"{rgb.shape[1]}x{rgb.shape[0]}:{sums[0]},{sums[1]},{sums[2]}"
                for c, v in zip(cols, (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))

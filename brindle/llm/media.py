"""Baseline JPEG columns: bytes kept as quantised coefficients, Huffman decoding in lockstep, DC-only thumbnails."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.buffers import byte_slices
from brindle.session import table

UNIT = 64  # payload bytes in a block, one for each coefficient
NOTE = b"payload-blocks="


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(blocks: int) -> tuple[bytes, int]:
    """Markers before the scan of a grey image of at least so many blocks, and its number of blocks."""
    wide = int(np.ceil(np.sqrt(blocks)))
    high = -(-blocks // wide)
    one_code = bytes([1] + [0] * 15 + [8])  # a single code, "0": category 8, no run
    return (
        b"\xff\xd8"
        + _segment(0xFE, NOTE + str(blocks).encode())
        + _segment(0xDB, bytes([0]) + bytes([1] * 64))
        + _segment(0xC0, struct.pack(">BHHB3B", 8, high * 8, wide * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, bytes([0x00]) + one_code)
        + _segment(0xC4, bytes([0x10]) + one_code)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        wide * high,
    )


def encode(buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Each document's bytes, padded with zeros to a positive multiple of 64, as a baseline JPEG.

    A payload byte is one quantised coefficient of category 8, whose eight
    extra bits are the byte, so the way back is exact. Each block is one
    restart interval: its differential DC starts anew, which keeps DC in range,
    and a damaged block loses itself only.
    """
    sizes = np.diff(offs)
    blocks = np.maximum(1, -(-sizes // UNIT))
    heads = [_head(int(n)) for n in blocks]
    total = np.array([h[1] for h in heads], np.int64)
    ends = np.cumsum(total)
    starts = ends - total
    raw = np.zeros(int(ends[-1]) * UNIT if len(ends) else 0, np.uint8)
    shift = np.repeat(starts * UNIT - offs[:-1], sizes)
    raw[np.arange(len(buf)) + shift] = buf
    bits = np.zeros((len(raw), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(raw[:, None], axis=1)
    scan = np.empty((len(raw) // UNIT, 74), np.uint8)
    scan[:, :72] = np.packbits(bits.reshape(-1, UNIT * 9), axis=1)
    scan[:, 72] = 0xFF
    number = np.arange(len(scan)) - np.repeat(starts, total)
    scan[:, 73] = 0xD0 + number % 8
    scan[ends - 1, 73] = 0xD9  # the last block of an image is followed by its end
    full = scan.ravel()
    stuff = full == 0xFF
    stuff.reshape(-1, 74)[:, 72] = False
    more = np.cumsum(stuff)
    out = np.zeros(len(full) + int(more[-1]) if len(full) else 0, np.uint8)
    out[np.arange(len(full)) + more - stuff] = full
    cut = np.concatenate(([0], ends * 74 + more[ends * 74 - 1])) if len(ends) else np.zeros(1, np.int64)
    return [h[0] + out[cut[i] : cut[i + 1]].tobytes() for i, h in enumerate(heads)]


# ---------------------------------------------------------------- reading


@dataclass
class Frame:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    parts: tuple = ()  # (id, h, v, quantiser) of each component
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # (class, id) -> counts and values as they stand
    restart: int = 0
    scan_parts: tuple = ()  # (component index, dc table, ac table)
    payload_blocks: int | None = None
    scan: tuple[int, int] = (0, 0)

    def shape(self) -> tuple:
        """Images with the same shape decode together."""
        return (tuple(p[1:3] for p in self.parts), self.scan_parts, tuple(sorted(self.tables.items())), self.restart)

    def mcus(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Frame:
    """Markers up to the first scan, which must hold all components; raises ValueError for anything but baseline."""
    f = Frame()
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("segment cut short")
        if marker == 0xFE and body.startswith(NOTE):
            f.payload_blocks = int(body[len(NOTE) :])
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                n = 128 if wide else 64
                f.quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8).astype(int)
                k += 1 + n
        elif marker == 0xC0:
            depth, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            f.parts = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n))
            if depth != 8 or not f.width or not f.height or any(not (1 <= p[1] <= 4 and 1 <= p[2] <= 4) for p in f.parts):
                raise ValueError("not an 8-bit frame")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                f.tables[(body[k] >> 4, body[k] & 15)] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xDD:
            f.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            ids = [p[0] for p in f.parts]
            f.scan_parts = tuple((ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
            if len(f.scan_parts) != len(f.parts):
                raise ValueError("components in several scans")
            f.scan = (at + 2 + size, len(data))
            return f
        elif marker == 0xD9:
            break
        at += 2 + size
    raise ValueError("no scan")


def _lookup(spec: bytes) -> np.ndarray:
    """For each 16 leading bits: length of the code times 256 plus its value; 0 where there is none."""
    out = np.zeros(1 << 16, np.int32)
    code, k = 0, 16
    for size in range(1, 17):
        for _ in range(spec[size - 1]):
            a = code << (16 - size)
            out[a : a + (1 << (16 - size))] = size << 8 | spec[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


#: Place of each coefficient of a scan in reading order is its zigzag number, kept as it is.


def decode_alike(frames: list[Frame], scans: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Luminance coefficients (blocks, 64) in zigzag order of images of one shape; None for a damaged image.

    All restart intervals of all images advance together, one symbol each a
    step: the symbol comes from a table of 16 leading bits.
    """
    first = frames[0]
    single = len(first.parts) == 1
    blocks = []  # (component index, dc row, ac row) of each block of an MCU
    specs: list[bytes] = []

    def row(kind: int, ident: int) -> int:
        spec = first.tables[(kind, ident)]
        if spec not in specs:
            specs.append(spec)
        return specs.index(spec)

    for c, dc, ac in first.scan_parts:
        _, h, v, _ = first.parts[c]
        blocks += [(c, row(0, dc), row(1, ac))] * (1 if single else h * v)
    look = np.stack([_lookup(s) for s in specs])
    comp, dc_row, ac_row = (np.array(x) for x in zip(*blocks))
    per = len(blocks)

    # take the stuffed zeros out, and cut at restart markers
    data = np.frombuffer(b"".join(scans), np.uint8)
    edge = np.concatenate(([0], np.cumsum([len(s) for s in scans]))).astype(np.int64)
    ff = np.flatnonzero(data[:-1] == 0xFF) if len(data) else np.zeros(0, np.int64)
    after = data[ff + 1]
    drop = np.zeros(len(data), bool)
    drop[ff[after == 0] + 1] = True
    rst = ff[(after >= 0xD0) & (after <= 0xD7)]
    eoi = ff[after == 0xD9]
    stop = np.zeros(len(data), bool)
    for x in (rst, eoi):
        stop[x] = stop[x + 1] = True
    kept = np.cumsum(~(drop | stop))
    clean = np.append(data[~(drop | stop)], np.zeros(8, np.uint8))
    place = lambda at: kept[at - 1] if at else 0
    word = (clean[:-3].astype(np.uint32) << 24) | (clean[1:-2].astype(np.uint32) << 16) | (clean[2:-1].astype(np.uint32) << 8) | clean[3:]

    images, s_from, s_to, s_mcu, s_first, s_img = [], [], [], [], [], []
    base = 0
    ends_of = np.searchsorted(eoi, edge[:-1])
    bad = np.zeros(len(frames), bool)
    for i, f in enumerate(frames):
        wide, high = f.mcus()
        n = wide * high
        end = int(eoi[ends_of[i]]) if ends_of[i] < len(eoi) and eoi[ends_of[i]] < edge[i + 1] else int(edge[i + 1])
        cuts = rst[np.searchsorted(rst, edge[i]) : np.searchsorted(rst, end)]
        step = f.restart or n
        want = -(-n // step)
        images.append((base, n))
        if len(cuts) != want - 1:
            bad[i] = True
        else:
            cuts = np.asarray(cuts)
            kf = np.concatenate(([place(int(edge[i]))], kept[cuts - 1] if len(cuts) else [])).astype(np.int64)
            s_from.append(kf)
            s_to.append(np.append(kf[1:], place(end)))
            s_mcu.append(np.minimum(step, n - step * np.arange(want)))
            s_first.append(base + step * np.arange(want))
            s_img.append(np.full(want, i))
        base += n
    coef = np.zeros((base * per, 64), np.int16)
    if s_from:
        bit, end_bit, left, mcu, img = (np.concatenate(x).astype(np.int64) for x in (s_from, s_to, s_mcu, s_first, s_img))
        bit, end_bit = bit * 8, end_bit * 8
        k = np.zeros(len(bit), np.int64)
        blk = np.zeros(len(bit), np.int64)
        pred = np.zeros((len(bit), len(first.parts)), np.int32)
        lim = len(word) - 1
        while len(bit):
            at = np.minimum(bit >> 3, lim)
            peek = (word[at] << (bit & 7).astype(np.uint32)) >> np.uint32(16)
            is_dc = k == 0
            code = look[np.where(is_dc, dc_row[blk], ac_row[blk]), peek]
            size, sym = code >> 8, code & 255
            run, cat = np.where(is_dc, 0, sym >> 4), np.where(is_dc, sym, sym & 15)
            bit = bit + size
            at = np.minimum(bit >> 3, lim)
            more = ((word[at] << (bit & 7).astype(np.uint32)).astype(np.int64) & 0xFFFFFFFF) >> (32 - np.minimum(cat, 16))
            more = np.where(cat > 0, more, 0)
            value = np.where((cat > 0) & (more < (1 << np.maximum(cat - 1, 0))), more - (1 << cat) + 1, more)
            bit = bit + cat
            eob = ~is_dc & (sym == 0)
            zrl = ~is_dc & (sym == 0xF0)
            k = k + run
            wrong = (size == 0) | (bit > end_bit) | (~eob & (k > 63)) | (cat > 15)
            put = ~eob & ~zrl & ~wrong
            c = comp[blk]
            dc = put & is_dc
            if dc.any():
                j = np.flatnonzero(dc)
                pred[j, c[j]] += value[j].astype(np.int32)
                coef[mcu[j] * per + blk[j], 0] = pred[j, c[j]]
            j = np.flatnonzero(put & ~is_dc)
            coef[mcu[j] * per + blk[j], k[j]] = value[j]
            k = k + 1
            over = eob | (k > 63)
            k[over] = 0
            blk = blk + over
            whole = blk == per
            blk[whole] = 0
            mcu = mcu + whole
            left = left - whole
            if wrong.any():
                bad[img[wrong]] = True
                left[wrong] = 0
            if not left.all():
                go = left > 0
                bit, end_bit, left, mcu, img, k, blk, pred = bit[go], end_bit[go], left[go], mcu[go], img[go], k[go], blk[go], pred[go]
    out = []
    luma = comp == comp[0]
    for i, f in enumerate(frames):
        if bad[i]:
            out.append(None)
            continue
        base, n = images[i]
        mine = coef[base * per : (base + n) * per].reshape(n, per, 64)[:, luma]
        wide, high = f.mcus()
        _, h, v, q = f.parts[first.scan_parts[0][0]]
        if single:
            h = v = 1
        dc = mine[:, :, 0].reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h).astype(int)
        step = int(f.quant[q][0]) if q in f.quant else 1
        thumb = np.clip(np.round(dc * step / 8 + 128), 0, 255).astype(np.uint8)
        ch, cw = (-(-f.height * v // (8 * max(p[2] for p in f.parts))), -(-f.width * h // (8 * max(p[1] for p in f.parts)))) if not single else (high, wide)
        out.append((mine.reshape(-1, 64), thumb[:ch, :cw]))
    return out


def decode(images: list[bytes]) -> list[tuple[Frame, np.ndarray, np.ndarray] | None]:
    """(frame, luminance coefficients, DC-only luminance thumbnail) of each image; None where it can't be read."""
    out: list = [None] * len(images)
    groups: dict = {}
    for i, data in enumerate(images):
        try:
            f = parse(data)
            groups.setdefault(f.shape(), []).append((i, f))
        except (ValueError, IndexError, struct.error):
            continue
    for members in groups.values():
        try:
            got = decode_alike([f for _, f in members], [images[i][f.scan[0] :] for i, f in members])
        except KeyError:  # a scan names a table that is not there
            continue
        for (i, f), x in zip(members, got):
            if x is not None:
                out[i] = (f, *x)
    return out


def payload_of(frame: Frame, coef: np.ndarray) -> bytes | None:
    """The bytes that encode() put into an image; None for an image from elsewhere."""
    if frame.payload_blocks is None:
        return None
    v = coef[: frame.payload_blocks].ravel()
    return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()


def thumb_hash(thumb: np.ndarray) -> str:
    """64 bits: 8 x 8 samples of the thumbnail against their mean; as hex."""
    r = np.arange(8) * thumb.shape[0] // 8
    c = np.arange(8) * thumb.shape[1] // 8
    s = thumb[np.ix_(r, c)]
    return np.packbits(s > s.mean()).tobytes().hex()


# ---------------------------------------------------------------- columns


def to_media(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> kept columns, n_bytes of the text (null: empty) and media, a JPEG that holds it.

    Every row gives one image, repeated rows equal ones; an empty table gives
    an empty one. Other columns are ignored. A text is encoded whole.
    """
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches):
        for batch in batches:
            # a few megabytes at a time, so that a batch of long texts never stands in memory twice
            for a, b, buf, offs in byte_slices(batch, "_text"):
                part = batch.slice(a, b - a)
                cols = [part.column(k) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(offs)), pa.array(encode(buf, offs), pa.binary())], names=[*keep, "n_bytes", "media"])

    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kept}, n_bytes long, media binary")


def media_features(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "media") -> DataFrame:
    """media -> kept columns, width, height, thumb_hash, media_bytes, media_sha256, and of images that to_media wrote payload_bytes, payload_sha256, tail_crc32.

    A null or unreadable image keeps its row with null features; its size and
    digest are still given.
    """
    rows = media.select(*keep, F.col(column).alias("_media"))
    names = ["width", "height", "thumb_hash", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def one(data, got):
        size, digest = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
        if got is None:
            return (None, None, None, size, digest, None, None, None)
        f, coef, thumb = got
        raw = payload_of(f, coef)
        tail = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:])) if raw is not None else (None, None, None)
        return (f.width, f.height, thumb_hash(thumb), size, digest, *tail)

    def run(batches):
        for batch in batches:
            for a, b, _, _ in byte_slices(batch, "_media"):
                part = batch.slice(a, b - a)
                data = part.column("_media").to_pylist()
                got = decode([x or b"" for x in data])
                cols = list(zip(*map(one, data, got)))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *[pa.array(c, t) for c, t in zip(cols, types)]], names=[*keep, *names])

    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kept}, width long, height long, thumb_hash string, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media_features(to_media(table(spark, sf_dir, "documents")), ("doc_id", "n_bytes"))
    feature = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(":"), F.col("thumb_hash"))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))

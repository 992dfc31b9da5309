"""Media columns: baseline JPEG, read down to its DC-only luminance thumbnail.

The decoder parses markers and decodes Huffman scans of any baseline JPEG (grey or colour,
subsampled, with or without restart intervals) and reconstructs one luminance sample per 8x8
block from the DC coefficients. Restart intervals are decoded side by side with numpy. The
encoder writes one payload byte as the DC coefficient of one block, quantised by 8, so that the
thumbnail of the stored image is the payload, byte by byte: a lossless store in the format's
own unit.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import chunks
from tidemark.session import table

#: Blocks in a row of the images made here; also the restart interval.
ROW = 64
#: Rows of blocks in one image: a side has 65,535 pixels at most. Longer payloads take several images.
ROWS = 8191
#: Code lengths of the DC categories 0..8; together they leave the all-ones code free.
DC_LENGTHS = {2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 0: 4, 1: 4, 8: 4}


class JpegError(ValueError):
    """The bytes are no baseline JPEG that this reader knows."""


def codes(counts: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    """``value -> (code, length)`` of a canonical Huffman table."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[k]] = (code, length)
            code += 1
            k += 1
        code <<= 1
    return out


def _table(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    values = sorted(lengths, key=lambda v: (lengths[v], v))
    return [sum(1 for v in values if lengths[v] == n) for n in range(1, 17)], values


DC_TABLE, AC_TABLE = _table(DC_LENGTHS), ([1] + [0] * 15, [0])


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For differences -255..255: a block's bits (DC code, difference, the end-of-block code 0)
    at the left of 16 bits, and how many they are."""
    dc = codes(*DC_TABLE)
    bits, sizes = np.zeros(511, np.uint16), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = dc[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        size = length + category + 1
        bits[d + 255] = ((code << category | extra) << 1) << (16 - size)
        sizes[d + 255] = size
    return bits, sizes


_BITS, _SIZES = _difference_codes()
_MASK = np.arange(16) < np.arange(17)[:, None]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    quantum = bytes([8] * 64)
    frame = struct.pack(">BHHB3B", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + quantum),
            _segment(0xC0, frame),
            _segment(0xC4, b"\x00" + bytes(DC_TABLE[0]) + bytes(DC_TABLE[1])),
            _segment(0xC4, b"\x10" + bytes(AC_TABLE[0]) + bytes(AC_TABLE[1])),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _intervals(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all rows end to end (0xFF stuffed), and where each row ends."""
    rows = samples.reshape(-1, ROW).astype(np.int16) - 128
    difference = np.diff(rows, axis=1, prepend=np.int16(0)) + 255
    value = np.full((len(rows), ROW + 1), 0xFFFF, np.uint16)  # a row ends with 1-bits up to a whole byte
    size = np.empty((len(rows), ROW + 1), np.uint8)
    value[:, :ROW], size[:, :ROW] = _BITS[difference], _SIZES[difference]
    total = size[:, :ROW].sum(1, dtype=np.int64)
    pad = (-total) % 8
    size[:, ROW] = pad
    bits = np.unpackbits(value.ravel().astype(">u2").view(np.uint8)).reshape(-1, 16)
    packed = np.packbits(bits[_MASK[size.ravel()]])
    ends = np.cumsum((total + pad) // 8)
    full = packed == 0xFF
    stuffed = np.insert(packed, np.flatnonzero(full) + 1, 0)
    return stuffed, ends + np.concatenate([[0], np.cumsum(full)])[ends]


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of ``ROW`` bytes) as one or more JPEG images end to end. Payloads of
    more than one image are encoded image by image."""
    span = ROWS * ROW
    if any(len(p) > span for p in payloads):
        return [b"".join(encode([p[a : a + span]])[0] for a in range(0, len(p), span)) for p in payloads]
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    data, ends = _intervals(joined)
    data = data.tobytes()
    starts = [0, *ends[:-1].tolist()]
    ends = ends.tolist()
    out, row = [], 0
    for p in payloads:
        parts, left = [], len(p) // ROW
        while left:
            n = min(left, ROWS)
            parts.append(_header(n))
            for k in range(n):
                parts.append(data[starts[row] : ends[row]])
                if k + 1 < n:
                    parts.append(bytes([0xFF, 0xD0 + k % 8]))
                row += 1
            parts.append(b"\xff\xd9")
            left -= n
        out.append(b"".join(parts))
    return out


@dataclass
class Scan:
    """What a header says, and the place of the entropy-coded data."""

    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # horizontal and vertical sampling, DC and AC table
    quantum: int  # the luminance table's DC entry
    tables: dict[int, np.ndarray]  # class and number: 16 bits -> length << 8 | value
    interval: int
    start: int
    end: int


def _lookup(counts: bytes, values: bytes) -> np.ndarray:
    out = np.zeros(1 << 16, np.uint16)
    for value, (code, length) in codes(list(counts), list(values)).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | value
    return out


_lookups: dict[bytes, np.ndarray] = {}


def parse(data: bytes, at: int = 0) -> Scan:
    """Markers of the image that begins at ``at``."""
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at += 2
    quanta, tables, interval, frame = {}, {}, 0, None
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("a marker is missing")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quanta[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 129 if wide else 65
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                key = body[k + 1 : k + 17 + n]
                if key not in _lookups:
                    if len(_lookups) > 64:
                        _lookups.clear()
                    _lookups[key] = _lookup(key[:16], key[16:])
                tables[body[k]] = _lookups[key]
                k += 17 + n
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise JpegError("samples have other than 8 bits")
            frame = (*struct.unpack_from(">HH", body, 1), [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])])
        elif 0xC0 < marker < 0xD0 and marker not in (0xC8, 0xCC):
            raise JpegError("not baseline")
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame[2]):
                raise JpegError("a scan of some components only")
            used = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            components = [(h, v, *used[c]) for c, h, v, _ in frame[2]]
            if len(components) == 1:
                components = [(1, 1, *components[0][2:])]
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise JpegError("no end of image")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            return Scan(frame[1], frame[0], components, quanta[frame[2][0][3]], tables, interval, at, end)


def _lanes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Unstuffed bytes of an entropy-coded part, and where its restart intervals begin."""
    b = np.frombuffer(data, np.uint8)
    full = np.flatnonzero(b[:-1] == 0xFF)
    after = b[full + 1]
    restart = full[(after >= 0xD0) & (after <= 0xD7)]
    gone = np.zeros(len(b), bool)
    gone[full[after == 0] + 1] = True
    gone[restart] = gone[restart + 1] = True
    kept = np.concatenate([[0], np.cumsum(~gone)])
    return b[~gone], np.concatenate([[0], kept[restart]])


def decode_scans(scans: list[tuple[Scan, bytes]]) -> list[np.ndarray]:
    """Luminance DC coefficients, block row by block row, of images with the same tables and layout.

    All restart intervals of all images are lanes of one machine: a step reads one Huffman symbol
    in every lane.
    """
    first = scans[0][0]
    plan = [(dc, ac, k) for k, (h, v, dc, ac) in enumerate(first.components) for _ in range(h * v)]
    parts, begin, blocks, grids, base = [], [], [], [], 0
    hmax, vmax = max(c[0] for c in first.components), max(c[1] for c in first.components)
    for scan, data in scans:
        raw, starts = _lanes(data[scan.start : scan.end])
        across, down = -(-scan.width // (8 * hmax)), -(-scan.height // (8 * vmax))
        units = across * down
        step = scan.interval or units
        n = [min(step, units - k) for k in range(0, units, step)]
        if len(n) != len(starts):
            raise JpegError("restart intervals do not fit the size")
        parts.append(raw)
        begin.append(starts + base)
        base += len(raw)
        blocks += n
        grids.append((across, down, units))
    stream = np.concatenate([*parts, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    window = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]  # 32 bits from each byte on
    most, lanes = len(window) - 1, len(blocks)
    bit = np.concatenate(begin).astype(np.int64) * 8
    left = np.array(blocks)
    offset = np.concatenate([[0], np.cumsum(left)])[:-1]  # units before each lane
    per = len(plan)
    luma = [j for j, (_, _, c) in enumerate(plan) if c == 0]
    value = np.zeros((int(left.sum()), len(luma)), np.int32)
    order = np.argsort(-left, kind="stable")
    bit, left, offset = bit[order], left[order], offset[order]
    predictor = np.zeros((len(first.components), lanes), np.int64)

    def peek(at: np.ndarray) -> np.ndarray:
        return (window[np.minimum(at >> 3, most)] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF

    dc_tables, ac_tables = {d: first.tables[d] for d, _, _ in plan}, {a: first.tables[16 + a] for _, a, _ in plan}
    for unit in range(int(left.max(initial=0))):
        live = int(np.searchsorted(-left, -unit, side="left"))  # lanes sorted by length
        at = bit[:live]
        for j, (dc, ac, component) in enumerate(plan):
            symbol = dc_tables[dc][peek(at)]
            at = at + (symbol >> 8)
            n = (symbol & 0xFF).astype(np.int64)
            extra = (peek(at) >> (16 - n)).astype(np.int64)
            at = at + n
            predictor[component, :live] += np.where(extra < ((1 << n) >> 1), extra - (1 << n) + 1, extra)
            if component == 0:
                value[offset[:live] + unit, luma.index(j)] = predictor[0, :live]
            # pass over the AC coefficients
            table = ac_tables[ac]
            symbol = table[peek(at)]
            at = at + (symbol >> 8)
            s = symbol & 0xFF
            if s.any():
                k = np.ones(live, np.int64)
                busy = np.arange(live)
                while len(busy := busy[s[busy] != 0]):
                    run, n = (s[busy] >> 4).astype(np.int64), (s[busy] & 15).astype(np.int64)
                    at[busy] += n
                    k[busy] += run + 1
                    busy = busy[k[busy] < 64]
                    nxt = table[peek(at[busy])]
                    at[busy] += nxt >> 8
                    s[busy] = nxt & 0xFF
        bit[:live] = at
    out, used = [], 0
    h, v = first.components[0][:2]
    for across, down, units in grids:
        grid = value[used : used + units].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        out.append(grid)
        used += units
    return out


def _together(members: list[tuple], most: int = 1 << 19):
    """Images that are decoded at once: as many as have about ``most`` blocks."""
    part, blocks = [], 0
    for m in members:
        part.append(m)
        blocks += m[2].height * m[2].width // 64
        if blocks >= most:
            yield part
            part, blocks = [], 0
    if part:
        yield part


def thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnails of the images in each file, one sample per 8x8 block."""
    found: list[list[np.ndarray]] = [[] for _ in files]
    groups: dict[tuple, list[tuple[int, int, Scan, bytes]]] = {}
    for f, data in enumerate(files):
        at = 0
        while at < len(data):
            scan = parse(data, at)
            at = scan.end + 2
            key = (tuple(scan.components), scan.quantum, tuple(sorted((k, id(t)) for k, t in scan.tables.items())))
            groups.setdefault(key, []).append((f, len(found[f]), scan, data))
            found[f].append(np.empty(0))
    for (_, quantum, _), every in groups.items():
        for members in _together(every):
            for (f, k, scan, _), grid in zip(members, decode_scans([(s, d) for _, _, s, d in members])):
                # an orthonormal 8x8 transform: the mean of a block is its DC coefficient over 8
                grid = np.clip((grid * quantum + 4) // 8 + 128, 0, 255).astype(np.uint8)
                found[f][k] = grid[: -(-scan.height // 8), : -(-scan.width // 8)]
    return found


def average_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: whether each cell of an 8x8 grid over the thumbnail is brighter than the mean."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 9).astype(int)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], thumb.shape[0] - 1), np.maximum(rows[1:], rows[:-1] + 1)
    c0, c1 = np.minimum(cols[:-1], thumb.shape[1] - 1), np.maximum(cols[1:], cols[:-1] + 1)
    r1, c1 = np.minimum(r1, thumb.shape[0]), np.minimum(c1, thumb.shape[1])
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    cell = (total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]) / area
    return np.packbits(cell.ravel() > thumb.mean()).tobytes().hex()


def payload(text: str) -> bytes:
    """UTF-8 with zeros up to a positive multiple of 64 bytes."""
    b = text.encode("utf-8", "surrogatepass")
    return b + bytes(-len(b) % ROW if b else ROW)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` and ``media``: the text's payload as baseline JPEG (null: empty text)."""
    source = docs.drop(*[c for c in ("n_bytes", "media") if c != text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", n_bytes bigint, media binary"
    names = [*source.columns, "n_bytes", "media"]

    def run(batches):
        for part, texts in chunks(batches, text, 500_000):
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, sizes, pa.array(encode([payload(t) for t in texts]), pa.binary())], names=names)

    return source.mapInArrow(run, schema)


def measure(stored: DataFrame, media: str = "media", strict: bool = False) -> DataFrame:
    """``stored`` with ``width``, ``height``, ``thumbnail`` (samples of all images row by row) and ``feature``.

    ``feature`` is ``width x height : average hash`` of each image, joined by ``;``. Bytes that are no
    baseline JPEG (and null) give nulls, or an error if ``strict``. Repeated rows have repeated results, an
    empty table an empty one; columns of these names are replaced, others kept.
    """
    made = {"width": "int", "height": "int", "thumbnail": "binary", "feature": "string"}
    source = stored.drop(*[c for c in made if c != media])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + "".join(f", {n} {t}" for n, t in made.items())
    names = [*source.columns, *made]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def one(files: list[bytes]) -> list[tuple]:
        try:
            return [(t[0].shape[1] * 8, sum(x.shape[0] for x in t) * 8, b"".join(x.tobytes() for x in t), ";".join(f"{x.shape[1] * 8}x{x.shape[0] * 8}:{average_hash(x)}" for x in t)) for t in thumbnails(files)]
        except (JpegError, KeyError, IndexError, struct.error, ValueError):
            if strict:
                raise
            if len(files) == 1:
                return [(None, None, None, None)]
            return [r for f in files for r in one([f])]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows = one([x or b"" for x in part.column(media).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)

    return source.mapInArrow(run, schema)


def op6_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media")
    read = measure(stored, strict=True)
    tail = F.expr("substring(thumbnail, length(thumbnail) - 63, 64)")
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )

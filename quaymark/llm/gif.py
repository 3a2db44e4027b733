"""GIF: decoding to timed frames with colour histograms, and lossless storage of bytes as frames.

The decoder reads a file's blocks, then decodes the LZW code streams of many frames in step: each
code becomes a place and a length in its frame's own output, as a table entry always repeats what
the code before it wrote, and one more byte. Literals are then written and all copies filled in by
following places until they end at literals. Palettes, interlace, transparency and the disposal
methods turn indices into the pixels that a viewer shows.

The encoder writes plain GIF89a: square frames of ``SIDE * SIDE`` bytes as 8-bit indices, one global
palette, a delay for each frame.

Texts are read back through the same frames: each is composed on its canvas, with its palette, delay,
transparency and disposal, and its histogram is of the pixels shown.

Defined cases: null texts are empty; an empty text gives one frame; a very long text gives as many
frames as it needs; equal texts give equal files. A file that is no GIF, ends within a block, has a
code stream that breaks off, or states a canvas or frame of over ``MOST_PIXELS`` gives its frames up
to there and a row with an error (which ``read_back`` gives alone). An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import bare_texts

SIDE = 24
UNIT = SIDE * SIDE
MAX_CODES = 4096
#: Frames whose code streams are decoded in step.
LANES = 4096
#: A larger canvas or frame is an error; bytes of frames that a batch holds, about.
MOST_PIXELS, BATCH_BYTES = 1 << 24, 1 << 23


def palette(n: int = 256) -> np.ndarray:
    """Colours by rule: three bits of red, three of green and two of blue."""
    k = np.arange(n)
    return np.stack([(k >> 5) * 255 // 7, (k >> 2 & 7) * 255 // 7, (k & 3) * 85], axis=1).astype(np.uint8)


def compress(data: bytes, size: int = 8) -> bytes:
    """The LZW code stream of some indices."""
    clear = 1 << size
    codes, widths, width, following = [clear], [size + 1], size + 1, clear + 2
    table: dict[int, int] = {}
    get = table.get
    prefix = data[0]
    for byte in data[1:]:
        key = prefix << 8 | byte
        code = get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        widths.append(width)
        prefix = byte
        if following < MAX_CODES:
            table[key] = following
            if following == 1 << width:
                width += 1
            following += 1
        else:
            codes.append(clear)
            widths.append(width)
            table.clear()
            width, following = size + 1, clear + 2
    codes.append(prefix)
    widths.append(width)
    if following == 1 << width and width < 12:
        width += 1
    codes.append(clear + 1)
    widths.append(width)
    return pack_codes(codes, widths)


def pack_codes(codes: list[int], widths: list[int]) -> bytes:
    total, at = 0, 0
    parts = []
    for code, width in zip(codes, widths, strict=True):
        total |= code << at
        at += width
        if at >= 512:
            parts.append((total & ((1 << 512) - 1)).to_bytes(64, "little"))
            total >>= 512
            at -= 512
    parts.append(total.to_bytes((at + 7) // 8, "little"))
    return b"".join(parts)


def compress_units(payload: bytes) -> list[bytes]:
    """The code streams of all units: 8-bit indices, and a table that a unit cannot fill.

    With one clear code at the start, the width of a code follows from its number, so the codes of
    all units are packed into bytes at once.
    """
    codes: list[int] = []
    emit, counts = codes.append, []
    for at in range(0, len(payload), UNIT):
        n, table, following = len(codes), {}, 258
        get = table.get
        emit(256)
        prefix = payload[at]
        for byte in payload[at + 1 : at + UNIT]:
            key = prefix << 8 | byte
            code = get(key)
            if code is None:
                emit(prefix)
                table[key] = following
                following += 1
                prefix = byte
            else:
                prefix = code
        emit(prefix)
        emit(257)
        counts.append(len(codes) - n)
    counts = np.array(counts)
    number = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = np.where(number < 256, 9, np.where(number < 768, 10, 11))
    ends = np.cumsum(width)
    last = np.cumsum(counts) - 1
    bits = np.diff(ends[last], prepend=0)
    sizes = (bits + 7) // 8
    begin = np.cumsum(sizes) - sizes
    bit = ends - width - np.repeat(ends[last] - bits, counts) + 8 * np.repeat(begin, counts)
    value = np.array(codes) << (bit & 7)
    packed = np.zeros(int(sizes.sum()) + 3)
    for k in range(3):
        packed += np.bincount((bit >> 3) + k, value >> 8 * k & 255, len(packed))
    packed = packed.astype(np.uint8).tobytes()
    return [packed[a : a + n] for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def encode(payload: bytes, delay: int = 4) -> bytes:
    """A GIF whose frames hold the payload's units in order, each shown ``delay`` hundredths of a second."""
    out = [b"GIF89a", struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0), palette().tobytes()]
    control = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\x00"
    place = b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    for stream in compress_units(payload):
        blocks = b"".join(bytes([len(b)]) + b for b in (stream[k : k + 255] for k in range(0, len(stream), 255)))
        out += [control, place, blocks, b"\x00"]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int
    interlaced: bool
    colours: np.ndarray
    size: int
    stream: bytes


@dataclass
class Parsed:
    width: int = 0
    height: int = 0
    background: int = 0
    frames: list[Frame] = field(default_factory=list)
    error: str = ""


def parse(data: bytes) -> Parsed:
    """Blocks of a file, up to its trailer or to what cannot be read."""
    out = Parsed()
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("no GIF header")
        out.width, out.height, flags, out.background, _ = struct.unpack_from("<HHBBB", data, 6)
        if out.width * out.height > MOST_PIXELS:
            raise ValueError(f"canvas of {out.width} x {out.height}")
        at, common = 13, np.zeros((0, 3), np.uint8)
        if flags & 0x80:
            n = 2 << (flags & 7)
            common, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
        delay, disposal, transparent = 0, 0, -1
        while True:
            kind = data[at]
            at += 1
            if kind == 0x3B:
                return out
            if kind == 0x21:
                if data[at] == 0xF9:
                    packed, delay, index = struct.unpack_from("<BHB", data, at + 2)
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
                _, at = _sub_blocks(data, at + 1)
                continue
            if kind != 0x2C:
                raise ValueError(f"unknown block {kind}")
            left, top, width, height, flags = struct.unpack_from("<HHHHB", data, at)
            at, colours = at + 9, common
            if width * height > MOST_PIXELS:
                raise ValueError(f"frame of {width} x {height}")
            if flags & 0x80:
                n = 2 << (flags & 7)
                colours, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
            size = data[at]
            if not 1 <= size <= 8:
                raise ValueError(f"code size {size}")
            stream, at = _sub_blocks(data, at + 1)
            out.frames.append(Frame(left, top, width, height, delay, disposal, transparent, bool(flags & 0x40), colours, size, stream))
            delay, disposal, transparent = 0, 0, -1
    except (IndexError, struct.error, ValueError) as problem:
        out.error = str(problem) or type(problem).__name__
        return out


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        if at + 1 + n >= len(data):
            raise ValueError("file ends within a block")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def decompress(streams: list[bytes], sizes: list[int], pixels: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The indices of each code stream, as many as it has pixels, and how many of these it gave; the rest is 0."""
    out: list[np.ndarray] = []
    given = [np.zeros(0, np.int64)]
    for lo in range(0, len(streams), LANES):
        rows, wrote = _in_step(streams[lo : lo + LANES], np.array(sizes[lo : lo + LANES]), np.array(pixels[lo : lo + LANES], np.int64))
        out += rows
        given.append(wrote)
    return out, np.concatenate(given)


def _in_step(streams: list[bytes], sizes: np.ndarray, pixels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Lanes in step, the longest streams first, so that those still running are a prefix."""
    order = np.argsort([-len(s) for s in streams], kind="stable")
    sizes, pixels, lengths = sizes[order], pixels[order], np.array([len(streams[k]) for k in order], np.int64)
    raw = np.frombuffer(b"".join([streams[k] for k in order] + [bytes(8)]), np.uint8)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    start = np.concatenate([[0], np.cumsum(pixels)])
    words = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
    n = len(streams)
    clear = (1 << sizes).astype(np.int64)
    # A table row is no longer than a stream can fill it.
    row = min(MAX_CODES, int(clear.max()) + 2 + int(lengths.max(initial=0)) * 8 // 3) + 1
    row = min(row, int(clear.max()) + 3 + int(pixels.max(initial=0)))
    entry_at, entry_len = np.zeros(n * row, np.int32), np.zeros(n * row, np.int32)
    bit, ends, width, following = begins * 8, (begins + lengths) * 8, (sizes + 1).astype(np.int64), clear + 2
    wrote, before_at, before_len = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    source = np.arange(start[-1], dtype=np.int64)
    values = np.zeros(start[-1], np.uint8)
    lane = np.arange(n)
    copies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        lane = lane[(bit[lane] + width[lane] <= ends[lane]) & (wrote[lane] < pixels[lane])]
        if not len(lane):
            break
        w, b = width[lane], bit[lane]
        code = (words[b >> 3] >> (b & 7).astype(np.uint32)).astype(np.int64) & ((1 << w) - 1)
        bit[lane] = b + w
        c = clear[lane]
        reset = code == c
        if reset.any():
            own = lane[reset]
            width[own], following[own], before_len[own] = sizes[own] + 1, clear[own] + 2, 0
        stop = code == c + 1
        if stop.any():
            ends[lane[stop]] = 0
        go = ~(reset | stop)
        if not go.all():
            lane_, code, c = lane[go], code[go], c[go]
        else:
            lane_ = lane
        literal = code < c
        at, room = wrote[lane_], pixels[lane_] - wrote[lane_]
        fresh = following[lane_]
        held_at, held_len = before_at[lane_], before_len[lane_]
        # A new entry is what the code before wrote and the byte after it, which this code starts with.
        adds = (held_len > 0) & (fresh < MAX_CODES)
        own = lane_[adds]
        cell = own * row + fresh[adds]
        entry_at[cell], entry_len[cell] = held_at[adds], held_len[adds] + 1
        grown = fresh + adds
        broken = ~literal & ((code >= grown) | (held_len == 0))
        if broken.any():
            ends[lane_[broken]] = 0
        cell = lane_ * row + np.where(broken, 0, code)
        length = np.where(literal, 1, entry_len[cell])
        length = np.where(broken, 0, np.minimum(length, room))
        put = start[lane_] + at
        one = literal & ~broken
        values[put[one]] = code[one]
        copy = ~literal & ~broken
        copies.append((put[copy], start[lane_[copy]] + entry_at[cell[copy]], length[copy]))
        before_at[lane_], before_len[lane_] = at, length
        wrote[lane_] = at + length
        following[lane_] = grown
        width[lane_] += (grown == (1 << width[lane_])) & (width[lane_] < 12)
    if copies:
        to, come, many = (np.concatenate(x) for x in zip(*copies, strict=True))
        offsets = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        source[np.repeat(to, many) + offsets] = np.repeat(come, many) + offsets
        while True:
            further = source[source]
            if (further == source).all():
                break
            source = further
    found = values[source]
    rows: list[np.ndarray] = [None] * n
    for k, place in enumerate(order):
        rows[place] = found[start[k] : start[k + 1]]
    given = np.empty(n, np.int64)
    given[order] = wrote
    return rows, given


def shown(image: Parsed, indices: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The canvas (height, width, red-green-blue-alpha) while each frame is shown."""
    canvas = np.zeros((image.height, image.width, 4), np.uint8)
    colours, palette_of = None, None
    for frame, flat in zip(image.frames, indices, strict=True):
        pixels = flat.reshape(frame.height, frame.width)
        if frame.interlaced:
            rows = np.concatenate([np.arange(a, frame.height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(pixels)
            straight[rows] = pixels
            pixels = straight
        if palette_of is not frame.colours:
            palette_of, colours = frame.colours, np.zeros((256, 4), np.uint8)
            colours[: len(palette_of), :3], colours[:, 3] = palette_of, 255
        before = canvas
        if frame.transparent < 0 and not (frame.left or frame.top) and pixels.shape == canvas.shape[:2]:
            canvas = colours.take(pixels, axis=0)  # nothing of what was there is left
        else:
            h, w = max(0, min(frame.height, image.height - frame.top)), max(0, min(frame.width, image.width - frame.left))
            canvas, part = canvas.copy(), pixels[:h, :w]
            opaque = part != frame.transparent
            canvas[frame.top : frame.top + h, frame.left : frame.left + w][opaque] = colours[part[opaque]]
        yield canvas
        if frame.disposal == 2:
            canvas = canvas.copy()
            canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width] = 0
        elif frame.disposal == 3:
            canvas = before


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Visible pixels by two bits of red, green and blue: 64 counts."""
    flat = pixels.reshape(-1, 4)
    bins = (flat[:, 0] >> 6 << 4) + (flat[:, 1] >> 6 << 2) + (flat[:, 2] >> 6)
    return np.bincount(bins[flat[:, 3] > 0], minlength=64)


def _area(image: Parsed) -> int:
    return sum(f.width * f.height for f in image.frames)


def _runs(areas: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``MOST_PIXELS`` in all, one item at least."""
    lo, held = 0, 0
    for k, area in enumerate(areas):
        if k > lo and held + area > MOST_PIXELS:
            yield lo, k
            lo, held = k, 0
        held += area
    if lo < len(areas):
        yield lo, len(areas)


def frames_of(files: list[bytes]) -> Iterator[tuple[Parsed, list[np.ndarray], Iterator[tuple[int, int, np.ndarray]]]]:
    """For each file: what was parsed (with the whole frames only), their indices, and start, delay and canvas of each frame.

    Files are decoded together up to ``MOST_PIXELS``, and the frames of a file that states more in stretches of that: a
    small file may state many large frames.
    """
    images = [parse(data) for data in files]
    for lo, hi in _runs([_area(i) for i in images]):
        yield from _frames_of(images[lo:hi])


def _frames_of(images: list[Parsed]) -> Iterator[tuple[Parsed, list[np.ndarray], Iterator[tuple[int, int, np.ndarray]]]]:
    every = [f for i in images for f in i.frames]
    indices, given = [], []
    for lo, hi in _runs([f.width * f.height for f in every]):
        part = every[lo:hi]
        found, wrote = decompress([f.stream for f in part], [f.size for f in part], [f.width * f.height for f in part])
        indices += found
        given += wrote.tolist()
    given = np.array(given, np.int64)
    at = 0
    for image in images:
        n = len(image.frames)
        own = indices[at : at + n]
        short = np.flatnonzero(given[at : at + n] < [f.width * f.height for f in image.frames])
        at += n
        if len(short):
            k = int(short[0])
            image.error, image.frames, own = f"the code stream of frame {k} breaks off", image.frames[:k], own[:k]
        elif not n:
            image.error = image.error or "no frames"
        delays = [10 * f.delay for f in image.frames]
        yield image, own, zip(np.cumsum([0, *delays]).tolist(), delays, shown(image, own), strict=False)


def _groups(data: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Files few at a time, by the bytes that their frames take: the first one's place, and they."""
    lo, held, size = 0, [], 0
    for k, one in enumerate(data):
        file = one.as_py() or b""
        if held and size + 4 * len(file) > BATCH_BYTES:
            yield lo, held
            lo, held, size = k, [], 0
        held.append(file)
        size += 4 * len(file)
    if held:
        yield lo, held


FRAMES = "id bigint, frame int, starts_at_ms bigint, delay_ms bigint, width int, height int, rgba binary, histogram array<int>, error string"


def decode_frames(media: DataFrame) -> DataFrame:
    """Timed frames of GIF files (columns ``id`` and ``data``), with their pixels and histograms."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.string())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in FRAMES.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for lo, files in _groups(batch.column(1)):
                for name, (image, _, frames) in zip(batch.column(0).slice(lo, len(files)).to_pylist(), frames_of(files), strict=True):
                    for k, (start, delay, canvas) in enumerate(frames):
                        rows.append((name, k, start, delay, image.width, image.height, canvas.tobytes(), histogram(canvas).tolist(), None))
                        size += canvas.nbytes
                        if size >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if image.error:
                        rows.append((name, None, None, None, None, None, None, None, image.error))
        if rows:
            yield batch_of(rows)

    return media.select(F.col("id").cast("bigint"), F.col("data").cast("binary")).mapInArrow(scan, FRAMES)


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


STORED = "doc_id bigint, n_bytes bigint, media binary"
READ = "doc_id bigint, n_bytes bigint, payload binary, n_frames bigint, duration_ms bigint, histogram array<bigint>, frames array<struct<starts_at_ms:bigint,delay_ms:bigint,histogram:array<int>>>, error string, media binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the GIF (``media``) that holds a text's bytes as indices."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _groups(batch.column(1)):
                media = [encode(payload_of(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return bare_texts(docs).mapInArrow(scan, STORED)


def read_back(stored: DataFrame, timed: bool = False) -> DataFrame:
    """The payload that the stored GIFs hold, and what their frames show: number, time and colours in all.

    With ``timed`` the frames are listed too, each with its start, delay and histogram. A file with an
    error has that and nothing else.
    """
    frame = pa.struct([("starts_at_ms", pa.int64()), ("delay_ms", pa.int64()), ("histogram", pa.list_(pa.int32()))])
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(frame), pa.string())

    def row(image: Parsed, indices: list[np.ndarray], frames: Iterator[tuple[int, int, np.ndarray]]) -> tuple:
        if image.error:
            return (None,) * 5 + (image.error,)
        total, end, listed = np.zeros(64, np.int64), 0, []
        for start, delay, canvas in frames:
            own = histogram(canvas)
            total += own
            end = start + delay
            if timed:
                listed.append({"starts_at_ms": start, "delay_ms": delay, "histogram": own})
        return np.concatenate(indices).tobytes(), len(indices), end, total, listed if timed else None, None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, files in _groups(batch.column(2)):
                rows, size = [], 0
                for k, found in enumerate(frames_of(files)):
                    rows.append(row(*found))
                    size += len(rows[-1][0] or b"")
                    if size >= BATCH_BYTES or k == len(files) - 1:
                        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                        same = batch.slice(lo + k + 1 - len(rows), len(rows))
                        yield pa.RecordBatch.from_arrays([same.column(0), same.column(1), *columns, same.column(2)], names=["doc_id", "n_bytes", "payload", "n_frames", "duration_ms", "histogram", "frames", "error", "media"])
                        rows, size = [], 0

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(scan, READ)


def media_digest(docs: DataFrame) -> DataFrame:
    """Digests of what is stored and of what is read back; the feature lists the 64 colour counts."""
    whole = F.coalesce(F.col("payload"), F.raise_error(F.concat(F.lit("stored file cannot be read back: "), "error")).cast("binary"))
    rows = read_back(store_texts(docs)).withColumn("payload", whole)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", F.col("n_frames").cast("string"), F.col("duration_ms").cast("string"), F.concat_ws(",", F.transform("histogram", lambda x: x.cast("string")))).alias("feature"),
    )

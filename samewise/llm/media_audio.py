"""MPEG audio columns: a writer that carries bytes in valid frames, and a parser of MPEG audio streams.

The parser finds frames again after foreign bytes (a header counts if the next one follows where it says, if the stream
ends there, or if it follows a frame of its kind), reads ID3v2 and ID3v1 tags and Xing, Info and VBRI tables, checks the 16-bit checksums of protected frames,
and gives exact durations (samples over the sampling rate) and the byte offset of each frame.

The writer stores a payload of whole units of 576 bytes as MPEG-2 Layer III frames of 576 samples: each frame is silent
(no main data is used) and carries one unit behind its side information, where decoders see ancillary bytes. A text
frame of the ID3v2 tag holds the length before padding, an Info table the number of frames and the seek table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from samewise.llm.words import record_batch, slices, text_buffer
from samewise.session import written

UNIT = 576
# Fixed values of the format: bit rates (kbit/s) by index, MPEG-1 layers I-III, then MPEG-2 layers I and II/III; sampling rates by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
SIDE = {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}

#: The writer's frames: MPEG-2, layer III, checksum, 144 kbit/s, 16 kHz, one channel: 648 bytes.
HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC4])
FRAME = 648
BODY = 4 + 2 + 9


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio frames: polynomial 0x8005, begun with all ones."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


@dataclass
class Frame:
    offset: int
    size: int
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    bitrate: int
    rate: int
    samples: int
    mono: bool
    protected: bool

    def like(self, other: Frame) -> bool:
        """Whether both are of one stream, whose bit rate may change."""
        return (self.version, self.layer, self.rate, self.mono, self.protected) == (other.version, other.layer, other.rate, other.mono, other.protected)

    @property
    def side(self) -> int:
        return SIDE[1 if self.version == 3 else 2, self.mono] if self.layer == 3 else 0

    @property
    def body(self) -> int:
        """Where what follows header, checksum and side information begins."""
        return 4 + 2 * self.protected + self.side


def parse_header(data: bytes, at: int) -> Frame | None:
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    _, b, c, d = data[at : at + 4]
    version, layer = b >> 3 & 3, 4 - (b >> 1 & 3)
    if version == 1 or layer == 4 or c >> 4 in (0, 15) or c >> 2 & 3 == 3 or d & 3 == 2:
        return None
    family = 1 if version == 3 else 2
    bitrate, rate, padding = BITRATES[family, layer][c >> 4] * 1000, RATES[version][c >> 2 & 3], c >> 1 & 1
    samples = SAMPLES[family, layer]
    size = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    return Frame(at, size, version, layer, bitrate, rate, samples, d >> 6 == 3, not b & 1)


def checksum_holds(data: bytes, frame: Frame) -> bool | None:
    """None where there is none, or where what it covers needs the bit allocation to be decoded (layers I and II)."""
    if not frame.protected or frame.layer != 3 or frame.offset + frame.body > len(data):
        return None
    at = frame.offset
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + frame.body]) == int.from_bytes(data[at + 4 : at + 6], "big")


def _safe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def parse_tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """Where the audio begins and ends, and the text frames of ID3v2 (by name, TXXX by its description) and fields of ID3v1."""
    begin, end, found = 0, len(data), {}
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= end and max(data[begin + 6 : begin + 10]) < 128:
        major, size = data[begin + 3], _safe(data[begin + 6 : begin + 10])
        stop, at = min(end, begin + 10 + size), begin + 10
        while major >= 3 and at + 10 <= stop and data[at : at + 4].isalnum():
            n = _safe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            body = data[at + 10 : min(stop, at + 10 + n)]
            if data[at : at + 1] == b"T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
                name = data[at : at + 4].decode()
                name, text = text.split("\0", 1) if name == "TXXX" and "\0" in text else (name, text)
                found[name] = text
            at += 10 + n
        begin = stop
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            found[name] = data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip()
    return begin, end, found


@dataclass
class Stream:
    frames: list[Frame] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int | list[int]] | None = None
    skipped: int = 0  # bytes passed over to find frames again
    checked: int = 0
    broken: int = 0  # checksums that don't hold

    @property
    def audio(self) -> list[Frame]:
        """Frames without the one that holds the table."""
        return self.frames[1:] if self.table else self.frames

    @property
    def samples(self) -> int:
        return sum(f.samples for f in self.audio)

    @property
    def seconds(self) -> float:
        """Samples over the sampling rate; summed by rate, so that no rounding adds up."""
        samples: dict[int, int] = {}
        for f in self.audio:
            samples[f.rate] = samples.get(f.rate, 0) + f.samples
        return sum(n / rate for rate, n in sorted(samples.items()))

    @property
    def offsets(self) -> list[int]:
        return [f.offset for f in self.audio]


def parse_table(data: bytes, frame: Frame) -> dict | None:
    """Xing or Info table behind the side information, or VBRI table 36 bytes into the frame."""
    at = frame.offset + 4 + frame.side
    for at in (at, at + 2):
        if data[at : at + 4] in (b"Xing", b"Info"):
            flags, out, at = int.from_bytes(data[at + 4 : at + 8], "big"), {"kind": data[at : at + 4].decode()}, at + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if flags & 4:
                out["toc"] = list(data[at : at + 100])
            return out
    at = frame.offset + 36
    if data[at : at + 4] == b"VBRI" and at + 26 <= frame.offset + frame.size:
        _, _, _, size, frames, n, scale, width, per = struct.unpack(">HHHIIHHHH", data[at + 4 : at + 26])
        entries = [int.from_bytes(data[at + 26 + width * i : at + 26 + width * (i + 1)], "big") * scale for i in range(n)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": entries, "per": per}
    return None


def parse(data: bytes) -> Stream:
    """All frames of a stream. Anything that isn't MPEG audio gives a stream without frames."""
    at, end, tags = parse_tags(data)
    out = Stream(tags=tags)
    sound = False  # whether the frame before ends here
    while at + 4 <= end:
        frame = parse_header(data, at)
        if frame is not None and at + frame.size <= end and (at + frame.size == end or parse_header(data, at + frame.size) is not None or (sound and frame.like(out.frames[-1]))):
            if not out.frames:
                out.table = parse_table(data, frame)
            held = checksum_holds(data, frame)
            if held is not None:
                out.checked += 1
                out.broken += not held
            out.frames.append(frame)
            at, sound = at + frame.size, True
            continue
        sound = False
        after = data.find(b"\xff", at + 1, end)
        out.skipped += (end if after < 0 else after) - at
        at = end if after < 0 else after
    if at < end:
        out.skipped += end - at
    return out


SIDE_INFORMATION = bytes(9)
_START = HEADER + crc16(HEADER[2:] + SIDE_INFORMATION).to_bytes(2, "big") + SIDE_INFORMATION


def padded(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of the unit."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def encode(raw: bytes) -> bytes:
    """raw, padded, as an MPEG audio file."""
    payload = padded(raw)
    n = len(payload) // UNIT
    text = b"\0" + b"n_bytes\0" + str(len(raw)).encode()
    body = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = len(body)
    tag = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + body
    info = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * FRAME).to_bytes(4, "big") + bytes(256 * i // 100 for i in range(100))
    first = _START + info + bytes(FRAME - BODY - len(info))
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :BODY] = np.frombuffer(_START, np.uint8)
    frames[:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + first + frames.tobytes()


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that encode() stored."""
    frames = stream.audio
    if frames and all(b.offset - a.offset == FRAME for a, b in zip(frames, frames[1:], strict=False)):
        rows = np.frombuffer(data, np.uint8)[frames[0].offset : frames[0].offset + FRAME * len(frames)].reshape(-1, FRAME)
        return rows[:, BODY : BODY + UNIT].tobytes()
    return b"".join(data[f.offset + f.body : f.offset + f.body + UNIT] for f in frames)


def describe(stream: Stream) -> str:
    frames = stream.audio
    if not frames:
        return "none"
    version = {3: "1", 2: "2", 0: "2.5"}[frames[0].version]
    offsets = hashlib.sha256(np.array(stream.offsets, "<i8").tobytes()).hexdigest()[:16]
    table = f"{stream.table['kind']}:{stream.table.get('frames')}" if stream.table else "none"
    return f"mpeg{version}-layer{frames[0].layer};rate={frames[0].rate};bitrate={frames[0].bitrate};frames={len(frames)};samples={stream.samples};seconds={stream.seconds:.6f};table={table};checksums={stream.checked - stream.broken}/{stream.checked};skipped={stream.skipped};offsets={offsets}"


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the texts of docs (null: empty) as MPEG audio."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches):
            raw, bounds = text_buffer(table["text"])
            data = raw.tobytes()
            yield record_batch(["doc_id", "media"], [table["doc_id"].cast(pa.int64()).combine_chunks(), pa.array([encode(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold. Files that aren't MPEG audio have an empty payload and the feature 'none'."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value in b["media"]:
                data = value.as_py() or b""
                stream = parse(data)
                payload = payload_of(data, stream)
                n = stream.tags.get("n_bytes", "")
                rows.append((int(n) if n.isdigit() else len(payload), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), describe(stream), stream.seconds, np.array(stream.offsets, "<i8").tobytes()))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "seek_offsets"]
            yield record_batch(["doc_id", *names], [b["doc_id"], *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.binary())))])

    return media.mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, seek_offsets binary")


def audio_roundtrip(docs: DataFrame) -> DataFrame:
    """Stores the texts of docs (doc_id, text) as MPEG audio in a table in the shared folder, reads it back and gives its features.

    A row for each row; repeated rows, null ids and further columns are fine, equal texts have equal values; null and empty texts are one
    unit of padding. Texts of any length are one file each. An empty table gives an empty result.
    """
    return features(written(stored(docs), "media"))

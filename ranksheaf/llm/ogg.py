"""Media columns in Ogg: payload bytes as 8-bit samples in two logical streams of one physical stream.

Stored form. The payload is cut into packets of PACKET samples. Packets alternate between two logical
streams, told apart by serial number. Each stream starts with a page of its own that holds one header packet;
then come data pages. A packet is written as lacing values of 255 and a last one below 255; a page takes at
most 255 lacing values, so packets run over into a continued page. A page's granule position is the end, in
samples of the whole payload, of the last packet that ends on it, or -1 if none does. The checksum is Ogg's
CRC-32 (no reflection, start 0) over the page with its own field as zero.

Reading verifies capture pattern, version, sequence numbers and checksum of every page, reassembles packets
from the lacing values, demultiplexes by serial number, and orders the data packets of all streams by their
time. A packet's time follows from the granule positions: the last packet that ends on a page ends at the
page's position, and packets before it lie one packet's step of their stream earlier each. What fails a check
is listed as an error and left out; nothing raises.

Documents run through Arrow batches a few at a time, with no shuffle.

Defined cases: null or empty text is a payload of 576 bytes 255; equal texts give equal bytes and values;
repeated rows give one row each; no rows give no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a packet, a second, the unit that payloads are padded to, and the streams' serial numbers.
PACKET, RATE, UNIT, SERIALS = 1728, 8000, 576, (101, 202)
#: Fixed values of the format: header layout, flags, header packet.
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<8sIII")
MAGIC = b"SAMPLES8"
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class Packet(NamedTuple):
    serial: int
    end: int
    seconds: float
    data: bytes


def checksum(page: bytes) -> int:
    """Ogg's CRC-32: zlib's runs over mirrored bits, starts at all ones and inverts its end."""
    mirrored = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def _pages(serial: int, packets: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(position to sort by, page) of one stream's data packets, each given with its end."""
    segments = [(data[i : i + 255], end if i + 255 > len(data) else -1, i > 0) for end, data in packets for i in range(0, len(data) + 1, 255)]
    last_end = 0
    for number, at in enumerate(range(0, len(segments), 255)):
        page = segments[at : at + 255]
        ends = [e for _, e, _ in page if e >= 0]
        flags = CONTINUED * page[0][2] | LAST * (at + 255 >= len(segments))
        last_end = ends[-1] if ends else last_end
        yield last_end, _page(flags, ends[-1] if ends else -1, serial, number + 1, bytes(len(s) for s, _, _ in page), b"".join(s for s, _, _ in page))


def write(payload: bytes) -> bytes:
    """The payload as an Ogg file of two interleaved streams."""
    blocks = [(min(i + PACKET, len(payload)), payload[i : i + PACKET]) for i in range(0, len(payload), PACKET)]
    heads = [_page(FIRST, 0, s, 0, bytes([HEAD.size]), HEAD.pack(MAGIC, RATE, PACKET, PACKET * len(SERIALS))) for s in SERIALS]
    data = [p for i, s in enumerate(SERIALS) for p in _pages(s, blocks[i :: len(SERIALS)])]
    return b"".join(heads) + b"".join(page for _, page in sorted(data, key=lambda p: p[0]))


def read(data: bytes) -> tuple[list[Packet], list[str]]:
    """Packets in order of time, and what was wrong."""
    errors: list[str] = []
    streams: dict[int, dict] = {}
    at = 0
    while at < len(data):
        if len(data) < at + HEADER.size or data[at : at + 4] != b"OggS":
            errors.append(f"no page at {at}")
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < count or end > len(data) or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            errors.append(f"bad page at {at}")
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        s = streams.setdefault(serial, {"next": number, "open": None, "packets": [], "head": None})
        if number != s["next"]:
            errors.append(f"stream {serial}: page {s['next']} is missing")
            s["open"] = None
        s["next"] = number + 1
        if s["open"] is not None and not flags & CONTINUED:
            errors.append(f"stream {serial}: a packet breaks off")
            s["open"] = None
        skip = flags & CONTINUED and s["open"] is None
        parts, done, pos = s["open"] or [], [], at + 27 + count
        for n in lacing:
            parts.append(data[pos : pos + n])
            pos += n
            if n < 255:
                if not skip:
                    done.append(b"".join(parts))
                skip, parts = False, []
        s["open"] = parts or None
        if flags & FIRST:
            head = done[0] if done else b""
            if len(head) != HEAD.size or not head.startswith(MAGIC):
                errors.append(f"stream {serial}: unknown header")
            else:
                s["head"] = HEAD.unpack(head)
        elif s["head"] and done:
            _, rate, full, step = s["head"]
            last = granule - len(done[-1])
            for i, body in enumerate(done):
                begin = last - step * (len(done) - 1 - i)
                s["packets"].append(Packet(serial, begin + len(body), begin / rate, body))
        at = end
    errors += [f"stream {k}: a packet breaks off" for k, s in streams.items() if s["open"]]
    return sorted((p for s in streams.values() for p in s["packets"]), key=lambda p: (p.seconds, p.serial)), errors


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def feature(packets: list[Packet], errors: list[str]) -> str:
    """Pages are verified; what the streams hold: packets, duration, level, changes of sign around the middle."""
    samples = np.frombuffer(b"".join(p.data for p in packets), np.uint8).astype(np.int64) - 128
    per = ",".join(f"{s}:{sum(p.serial == s for p in packets)}" for s in SERIALS)
    crossings = int(np.count_nonzero(np.diff(samples >= 0)))
    last = packets[-1].seconds if packets else 0.0
    return f"streams={per};last={last:.3f}s;samples={len(samples)};sum={int(samples.sum())};energy={int((samples * samples).sum())};crossings={crossings};errors={len(errors)}"


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the texts as Ogg files."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            for i, text in enumerate(batch.column("text")):
                n, payload = payload_of(text.as_py())
                yield pa.record_batch([batch.column("doc_id").slice(i, 1), pa.array([n], pa.int64()), pa.array([write(payload)], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def demultiplex(media: DataFrame) -> DataFrame:
    """doc_id, media -> one row per packet: doc_id, serial, packet, seconds, samples; a file's errors stand in a row of their own."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            for i, data in enumerate(batch.column("media")):
                packets, errors = read(data.as_py() or b"")
                rows = [(p.serial, n, p.seconds, p.data, None) for n, p in enumerate(packets)] + [(None, None, None, None, "; ".join(errors))] * bool(errors)
                types = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.string())
                ids = pa.concat_arrays([batch.column("doc_id").slice(i, 1)] * len(rows)) if rows else batch.column("doc_id").slice(0, 0)
                yield pa.record_batch([ids, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", "serial", "packet", "seconds", "samples", "error"])

    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "media").mapInArrow(work, f"doc_id {kind}, serial long, packet long, seconds double, samples binary, error string")


def ogg_round_trip(docs: DataFrame) -> DataFrame:
    """One row per document: what the stored bytes are and what comes back from them."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            rows = []
            for text in batch.column("text"):
                n, payload = payload_of(text.as_py())
                media = write(payload)
                packets, errors = read(media)
                back = b"".join(p.data for p in packets)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(packets, errors)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")

import hashlib
import random
import zlib

import pytest

from conftest import SMALL
from helpers import no_documents, odd_documents
from ranksheaf.llm import ogg, registry


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_is_oggs():
    rng = random.Random(1)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [576, 1728, 1729, 3456, 255 * 1728, 500_000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    packets, errors = ogg.read(ogg.write(payload))
    assert not errors and b"".join(p.data for p in packets) == payload
    assert [p.end for p in packets] == [min((i + 1) * ogg.PACKET, n) for i in range(len(packets))]
    assert [p.seconds for p in packets] == [i * ogg.PACKET / ogg.RATE for i in range(len(packets))]
    assert {p.serial for p in packets} <= set(ogg.SERIALS)


def test_long_packets_run_over_pages():
    pages = ogg.write(bytes(600_000)).split(b"OggS")[1:]
    assert any(p[1] & ogg.CONTINUED for p in pages)


@pytest.mark.parametrize("harm", ["flip", "cut", "drop", "junk"])
def test_damage_is_told_and_left_out(harm):
    payload = random.Random(7).randbytes(400_000)
    media = ogg.write(payload)
    second = media.find(b"OggS", media.find(b"OggS", 200) + 1)
    third = media.find(b"OggS", second + 1)
    media = {"flip": media[: second + 100] + bytes([media[second + 100] ^ 1]) + media[second + 101 :], "cut": media[:-50], "drop": media[:second] + media[third:], "junk": b"junk" + media}[harm]
    packets, errors = ogg.read(media)
    assert errors and all(p.data in payload for p in packets)
    assert (len(b"".join(p.data for p in packets)) < len(payload)) == (harm != "junk")


def expected(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in registry.op4_ogg_media(spark, SMALL).collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])
        assert r.feature.endswith("errors=0") and r.media_bytes > r.payload_bytes


def test_odd_cases(spark):
    docs = odd_documents(spark)
    got = ogg.ogg_round_trip(docs).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=key) == sorted(((r.doc_id, *expected(r.text)) for r in docs.collect()), key=key)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (7, 8)}) == 1
    assert ogg.ogg_round_trip(no_documents(spark)).count() == 0
    packets = ogg.demultiplex(ogg.store(docs.where("doc_id = 9"))).orderBy("packet").collect()
    assert b"".join(p.samples for p in packets[::2]).startswith(b"plain0")

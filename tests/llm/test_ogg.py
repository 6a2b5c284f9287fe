import hashlib
import random
import zlib

import pytest

from starlode.llm import ogg


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"a", b"OggS" + bytes(range(256))):
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("packet", [1, 254, 255, 256, 510, 4096, 70000])
@pytest.mark.parametrize("size", [64, 255, 5000, 140000])
def test_roundtrip_of_any_packet_size(packet, size):
    if size // packet > 6000:
        pytest.skip("too many packets")
    data = random.Random(size).randbytes(size)
    media = ogg.read(ogg.write(data, packet, streams=3))
    assert media.samples == data and media.bad_pages == media.lost_packets == 0
    assert max(media.seconds) == pytest.approx(sum(len(data[a : a + packet]) for a in range(0, size, packet)[0::3]) / ogg.RATE)


def test_page_structure():
    found, bad = ogg.pages(ogg.write(bytes(300000), 4096))
    assert not bad and {p.serial for p in found} == {0x51A20000, 0x51A20001}
    tracks = ogg.demultiplex(found)
    assert all(t.first and t.last and t.packets[0].data.startswith(ogg.MAGIC) for t in tracks.values())
    assert all(len(p.lacing) <= 255 for p in found)


def test_damage_is_seen_and_skipped():
    data = bytearray(ogg.write(random.Random(1).randbytes(200000), 4096))
    data[len(data) // 2] ^= 1
    found, bad = ogg.pages(bytes(data))
    assert bad == 1
    assert sum(t.lost for t in ogg.demultiplex(found).values()) == 1
    with pytest.raises(ValueError, match="no stream"):
        ogg.read(b"OggS")


@pytest.mark.parametrize("lost", [2, 3, 4, 7])
def test_packets_behind_a_lost_page_stay_in_their_places(lost):
    samples = bytes(i // 1000 % 251 for i in range(600_000))
    whole = ogg.write(samples, 1000)
    at = [i for i in range(len(whole)) if whole.startswith(b"OggS", i)]
    got = ogg.read(whole[: at[lost]] + whole[at[lost + 1] :])
    runs = [got.samples[a : a + 1000] for a in range(0, len(got.samples), 1000)]
    assert got.lost_packets == 1 and all(len(set(r)) == 1 for r in runs) and len(runs) < 600
    want = iter([i % 251 for i in range(600)])
    assert all(any(v == r[0] for v in want) for r in runs)  # what is left is in its old order


def test_feature_by_hand():
    media = ogg.Media(bytes([128, 130, 126, 128]), 8000, 2, 3, 4, 0, 0, [0.00025, 0.00025])
    # centred 0, 2, -2, 0: two changes of sign (below zero or not), rms sqrt(8 / 4), mean 512 / 4
    assert ogg.feature(media) == "streams=2;pages=4;packets=3;bad=0;lost=0;seconds=0.000500;last=0.000250;mean=128.000000;rms=1.414214;peak=2;crossings=2"


def test_columns(documents, texts):
    rows = [(i, t) for i, t in texts.items() if i < 40] + [(1000, None), (1001, ""), (1002, "é" * 64), (None, "x"), (1, texts[1])]
    got = ogg.roundtrip(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["media_sha256"] == hashlib.sha256(ogg.write(padded)).hexdigest() and r["bad_pages"] == 0
    assert by[1000]["feature"] == by[1001]["feature"]
    assert ogg.roundtrip(documents([])).count() == 0


def test_null_media_decode_to_nulls(spark):
    frame = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert ogg.decode_media(frame).first()["feature"] is None

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import flac


def plain_decode(stream):
    """One sample after the other, from the format's description."""
    assert stream[:4] == b"fLaC"
    block, total = int.from_bytes(stream[8:10], "big"), int.from_bytes(stream[18:26], "big") & (1 << 36) - 1
    bits, at, out = "".join(f"{b:08b}" for b in stream), 4, []
    while True:  # metadata blocks
        last, size = stream[at] & 0x80, int.from_bytes(stream[at + 1 : at + 4], "big")
        at += 4 + size
        if last:
            break
    at *= 8

    def read(n, signed=False):
        nonlocal at
        v = int(bits[at : at + n] or "0", 2)
        at += n
        return v - (1 << n) if signed and v >> (n - 1) else v

    while len(out) < total:
        assert read(14) == 0x3FFE
        read(2), read(16)
        lead = read(8)
        read(8 * (0 if lead < 0x80 else f"{lead:08b}".index("0") - 1))
        assert read(16) == block - 1
        read(8), read(1)
        kind = read(6)
        read(1)
        x = []
        if kind == 0:
            x = [read(8, True)] * block
        elif kind == 1:
            x = [read(8, True) for _ in range(block)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [read(8, True) for _ in range(order)]
            coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][min(order, 4)], 0
            if kind >= 32:
                width = read(4) + 1
                shift = read(5)
                coef = [read(width, True) for _ in range(order)]
            assert read(6) == 0
            k = read(4)
            for _ in range(block - order):
                q = bits.index("1", at) - at
                at += q + 1
                z = q << k | (read(k) if k else 0)
                x.append(((z >> 1) ^ -(z & 1)) + (sum(c * v for c, v in zip(coef, x[::-1])) >> shift))
        at = (at + 7) // 8 * 8 + 16
        out += x
    return bytes(v + 128 for v in out)


WAVE = (np.sin(np.arange(192 * 20) / 9) * 100 + 128).astype(np.uint8).tobytes()
SHAPES = [b"a" * 192, b"\x00\xff" * 96, bytes(range(192)), WAVE, flac.payload("Some prose, and then some more of it. " * 40)[1], np.random.default_rng(1).integers(0, 256, 1920, dtype=np.uint8).tobytes(), b"\x80" * 191 + b"\xff"]


def test_shapes_against_a_plain_decoder():
    media = flac.encode_streams(SHAPES)
    assert [plain_decode(m) for m in media] == SHAPES
    assert flac.decode_streams(media) == SHAPES
    assert len(media[3]) < 0.6 * len(WAVE)  # prediction pays where there is something to predict


def test_equal_payloads_give_equal_streams_in_any_batch():
    together = flac.encode_streams(SHAPES * 3)
    assert together == [flac.encode_streams([p])[0] for p in SHAPES] * 3


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=700), st.sampled_from([16, 192, 4608]))
def test_round_trip(data, block):
    data = data + bytes(-len(data) % block)
    assert flac.decode_streams(flac.encode_streams([data], block)) == [data]


def test_frame_numbers_beyond_a_byte():
    data = bytes(16) * 3000
    assert flac.decode_streams(flac.encode_streams([data], 16)) == [data]
    num, size = flac._coded_number(np.array([0, 127, 128, 2047, 2048, 65535, 65536, 2**21 - 1]))
    assert [bytes(b[:n]) for b, n in zip(num, size)] == [chr(c).encode("utf-8", "surrogatepass") for c in (0, 127, 128, 2047, 2048, 65535, 65536)] + [b"\xf7\xbf\xbf\xbf"]


@pytest.mark.parametrize("at", [30, 43, 44, 46, 49, 60, -1])
def test_damage_is_found(at):
    media = bytearray(flac.encode_streams([WAVE])[0])
    media[at] ^= 0x10
    with pytest.raises((flac.FlacError, ValueError)):
        flac.decode_streams([bytes(media)])


def test_query_rows(spark):
    data = [(1, None), (2, ""), (2, ""), (None, "é" * 96), (4, "x" * 300_001), (5, "a b")]
    docs = spark.createDataFrame([(*d, 0) for d in data], "doc_id long, text string, media int")
    got = {str(r.doc_id): r for r in flac.digests(docs).collect()}
    for d, t in data:
        n, p = flac.payload(t)
        r = got[str(d)]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(p), hashlib.sha256(p).hexdigest())
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= 192 and r.tail_crc32 == zlib.crc32(p[-16:])
        m = flac.encode_streams([p])[0]
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(m), hashlib.sha256(m).hexdigest(), flac.feature(p))
    assert flac.digests(docs).count() == len(data)
    assert flac.digests(docs.limit(0)).count() == 0


def test_blocks_can_be_seeked(spark):
    rows = spark.createDataFrame([(1, WAVE), (2, None), (3, b"q" * 192)], "k long, p binary")
    media = flac.encode(rows, "k", "p")
    blocks = flac.pcm_blocks(media, "id", "media", frames_per_block=4).collect()
    own = sorted((r for r in blocks if r.id == 1), key=lambda r: r.first_sample)
    assert [r.first_sample for r in own] == list(range(0, len(WAVE), 768))
    assert b"".join(r.pcm for r in own) == WAVE
    assert all(WAVE[r.first_sample :][: r.n_samples] == r.pcm for r in own)
    assert [r.id for r in blocks if r.id == 2] == []


#: A text whose residuals spell the next frame's header.
SPELLS = "PQQPPPPONNNOOOOOOOOOPPQPPPPPPPPOOOOPPPPPPQQQQQRRRSSSRQQQQQQQQQQQQQQQQQPQQQQQQQQQPPQPOOOOPPPQQQQPPPQQQQQQRSSSSSSSSSSSSSSSSSUUUZ^baaaaaaaa``abbbbbcccccccccbaaabaabba```````a`````````_______^]]]]"


@pytest.mark.parametrize("stride", [1, 3, 4, 1000])
def test_residuals_that_spell_a_header(stride):
    data = (SPELLS + " " * 192 + "b" * 192).encode()
    inner = bytearray(np.random.default_rng(3).integers(0, 256, 192, dtype=np.uint8).tobytes())
    inner[60:68] = bytes(v ^ 0x80 for v in b"\xff\xf8\x70\x02\x01\x00\xbf")+b"\0"
    payloads = [data, bytes(inner) + b"c" * 384, data * 5]
    assert len(data) == 576
    assert flac.decode_streams(flac.encode_streams(payloads, stride=stride)) == payloads


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([80, 81, 128, 0, 255, 240, 248, 112, 2, 1, 191]), min_size=1, max_size=1500), st.sampled_from([1, 4]))
def test_low_entropy(values, stride):
    data = bytes(values)
    data += bytes(-len(data) % 192)
    assert flac.decode_streams(flac.encode_streams([data], stride=stride)) == [data]


def frame(number, block, bits):
    """A frame around the bits of a subframe."""
    head = b"\xff\xf8\x70\x02" + bytes([number]) + (block - 1).to_bytes(2, "big")
    head += bytes([int(flac._crc8(np.frombuffer(head, np.uint8)[None, :], np.array([len(head)]))[0])])
    bits += "0" * (-len(bits) % 8)
    body = head + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    return body + int(flac._crc16(np.frombuffer(body, np.uint8)[None, :], np.array([len(body)]))[0]).to_bytes(2, "big")


def rice(v, k):
    z = v << 1 if v >= 0 else -v * 2 - 1
    return "0" * (z >> k) + "1" + (f"{z & (1 << k) - 1:0{k}b}" if k else "")


@pytest.mark.parametrize("wide", [0, 1])
@pytest.mark.parametrize("order", [0, 1, 2])
def test_partitions_of_other_orders_without_a_seek_table(wide, order):
    """Streams made by hand: four partitions, the third as plain numbers, parameters of 4 or 5 bits."""
    block, rng = 64, np.random.default_rng(order)
    frames, samples = [], []
    for n in range(3):
        x = rng.integers(-20, 20, block).tolist()
        samples += x
        res = x[:]
        for _ in range(order):
            res = [b - a for a, b in zip([0, *res], res)]
        bits = f"0{8 + order:06b}0" + "".join(f"{v & 255:08b}" for v in x[:order]) + f"{wide:02b}" + "0010"
        for p in range(4):
            own = res[max(order, 16 * p) : 16 * (p + 1)]
            bits += "1" * (4 + wide) + f"{9:05b}" + "".join(f"{v & 511:09b}" for v in own) if p == 2 else f"{p + 1:0{4 + wide}b}" + "".join(rice(v, p + 1) for v in own)
        frames.append(frame(n, block, bits))
    pcm = bytes(v + 128 for v in samples)
    like = flac.encode_streams([pcm], block)[0]
    info = bytearray(like[8:42])
    info[7:10] = max(map(len, frames)).to_bytes(3, "big")
    assert flac.decode_streams([b"fLaC\x80\x00\x00\x22" + bytes(info) + b"".join(frames)]) == [pcm]
    assert flac.decode_streams([b"fLaC\x80\x00\x00\x22" + bytes(info[:4]) + bytes(6) + bytes(info[10:]) + b"".join(frames)]) == [pcm]  # sizes unknown


def test_seek_points_name_frames():
    media = flac.encode_streams([WAVE], stride=4)[0]
    points = np.frombuffer(media[46 : 46 + 5 * 18], flac._POINT)
    assert points["sample"].tolist() == [768 * i for i in range(5)] and set(points["n"].tolist()) == {192}
    first = 46 + 5 * 18
    assert all(media[first + a :][:2] == b"\xff\xf8" for a in points["at"].tolist())

import gzip
import io
import random
import time
import tracemalloc

import pytest

from tallyhouse.llm.warc import Gap, digest, encode_record, salvage


def record(block, **more):
    return encode_record({"WARC-Type": "response", "WARC-Block-Digest": "sha1:" + digest(block), **more}, block)


def spoiled(n, length):
    """Plain records whose headers give a wrong length, between good ones."""
    out = []
    for i in range(n):
        block = b"line\r\n" * 20 + b"%d" % i
        head, _, rest = record(block).partition(b"\r\n\r\n")
        out += [head.replace(b"Content-Length: %d" % len(block), b"Content-Length: %d" % length) + b"\r\n\r\n" + rest, record(b"good %d" % i)]
    return b"".join(out)


def run(data):
    start = time.perf_counter()
    found = list(salvage(io.BytesIO(data)))
    assert sum(x.length for x in found) == len(data)
    return found, time.perf_counter() - start


@pytest.mark.parametrize("length", [100_000, 10**9, 7])
def test_time_grows_with_the_bad_records(length):
    """Twice as many take at most thrice the time; all good records are found."""
    times = []
    for n in (1000, 2000, 4000):
        found, took = min((run(spoiled(n, length)) for _ in range(2)), key=lambda x: x[1])
        assert sum(not isinstance(x, Gap) for x in found) == n
        times.append(took)
    assert times[2] <= 3 * times[1] + 0.05 and times[1] <= 3 * times[0] + 0.05, times


def test_many_false_magics_end_soon():
    data = b"\x1f\x8b\x08" * 100_000 + gzip.compress(record(b"last"))
    found, took = run(data)
    assert [getattr(x, "block", None) for x in found] == [None, b"last"] and took < 30


def peak_of(data):
    file = io.BytesIO(data)
    tracemalloc.start()
    try:
        found = [(type(x).__name__, x.length) for x in salvage(file)]
        return found, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_false_length_and_a_bomb_hold_little_memory():
    rest = b"".join(record(b"x" * 1000) for _ in range(20_000))
    bad = record(b"y" * 50).replace(b"Content-Length: 50", b"Content-Length: %d" % (len(rest) - 777))
    found, peak = peak_of(bad + rest)
    assert found[0][0] == "Gap" and len(found) == 20_001 and peak < 16 << 20
    # a false length that happens to end at a record's end: the digest tells, piece by piece
    found, peak = peak_of(bad.replace(b"%d" % (len(rest) - 777), b"%d" % (len(rest) - 4 + 54)) + rest)
    assert found[0][0] == "Gap" and len(found) == 20_001 and peak < 16 << 20
    bomb = gzip.compress(encode_record({"WARC-Type": "response"}, b"").replace(b"Content-Length: 0", b"Content-Length: 10") + b"\0" * (200 << 20))
    found, peak = peak_of(bomb + gzip.compress(record(b"good")))
    assert [x for x, _ in found] == ["Gap", "Record"] and peak < 16 << 20


@pytest.mark.parametrize("seed", range(4))
def test_damage_at_random_places(seed):
    """Whatever is overwritten, records that it doesn't touch are found, and every byte is told of."""
    rng = random.Random(seed)
    records = [(gzip.compress if rng.random() < 0.5 else bytes)(record(bytes(rng.randrange(256) for _ in range(rng.randrange(400))))) for _ in range(60)]
    data, ends = bytearray(b"".join(records)), []
    for r in records:
        ends.append((ends[-1] if ends else 0) + len(r))
    hit = {rng.randrange(60) for _ in range(8)}
    for i in hit:
        data[ends[i] - len(records[i]) // 2] ^= 255
    found, _ = run(bytes(data))
    whole = {(x.offset, x.length) for x in found if not isinstance(x, Gap)}
    assert {(ends[i] - len(records[i]), len(records[i])) for i in range(60) if i not in hit} <= whole
    assert sum(isinstance(x, Gap) for x in found) >= 1

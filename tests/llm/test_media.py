import hashlib
import io
import math
import os
import struct
import tarfile
import zlib
from collections import Counter

import pyarrow.fs as pfs

from factlane.llm import media as M

SF = "/root/testdata/sf0.001"


def expected(text):
    raw = (text or "").encode()
    payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
    media = M.encode(payload)
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())


def brute_png(data):
    """The samples of an 8-bit RGB image of unfiltered lines, by the format's definition alone."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        chunks.append((kind, body))
        at += 12 + n
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"]
    width, height, depth, color, *rest = struct.unpack(">IIBBBBB", chunks[0][1])
    assert (depth, color, rest) == (8, 2, [0, 0, 0])
    lines = zlib.decompress(chunks[1][1])
    step = 3 * width + 1
    assert len(lines) == step * height and not any(lines[::step])
    return b"".join(lines[k + 1 : k + step] for k in range(0, len(lines), step))


def brute_feature(payload):
    count = Counter(payload)
    n = len(payload)
    mean = sum(payload) / n
    spread = math.sqrt(sum(c * (v - mean) ** 2 for v, c in count.items()) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    top = sorted(range(256), key=lambda v: (-count[v], v))[:3]
    return f"png;64x{n // 192}x3x8;mean={mean:.3f};std={spread:.3f};entropy={abs(entropy):.3f};top={','.join(map(str, top))}"


def test_round_trip():
    for text in (b"", b"x", os.urandom(192), os.urandom(1000), b"\0" * 191, bytes(range(256)) * 300):
        payload = M.pad(text)
        assert len(payload) % 192 == 0 and payload.startswith(text)
        assert M.decode(M.encode(payload)) == brute_png(M.encode(payload)) == payload
    assert M.header(M.encode(M.pad(b"y" * 200))[:33]) == {"width": 64, "height": 2, "bit_depth": 8, "channels": 3}
    bad = bytearray(M.encode(M.pad(b"z")))
    bad[50] ^= 1
    try:
        M.decode(bytes(bad))
        raise AssertionError("damage goes unnoticed")
    except ValueError:
        pass


def test_shards(spark):
    docs = [(1, "a"), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "é" * 500), (5, " "), (6, "long " * 40000), (7, "\0")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, digest string, length int").repartition(3)
    rows, index = M.store(d, shard_bytes=1000)
    assert rows.count() == len(docs) and index.count() == 5  # "", null and " " are one payload
    told = {r.digest: r for r in M.headers(index).collect()}
    for r in index.collect():
        files, path = pfs.FileSystem.from_uri(r.shard)
        whole = files.open_input_file(path).read()
        with tarfile.open(fileobj=io.BytesIO(whole)) as tar:
            member = tar.extractfile(r.digest + ".png").read()
        assert whole[r.offset : r.offset + r.length] == member
        assert hashlib.sha256(brute_png(member)).hexdigest() == r.digest
        assert told[r.digest].height * 192 == len(brute_png(member))
    assert M.store(d.limit(0))[1].count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = M.op1(spark, SF).collect()
    assert len(got) == len(docs)
    seen = {}
    for r in got:
        assert tuple(r)[1:7] == expected(docs[r.doc_id])
        payload = M.pad((docs[r.doc_id] or "").encode())
        if docs[r.doc_id] not in seen:
            seen[docs[r.doc_id]] = brute_feature(payload)
        assert r.feature == seen[docs[r.doc_id]]

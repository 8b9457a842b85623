"""Packs read by their indexes against packs read whole."""

import hashlib
import random
import zlib

import pytest

from lorekeep.sources import git, packs

from .test_sources_and_streams import make_object


def varint(n):
    out = []
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def delta_of(base, target):
    """Copies a common prefix, inserts the rest."""
    n = 0
    while n < min(len(base), len(target), 0xFFFF) and base[n] == target[n]:
        n += 1
    out = varint(len(base)) + varint(len(target))
    if n:
        out += bytes([0x80 | 0x10 | 0x20, n & 0xFF, n >> 8])
    for a in range(n, len(target), 127):
        part = target[a : a + 127]
        out += bytes([len(part)]) + part
    return out


def header(kind, size):
    first = kind << 4 | size & 15
    size >>= 4
    out = [first | (0x80 if size else 0)]
    while size:
        out.append(size & 0x7F | (0x80 if size > 0x7F else 0))
        size >>= 7
    return bytes(out)


def offset(back):
    out = [back & 0x7F]
    back >>= 7
    while back:
        back -= 1
        out.insert(0, back & 0x7F | 0x80)
        back >>= 7
    return bytes(out)


def named(body):
    return hashlib.sha1(b"blob %d\0" % len(body) + body).digest()


def write(folder, name, objects):
    """``objects``: (body, base or None, "ofs" or "ref"); returns nothing, writes pack and index."""
    raw, places = b"PACK" + (2).to_bytes(4, "big") + len(objects).to_bytes(4, "big"), {}
    for body, base, how in objects:
        at = len(raw)
        places[named(body)] = at
        if base is None:
            raw += header(3, len(body)) + zlib.compress(body)
        else:
            delta = delta_of(base, body)
            raw += header(6 if how == "ofs" else 7, len(delta)) + (offset(at - places[named(base)]) if how == "ofs" else named(base)) + zlib.compress(delta)
    checksum = hashlib.sha1(raw).digest()
    raw += checksum
    names = sorted(places)
    fan = b"".join(sum(n[0] <= k for n in names).to_bytes(4, "big") for k in range(256))
    # every fifth place is told in the table of large ones
    order = [n for i, n in enumerate(names) if i % 5 == 0]
    small = b"".join((0x80000000 | order.index(n)).to_bytes(4, "big") if n in order else places[n].to_bytes(4, "big") for n in names)
    index = b"\xfftOc" + (2).to_bytes(4, "big") + fan + b"".join(names) + b"\0" * 4 * len(names) + small + b"".join(places[n].to_bytes(8, "big") for n in order) + checksum
    index += hashlib.sha1(index).digest()
    (folder / "objects" / "pack").mkdir(parents=True, exist_ok=True)
    (folder / "objects" / "pack" / f"{name}.pack").write_bytes(raw)
    (folder / "objects" / "pack" / f"{name}.idx").write_bytes(index)
    return raw, index, places


def history(rng, n, size):
    """Blobs, each a longer form of the one before."""
    out = [rng.randbytes(size)]
    for _ in range(n - 1):
        out.append(out[-1][: rng.randint(len(out[-1]) // 2, len(out[-1]))] + rng.randbytes(rng.randint(1, 300)))
    return out


@pytest.mark.parametrize("bucket", [512, 1 << 20])
def test_objects_by_index_equal_whole_packs(spark, tmp_path, bucket, monkeypatch):
    monkeypatch.setattr(packs, "BUCKET", bucket)
    rng = random.Random(bucket)
    a, b, c = history(rng, 12, 700), history(rng, 5, 40), history(rng, 3, 9000)
    first = [(x, a[i - 1] if i else None, "ofs") for i, x in enumerate(a)] + [(x, b[i - 1] if i else None, "ref") for i, x in enumerate(b)] + [(b"\n" * 4000, None, ""), (b"", None, "")]
    raw, index, places = write(tmp_path, "pack-1", first)
    # the second pack's deltas stand on objects of the first, and one on a loose object
    lone, content = make_object("blob", b"loose one\n" * 9)
    (tmp_path / "objects" / lone[:2]).mkdir(parents=True)
    (tmp_path / "objects" / lone[:2] / lone[2:]).write_bytes(content)
    far = [(a[-1] + b"more", a[-1], "ref"), (b"loose one\n" * 5, b"loose one\n" * 9, "ref"), *((x, c[i - 1] if i else None, "ofs") for i, x in enumerate(c))]
    write(tmp_path, "pack-2", far)
    got = {r.hash: (r.kind, bytes(r.body)) for r in packs.objects(spark, str(tmp_path)).collect()}
    assert got == {named(x).hex(): ("blob", x) for x in [*a, *b, *c, b"\n" * 4000, b"", a[-1] + b"more", b"loose one\n" * 5, b"loose one\n" * 9]}
    assert got == {r.hash: (r.kind, bytes(r.body)) for r in git.objects(spark, str(tmp_path)).collect()}
    assert {(n, bytes(x)) for n, _, x in git.unpack(raw)} == {(n, got[n][1]) for n in (named(x[0]).hex() for x in first)}
    told = packs.Index(index)
    assert {told.name(i): int(told.places[i]) for i in range(told.count)} == {n.hex(): p for n, p in places.items()}
    assert all(told.find(n.hex()) == p for n, p in places.items()) and told.find("0" * 40) is None and told.find("f" * 40) is None
    assert packs.pieces(spark, str(tmp_path)).selectExpr("max(octet_length(bytes)) as n").first().n <= bucket
    levels = packs.levels(packs.entries(spark, str(tmp_path)), spark.createDataFrame([(named(x).hex(),) for x in (a[0], b[0], c[0], b"loose one\n" * 9)], "hash string"))
    assert {r.hash: r.level for r in levels.collect()} == {named(x).hex(): i for h in ([*a, a[-1] + b"more"], b, c, [b"loose one\n" * 9, b"loose one\n" * 5]) for i, x in enumerate(h) if i}


def test_a_base_that_is_nowhere(spark, tmp_path):
    write(tmp_path, "pack-1", [(b"abcdef", b"abc", "ref"), (b"x", None, "")])
    with pytest.raises(ValueError, match="no pack"):
        packs.objects(spark, str(tmp_path))
    with pytest.raises(ValueError, match="version 2"):
        packs.Index(b"\0" * 2000)

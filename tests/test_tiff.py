"""TIFF layouts, written by a writer of the tests' own: each file must give the plain file's volume."""

import itertools
import struct
import zlib

import numpy as np
import pytest

from voxloom.plans import fixtures, job
from voxloom.session import Config
from voxloom.sources import tiff


def lzw(data: bytes) -> bytes:
    """A plain encoder: codes as a bit string."""
    bits, width = [], 9
    table = {bytes([i]): i for i in range(256)}
    put = lambda code: bits.append(format(code, f"0{width}b"))
    put(256)
    word, size = b"", 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = size
        size += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif size in (512, 1024, 2048):  # one code later than the reader's table, which lags by one entry
            width += 1
        word = c
    if word:
        put(table[word])
        size += 1
        if size in (512, 1024, 2048):
            width += 1
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def pack_bits(data: bytes) -> bytes:
    out = b""
    for value, run in itertools.groupby(data):
        n = len(list(run))
        while n > 0:
            k = min(n, 128)
            out += bytes([257 - k, value]) if k > 1 else bytes([0, value])
            n -= k
    return out


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: pack_bits}


def build(volume, order="<", big=False, tile=None, rows=None, compression=1, predictor=1, white=False, extra=()):
    word, count = ("Q", "Q") if big else ("I", "H")
    size = struct.calcsize(word)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for page in volume:
        h, w = page.shape
        page = 255 - page if white else page
        th, tw = tile or (rows or h, w)
        starts, counts = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = page[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1])), constant_values=7)
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = PACK[compression](part.tobytes())
                starts.append(len(out))
                counts.append(len(raw))
                out += raw
        lists = {(tiff.TILES if tile else tiff.STRIPS): starts, (tiff.TILE_COUNTS if tile else tiff.COUNTS): counts}
        kind = 16 if big else 4
        tags = [(tiff.WIDTH, 3, [w]), (tiff.HEIGHT, 4, [h]), (tiff.BITS, 3, [8]), (tiff.COMPRESSION, 3, [compression]), (tiff.PHOTOMETRIC, 3, [0 if white else 1]), (tiff.SAMPLES, 3, [1]), (305, 2, b"someone\0"), *[(t, kind, v) for t, v in lists.items()]]
        tags += [(tiff.TILE_WIDTH, 3, [tw]), (tiff.TILE_HEIGHT, 3, [th])] if tile else [(tiff.ROWS, 3, [th])]
        tags += [(tiff.PREDICTOR, 3, [predictor])] * (predictor != 1) + list(extra)
        fields = []
        for tag, k, values in sorted(tags):
            raw = values if k == 2 else struct.pack(order + str(len(values)) + {3: "H", 4: "I", 16: "Q"}[k], *values)
            if len(raw) > size:
                at = len(out)
                out += raw
                raw = struct.pack(order + word, at)
            fields.append(struct.pack(order + "HH" + word, tag, k, len(values)) + raw.ljust(size, b"\0"))
        out[link : link + size] = struct.pack(order + word, len(out))
        out += struct.pack(order + count, len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0" * size
    return bytes(out)


def volume(seed=0, shape=(3, 37, 45)):
    rng = np.random.default_rng(seed)
    return np.where(rng.random(shape) < 0.4, 255, 0).astype(np.uint8)


def read(data, **more):
    w, h, d, *_, bits = tiff.read_volume(data, **more)
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=w * h * d).reshape(d, h, w).astype(bool)


LAYOUTS = list(itertools.product("<>", (False, True), (None, (16, 32)), PACK, (1, 2)))


@pytest.mark.parametrize("order,big,tile,compression,predictor", LAYOUTS)
def test_every_layout_gives_the_plain_volume(order, big, tile, compression, predictor):
    v = volume()
    data = build(v, order, big, tile, None if tile else 10, compression, predictor, white=big)
    assert (read(data, domain="strict") == (v > 0)).all()


@pytest.mark.parametrize("compression", PACK)
def test_long_codes(compression):
    """Enough different strings to fill the table of codes and to start it again, and long runs."""
    rng = np.random.default_rng(1)
    v = np.stack([rng.integers(0, 256, (120, 150)), np.zeros((120, 150)), np.repeat(rng.integers(0, 256, (120, 1)), 150, axis=1)]).astype(np.uint8)
    assert (read(build(v, compression=compression, rows=50), threshold=90) == (v > 90)).all()


@pytest.mark.parametrize("tag,value,why", [(tiff.BITS, 16, "8-bit"), (tiff.SAMPLES, 3, "8-bit"), (tiff.SAMPLE_FORMAT, 2, "8-bit"), (tiff.PREDICTOR, 3, "predictor"), (tiff.FILL_ORDER, 2, "bits"), (tiff.COMPRESSION, 7, "compression"), (tiff.PHOTOMETRIC, 3, "8-bit")])
def test_what_changes_samples_is_an_error(tag, value, why):
    with pytest.raises(tiff.TiffError, match=why):
        read(build(volume(), extra=[(tag, 3, [value])]))


def test_damaged_files_are_errors():
    rng = np.random.default_rng(2)
    for compression, big, tile in itertools.product(PACK, (False, True), (None, (16, 16))):
        good = build(volume(3, (2, 20, 20)), compression=compression, big=big, tile=tile)
        for _ in range(60):
            bad = bytearray(good[: rng.integers(1, len(good) + 1)])
            for at in rng.integers(0, len(bad), 3):
                bad[at] = rng.integers(0, 256)
            try:
                tiff.read_volume(bytes(bad))
            except tiff.TiffError:
                pass
    with pytest.raises(tiff.TiffError, match="cover"):
        read(build(volume(), rows=10, extra=[(tiff.HEIGHT, 4, [300])]))


def test_large_files_are_read_by_pages(spark, tmp_path):
    """With small limits, so that each file is dealt out over several tasks."""
    (tmp_path / "in").mkdir()
    made = {}
    for k, (big, tile, compression) in enumerate([(True, (16, 16), 5), (False, None, 1), (True, None, 8), (False, (16, 48), 32773)]):
        made[f"v{k}.tif"] = v = volume(k, (19, 21, 23))
        (tmp_path / f"in/v{k}.tif").write_bytes(build(v, big=big, tile=tile, compression=compression, predictor=1 + k % 2))
    (tmp_path / "in/bad.tif").write_bytes(build(volume(9, (19, 21, 23)))[:-5000] + b"?" * 5000)
    (tmp_path / "in/no.tif").write_bytes(b"nothing" * 900)
    (tmp_path / "in/odd.tif").write_bytes(build([*volume(7, (9, 21, 23)), *volume(8, (9, 20, 23))]))
    files = tiff.discover(spark, f"file://{tmp_path}/in")
    whole = {r["path"]: tuple(r) for r in tiff.volumes(spark, files, domain="strict").collect()}
    parts = {r["path"]: tuple(r) for r in tiff.volumes(spark, files, domain="strict", largest=100, split_bytes=2000).collect()}
    assert whole.keys() == parts.keys() and len(whole) == 7
    for path, row in whole.items():
        name = path.rsplit("/", 1)[1]
        if name in made:
            assert row == parts[path] and row[-1] is None
            assert (np.unpackbits(np.frombuffer(row[7], np.uint8), count=19 * 21 * 23).reshape(19, 21, 23) == made[name] // 255).all()
        else:
            assert row[-1] is not None and parts[path][-1] is not None and parts[path][1] is None


def test_pages_of_a_large_file_are_dealt_out(spark, tmp_path):
    (tmp_path / "v.tif").write_bytes(build(volume(1, (40, 30, 30)), big=True))
    tiff.register(spark)
    found = spark.read.format("voxel_tiff").option("split_bytes", 9000).load(str(tmp_path))
    assert found.rdd.getNumPartitions() >= 4
    assert sorted(r["z"] for r in found.select("z").collect()) == list(range(40))


def test_job_on_compressed_tiles(spark, tmp_path):
    for sub in ("bone", "roi"):
        (tmp_path / sub).mkdir()
    bone = fixtures.paint([(8, 9, 10, 5), (15, 14, 12, 4)]).astype(np.uint8) * 255
    (tmp_path / "roi/a.tif").write_bytes(build(fixtures.region().astype(np.uint8), compression=5, tile=(16, 16)))
    (tmp_path / "bone/a.tif").write_bytes(build(bone, big=True, compression=5, predictor=2, tile=(16, 16)))
    cfg = Config(binary_dir=str(tmp_path / "bone"), roi_dir=str(tmp_path / "roi"), mode="bonej", voxel_size=25.0)
    row = job.run(spark, cfg).first()
    assert row["BV"] == (bone[fixtures.region()] > 0).sum() * 25.0**3

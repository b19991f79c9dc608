"""Volumes that are larger than a task: slabs of layers as rows.

A slab row holds ``layers`` layers of a specimen from ``z0`` on and, unless it is the first, the layer
below them (``below``). Labels are made inside a slab; slabs agree on components through the layer that
two of them see, whose runs come in the same order in both. Distances need whole lines: the first two axes
lie in a layer, for the third the layers' lines are dealt out by rows and dealt back.

A task holds one slab, or the lines of one block of rows: with 16 layers, or blocks of 16,777,216 voxels, of
a volume of 1,000 voxels a side some 200 MB. Distances and balls take small slabs or blocks of one shape together,
TOGETHER voxels at a time, so that many small volumes cost no more than their voxels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxloom.functions import layers as L
from voxloom.functions import surfaces
from voxloom.functions.voxels import MorphometryError, clean_surface, phase
from voxloom.operators.specimens import pack, per_specimen, unpack
from voxloom.operators.unions import components
from voxloom.session import cut

LAYERS = 16
#: Voxels of a block of whole lines along z.
BLOCK_VOXELS = 1 << 24
#: Voxels of small slabs or blocks that are worked on together; larger ones are taken alone.
TOGETHER = 1 << 20
_PLACE = "z0 int, layers int, below int, depth int, width int, height int"
SLAB = f"{_PLACE}, h_um double, bone binary, roi binary"
_NAMES = ["z0", "layers", "below", "depth", "width", "height"]


def from_volumes(volumes: DataFrame, layers: int = LAYERS) -> DataFrame:
    """Slabs of volume rows."""

    def kernel(bone: np.ndarray, roi: np.ndarray, h: float) -> list[dict]:
        d, height, width = bone.shape
        rows = []
        for z in range(0, d, layers):
            at = slice(max(0, z - 1), z + layers)
            rows.append({"z0": z, "layers": min(layers, d - z), "below": int(z > 0), "depth": d, "width": width, "height": height, "h_um": h, "bone": pack(bone[at]), "roi": pack(roi[at])})
        return rows

    return per_specimen(volumes, kernel, SLAB, "raise")


def from_pages(pages: DataFrame, layers: int = LAYERS) -> DataFrame:
    """Slabs of page rows (specimen, z, width, height, h_um, bone, roi), as the TIFF source gives them for files of
    any size; a null roi is the whole page. Each page goes to its slab, the last one of a slab also to the next.
    Pages that are not 0, 1, 2 ... once each, or differ in size, fail the job."""
    size = pages.groupBy("specimen").agg(
        F.count("*").alias("n"), F.count_distinct("z").alias("places"), F.max("z").alias("top"), F.min("width").alias("width"), F.max("width").alias("wide"), F.min("height").alias("height"), F.max("height").alias("high")
    )
    even = (F.col("n") == F.col("places")) & (F.col("top") == F.col("n") - 1) & (F.col("width") == F.col("wide")) & (F.col("height") == F.col("high"))
    size = size.select("specimen", F.when(even, F.col("n").cast("int")).otherwise(F.raise_error(F.concat(F.lit("pages are no volume: "), F.col("specimen").cast("string")))).alias("depth"))
    own = F.floor(F.col("z") / F.lit(layers)).cast("int")
    to = F.explode(F.when((F.col("z") + 1) % layers == 0, F.array(own, own + 1)).otherwise(F.array(own)))
    dealt = pages.select("specimen", "z", "width", "height", "h_um", "bone", "roi", to.alias("slab"))
    held = dealt.groupBy("specimen", "slab").agg(F.min("width").alias("width"), F.min("height").alias("height"), F.min("h_um").alias("h_um"), F.sort_array(F.collect_list(F.struct("z", "bone", "roi"))).alias("pages"))
    held = held.join(size, "specimen").filter(F.col("slab") * layers < F.col("depth"))
    target = to_arrow_schema(StructType.fromDDL(f"specimen {pages.schema['specimen'].dataType.simpleString()}, {SLAB}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                v = b.slice(i, 1).to_pylist()[0]
                n = v["width"] * v["height"]
                bits = lambda raw: np.ones(n, np.uint8) if raw is None else np.unpackbits(np.frombuffer(raw, np.uint8), count=n)  # noqa: B023, E731
                masks = [np.packbits(np.concatenate([bits(p[k]) for p in v["pages"]])).tobytes() for k in ("bone", "roi")]
                z0 = v["slab"] * layers
                below = int(z0 > 0)
                row = [v["specimen"], z0, len(v["pages"]) - below, below, v["depth"], v["width"], v["height"], v["h_um"], *masks]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, target.types, strict=True)], schema=target)

    return held.mapInArrow(run, f"specimen {pages.schema['specimen'].dataType.simpleString()}, {SLAB}")


def per_slab(slabs: DataFrame, kernel: Callable[[np.ndarray, dict], list[dict]], schema: str) -> DataFrame:
    """Rows that ``kernel(bone inside the region, place)`` gives for each slab, with the specimen."""
    ddl = f"specimen {slabs.schema['specimen'].dataType.simpleString()}, {schema}"
    target = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                place = {n: b.column(n)[i].as_py() for n in ["specimen", *_NAMES]}
                shape = (place["below"] + place["layers"], place["height"], place["width"])
                bone = unpack(b.column("bone")[i].as_py(), shape)
                inside = phase(bone, unpack(b.column("roi")[i].as_py(), shape), True)
                for row in kernel(inside, place):  # one row a batch: a slab's rows may be large
                    yield pa.RecordBatch.from_arrays([pa.array([place["specimen"] if f.name == "specimen" else row.get(f.name)], f.type) for f in target], schema=target)

    return slabs.select("specimen", *_NAMES, "bone", "roi").mapInArrow(run, ddl)


_LABELLED = (
    "kind string, phase int, slab int, border int, labels binary, parts long, bone_parts long, void_parts long, open_parts long, vertices long, edges long, faces long, cubes long, tv long"
)


def _labelled(inside: np.ndarray, place: dict) -> list[dict]:
    """A slab's own counts (kind sum), the components of its shared layers (plane), those among them that
    touch the image's border (open), and those of its lowest and highest occupied layer (low, high)."""
    z0, below, n = place["z0"], place["below"], len(inside)
    first, last = z0 == 0, z0 + place["layers"] == place["depth"]
    vertices, edges, faces, cubes = L.cell_counts(inside, below, last)
    rows: list[dict] = []
    total = {"kind": "sum", "slab": z0, "vertices": vertices, "edges": edges, "faces": faces, "cubes": cubes, "open_parts": 0}
    raw = lambda a: a.astype("<i4").tobytes()
    for which, mask, connectivity in ((0, inside, 26), (1, ~inside, 6)):
        runs = L.label_runs(mask, connectivity)
        total["void_parts" if which else "bone_parts"] = runs.parts
        shared = [runs.of_layer(0)] if below else []
        if below:
            rows.append({"kind": "plane", "phase": which, "slab": z0, "border": z0, "labels": raw(shared[0]), "parts": 1})
        if not last:
            shared.append(runs.of_layer(n - 1))
            rows.append({"kind": "plane", "phase": which, "slab": z0, "border": z0 + place["layers"], "labels": raw(shared[-1]), "parts": 0})
        if which:
            outer = runs.outer(mask.shape, first, last)
            beyond = np.isin(outer, np.unique(np.concatenate(shared))) if shared else np.zeros(len(outer), bool)
            total["open_parts"] = int((~beyond).sum())
            rows.append({"kind": "open", "phase": 1, "slab": z0, "labels": raw(outer[beyond])})
        else:
            own = np.flatnonzero(inside[below:].any(axis=(1, 2)))
            for kind, z in (("low", own[0]), ("high", own[-1])) if len(own) else ():
                rows.append({"kind": kind, "phase": 0, "slab": z0, "border": z0 + int(z), "labels": raw(np.unique(runs.of_layer(int(z) + below)))})
    return [total, *rows]


def _node(slab: str, label: str):
    return F.shiftleft(F.col(slab).cast("long"), 32) + F.col(label).cast("long")


def _listed(rows: DataFrame) -> DataFrame:
    """(specimen, phase, slab, border, label) of rows with packed labels."""
    kind = rows.schema["specimen"].dataType.simpleString()
    ddl = f"specimen {kind}, phase int, slab int, border int, label int"
    names = [f.name for f in to_arrow_schema(StructType.fromDDL(ddl))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                labels = np.frombuffer(b.column("labels")[i].as_py(), "<i4")
                yield pa.RecordBatch.from_arrays([*[pa.repeat(b.column(c)[i], len(labels)) for c in names[:4]], pa.array(labels)], names=names)

    return rows.select(*names[:4], "labels").mapInArrow(run, ddl)


def _pairs(planes: DataFrame) -> DataFrame:
    """Edges (specimen, phase, a, b) between components of two slabs that share a voxel."""
    kind = planes.schema["specimen"].dataType.simpleString()
    ddl = f"specimen {kind}, phase int, a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                under, over = (np.frombuffer(batch.column(c)[i].as_py(), "<i4").astype(np.int64) for c in ("under", "over"))
                if len(under) != len(over):
                    raise ValueError("slabs differ in the layer they share")
                pairs = np.unique(np.stack([under | batch.column("slab_under")[i].as_py() << 32, over | batch.column("slab_over")[i].as_py() << 32]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("specimen")[i], pairs.shape[1]), pa.array(np.full(pairs.shape[1], batch.column("phase")[i].as_py(), np.int32)), pa.array(pairs[0]), pa.array(pairs[1])], names=["specimen", "phase", "a", "b"])

    keys = ["specimen", "phase", "border"]
    under = planes.filter("parts = 0").select(*keys, F.col("slab").alias("slab_under"), F.col("labels").alias("under"))
    over = planes.filter("parts = 1").select(*keys, F.col("slab").alias("slab_over"), F.col("labels").alias("over"))
    return under.join(over.hint("shuffle_merge"), keys).mapInArrow(run, ddl)


def topology(slabs: DataFrame) -> DataFrame:
    """(specimen, bone_voxels, euler, b0, b1, b2, spans): what ``measures.betti`` gives for whole volumes, of any
    size. Shuffled are the labels of shared layers, as runs, and the edges between them."""
    made = cut(per_slab(slabs, _labelled, _LABELLED), "labels")
    sums = made.filter("kind = 'sum'").groupBy("specimen").agg(
        F.sum("cubes").alias("bone_voxels"), F.sum(F.expr("vertices - edges + faces - cubes")).alias("euler"), F.sum("bone_parts").alias("bone_parts"), F.sum("void_parts").alias("void_parts"), F.sum("open_parts").alias("open_parts")
    )
    edges = _pairs(made.filter("kind = 'plane'"))
    joined = cut(components(edges, ["specimen", "phase"]), "components")
    merged = joined.groupBy("specimen").pivot("phase", [0, 1]).agg(F.count("node").alias("nodes"), F.count_distinct("component").alias("parts"))
    node = _listed(made.filter("kind = 'open'")).select("specimen", "phase", _node("slab", "label").alias("node"))
    open_ = node.join(joined, ["specimen", "phase", "node"]).groupBy("specimen").agg(F.count_distinct("component").alias("open_joined"))

    ends = made.filter("kind IN ('low', 'high')")
    reach = ends.groupBy("specimen").agg(F.min("border").alias("lowest"), F.max("border").alias("highest"))
    at_end = ends.join(reach, "specimen").filter("(kind = 'low' AND border = lowest OR kind = 'high' AND border = highest) AND lowest < highest")
    side = _listed(at_end).join(reach, "specimen").select("specimen", "phase", (F.col("border") == F.col("lowest")).alias("low"), _node("slab", "label").alias("node"))
    side = side.join(joined, ["specimen", "phase", "node"], "left").groupBy("specimen", F.coalesce("component", "node").alias("part")).agg(F.count_if("low").alias("n_low"), F.count_if(~F.col("low")).alias("n_high"))
    spans = side.groupBy("specimen").agg(F.max((F.col("n_low") > 0) & (F.col("n_high") > 0)).alias("spans"))

    every = sums.join(merged, "specimen", "left").join(open_, "specimen", "left").join(spans, "specimen", "left").na.fill(0, ["0_nodes", "0_parts", "1_nodes", "1_parts", "open_joined"]).na.fill(False, ["spans"])
    b0 = F.col("bone_parts") - F.col("`0_nodes`") + F.col("`0_parts`")
    b2 = F.col("void_parts") - F.col("`1_nodes`") + F.col("`1_parts`") - F.col("open_parts") - F.col("open_joined")
    return every.select("specimen", "bone_voxels", "euler", b0.alias("b0"), b2.alias("b2"), "spans").select("specimen", "bone_voxels", "euler", "b0", (F.col("b0") + F.col("b2") - F.col("euler")).alias("b1"), "b2", "spans")


def _voxels(place: dict) -> int:
    return (place["below"] + place["layers"] + place.get("above", 0)) * place["height"] * place["width"]


def _alike(rows: pa.RecordBatch, names: list[str], voxels: Callable[[dict], int] = _voxels) -> Iterator[tuple[dict, np.ndarray]]:
    """Numbers of rows that agree in the columns ``names``, with these values: as many at a time as hold TOGETHER
    voxels, one at least."""
    kinds, of = np.unique(np.stack([rows.column(n).to_numpy() for n in names], axis=1), axis=0, return_inverse=True)
    of = of.ravel()
    order, ends = np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(kinds)))
    for kind, at in zip(kinds.tolist(), np.split(order, ends[:-1]), strict=True):
        place = dict(zip(names, kind, strict=True))
        step = max(1, TOGETHER // max(1, voxels(place)))
        for i in range(0, len(at), step):
            yield place, at[i : i + step]


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a column of binaries, end to end."""
    _, ends, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(ends, wide)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(1, wide)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)


def _binaries(data: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """Binaries of the items of an array's first axis; with ``sizes``, of as many of them each."""
    data = np.ascontiguousarray(data)
    each = data.itemsize * int(np.prod(data.shape[1:]))
    ends = np.append(0, np.cumsum(np.ones(len(data), np.int64) if sizes is None else sizes)) * each
    if ends[-1] >= 1 << 31:
        raise ValueError("more than 2 GB in a column of a batch")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _rows(target: pa.Schema, specimens: pa.Array, place: dict, **columns: pa.Array) -> pa.RecordBatch:
    """A row for each specimen; a value of ``place`` stands in all of them."""
    columns["specimen"] = specimens.cast(target.field("specimen").type)
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.repeat(pa.scalar(place[f.name], f.type), len(specimens)) for f in target], schema=target)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows as batches of whole groups of equal keys, with the row where each group begins."""
    held: list[pa.RecordBatch] = []  # the group that may go on
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            code = b.column(k).dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        new[0] = not held or any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys)
        begins = np.flatnonzero(new)
        if len(begins):
            last = int(begins[-1])
            before = sum(h.num_rows for h in held)
            if before + last:
                yield pa.concat_batches([*held, b.slice(0, last)]), np.unique(np.append(0, begins[:-1] + before))
            held, b = [], b.slice(last)
        held.append(b)
    if held:
        yield pa.concat_batches(held), np.zeros(1, np.int64)


def _gathered(pieces: DataFrame, by: list[str], along: str, names: list[str], voxels: Callable[[dict], int], kernel: Callable[[dict, pa.Array, pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``kernel(place, specimens, pieces, counts)`` gives for groups that agree in ``names``: their specimens, and
    their pieces in the order of the groups and of ``along``, ``counts`` of each."""
    kind = pieces.schema["specimen"].dataType.simpleString()
    keys = ["specimen", *by]
    # few bytes here become much work: with a number, adaptive execution leaves the tasks as they are
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(tasks, *keys).sortWithinPartitions(*keys, along)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _groups(batches, keys):
            counts = np.diff(np.append(begins, rows.num_rows))
            for place, at in _alike(rows.select(names).take(pa.array(begins)), names, voxels):
                n = counts[at]
                found = np.arange(n.sum()) + np.repeat(begins[at] - (np.cumsum(n) - n), n)
                yield from kernel(place, rows.column("specimen").take(pa.array(begins[at])), rows.take(pa.array(found)), n)

    return dealt.mapInArrow(run, f"specimen {kind}, {schema}")


_BITS = "z0 int, y0 int, rows int, depth int, width int, height int, bits binary"
_LINES = "z0 int, layers int, below int, above int, y0 int, depth int, width int, height int, d2 binary"
_DISTANCES = "z0 int, layers int, below int, above int, depth int, width int, height int, d2 binary"
_SIDES = ["depth", "width", "height"]


def _target(kind: str, schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(f"specimen {kind}, {schema}"))


def squared_distance(slabs: DataFrame, layers: int = LAYERS, block_voxels: int = BLOCK_VOXELS, halo: int = 0) -> DataFrame:
    """(specimen, z0, layers, below, above, depth, width, height, d2): the squared distance of each bone voxel inside
    the region to the nearest voxel that is none, 0 elsewhere, as 32-bit numbers [z, y, x] of slabs of
    ``layers`` layers, with up to ``halo`` layers of the slabs below and above. A specimen without any
    voxel of the other phase fails the job.

    Every slab is cut into blocks of rows, the blocks are put together, so lines along z and x are whole, and the
    result is dealt back to slabs, where those along y are: one shuffle of bits and one of distances.
    """
    kind = slabs.schema["specimen"].dataType.simpleString()
    bits, made, done = (_target(kind, schema) for schema in (_BITS, _LINES, _DISTANCES))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, at in _alike(b, _NAMES) if b.num_rows else ():
                some = b.take(pa.array(at))
                own = np.packbits(_inside(some, place)[:, place["below"] :], axis=-1)
                rows = max(1, block_voxels // (place["depth"] * place["width"]))
                for y in range(0, place["height"], rows):
                    yield _rows(bits, some.column("specimen"), place | {"y0": y, "rows": min(rows, place["height"] - y)}, bits=_binaries(own[:, :, y : y + rows]))

    def lines(place: dict, specimens: pa.Array, pieces: pa.RecordBatch, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        packed = _bytes(pieces.column("bits")).reshape(len(specimens), place["depth"], place["rows"], -1)
        d2 = L.nearest(L.row_distance(np.unpackbits(packed, axis=-1, count=place["width"]).view(bool), 1), 3)
        d2 = d2.swapaxes(1, 2)  # rows first: blocks one after another are a slab
        for z in range(0, place["depth"], layers):
            n = min(layers, place["depth"] - z)
            below, above = min(halo, z), min(halo, place["depth"] - z - n)
            yield _rows(made, specimens, place | {"z0": z, "layers": n, "below": below, "above": above}, d2=_binaries(d2[:, :, z - below : z + n + above].astype("<i4")))

    def slab(place: dict, specimens: pa.Array, pieces: pa.RecordBatch, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        f = _bytes(pieces.column("d2")).view("<i4").reshape(len(specimens), place["height"], -1, place["width"])
        d2 = L.nearest(f, 1).swapaxes(1, 2)
        if d2.max() >= L.FAR:
            raise MorphometryError("no voxel of the opposite phase")
        yield _rows(done, specimens, place, d2=_binaries(d2))

    pieces = slabs.select("specimen", *_NAMES, "bone", "roi").mapInArrow(flat, f"specimen {kind}, {_BITS}")
    blocks = _gathered(pieces, ["y0"], "z0", ["y0", "rows", *_SIDES], lambda p: p["depth"] * p["rows"] * p["width"], lines, _LINES)
    return _gathered(blocks, ["z0"], "y0", ["z0", "layers", "below", "above", *_SIDES], _voxels, slab, _DISTANCES)


def _inside(slabs: pa.RecordBatch, place: dict) -> np.ndarray:
    """Bone inside the region of slabs of one shape [slab, z, y, x]."""
    shape = (len(slabs), place["below"] + place["layers"], place["height"], place["width"])
    bone, roi = (np.unpackbits(_bytes(slabs.column(c)).reshape(len(slabs), -1), axis=1, count=int(np.prod(shape[1:]))).view(bool).reshape(shape) for c in ("bone", "roi"))
    return phase(bone, roi, True)


#: Layers around a slab whose thickness decides that of its own: surface voxels take the mean of inner ones.
_AROUND = 2
_BALLS = "z0 int, layers int, depth int, width int, height int, balls binary, selected binary"
_PAINTED = "z0 int, layers int, below int, above int, depth int, width int, height int, r2 binary, selected binary"


def ridge_balls(slabs: DataFrame, layers: int = LAYERS, block_voxels: int = BLOCK_VOXELS, around: int = 0) -> DataFrame:
    """(specimen, z0, layers, below, above, depth, width, height, r2, selected): for each voxel of a slab, and of
    ``around`` layers on both sides, the largest squared radius of the ridge balls that cover it, as 32-bit
    numbers; ``selected`` are the phase's voxels of the slab's own layers, packed.

    A slab finds the ridge of its own layers and deals each ball to all slabs that it touches, as four
    numbers; those paint them.
    """
    kind = slabs.schema["specimen"].dataType.simpleString()
    target, painted = _target(kind, _BALLS), _target(kind, _PAINTED)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, some, d2 in _of_slabs(batches, "d2"):
            own = slice(place["below"], place["below"] + place["layers"])
            balls = L.ridge_points(d2, own)
            balls[:, 1] += place["z0"] - place["below"]
            reach = np.floor(np.sqrt(balls[:, 4])).astype(np.int64) + 1 + around
            first, last = np.maximum(balls[:, 1] - reach, 0) // layers, np.minimum(balls[:, 1] + reach, place["depth"] - 1) // layers
            n = last - first + 1
            ball = np.repeat(np.arange(len(balls)), n)
            to = np.arange(len(ball)) + np.repeat(first - (np.cumsum(n) - n), n)
            places = -(-place["depth"] // layers)
            key = balls[ball, 0].astype(np.int64) * places + to
            order = np.argsort(key, kind="stable")
            mine = np.arange(len(some)) * places + place["z0"] // layers
            rows = np.unique(np.concatenate([mine, key]))  # a slab has a row of its own, with balls or without
            sizes = np.diff(np.append(np.searchsorted(key[order], rows), len(key)))
            z0 = rows % places * layers
            selected = np.full(len(rows), None, object)
            selected[np.searchsorted(rows, mine)] = [pack(v[own] > 0) for v in d2]
            yield _rows(
                target, some.column("specimen").take(pa.array(rows // places)), place, z0=pa.array(z0, pa.int32()), layers=pa.array(np.minimum(layers, place["depth"] - z0), pa.int32()),
                balls=_binaries(balls[ball[order], 1:].astype("<i4"), sizes), selected=pa.array(selected, pa.binary()),
            )

    def paint(place: dict, specimens: pa.Array, rows: pa.RecordBatch, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        below, above = min(around, place["z0"]), min(around, place["depth"] - place["z0"] - place["layers"])
        sizes = rows.column("balls").cast(pa.binary())
        slab = np.repeat(np.repeat(np.arange(len(counts)), counts), pc.binary_length(sizes).to_numpy() // 16)
        balls = np.column_stack([slab.astype(np.int32), _bytes(sizes).view("<i4").reshape(-1, 4)])
        balls[:, 1] -= place["z0"] - below
        r2 = L.paint_balls((len(counts), below + place["layers"] + above, place["height"], place["width"]), balls)
        yield _rows(painted, specimens, place | {"below": below, "above": above}, r2=_binaries(r2.astype("<i4")), selected=rows.column("selected").drop_null())

    dealt = squared_distance(slabs, layers, block_voxels, 1).mapInArrow(deal, f"specimen {kind}, {_BALLS}")
    return _gathered(dealt, ["z0"], "z0", ["z0", "layers", *_SIDES], lambda p: (p["layers"] + 2 * around) * p["height"] * p["width"], paint, _PAINTED)


def _of_slabs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[dict, pa.RecordBatch, np.ndarray]]:
    """Slabs of one place and shape, with the 32-bit numbers [slab, z, y, x] of a column."""
    for b in batches:
        for place, at in _alike(b, ["z0", "layers", "below", "above", *_SIDES]) if b.num_rows else ():
            some = b.take(pa.array(at))
            yield place, some, _bytes(some.column(column)).view("<i4").reshape(len(at), -1, place["height"], place["width"])


def thickness(slabs: DataFrame, layers: int = LAYERS, block_voxels: int = BLOCK_VOXELS) -> DataFrame:
    """(specimen, n, mean, sd, max): local thickness of the bone inside the region, as ``measures.thickness`` gives it
    for whole volumes. Slabs sum their own voxels; the sums are taken about a specimen's mean."""
    kind = slabs.schema["specimen"].dataType.simpleString()
    spacing = slabs.groupBy("specimen").agg(F.min("h_um").alias("h_um"))
    ddl = f"specimen {kind}, value float, k long"

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, some, r2 in _of_slabs(batches, "r2"):
            raw = np.float32(2) * np.sqrt(r2.astype(np.float64)).astype(np.float32)
            own = clean_surface(raw)[:, place["below"] : place["below"] + place["layers"]]
            selected = np.stack([unpack(v, own.shape[1:]) for v in some.column("selected").to_pylist()])
            slab, values, k = _counted(own.view(np.int32), selected)
            yield pa.RecordBatch.from_arrays([some.column("specimen").take(slab), pa.array(values.astype(np.int32).view(np.float32)), pa.array(k)], names=["specimen", "value", "k"])

    found = ridge_balls(slabs, layers, block_voxels, _AROUND).mapInArrow(counts, ddl).filter("value > 0").groupBy("specimen", "value").agg(F.sum("k").alias("k"))
    scaled = cut(found.join(spacing, "specimen").select("specimen", (F.col("value") * F.col("h_um").cast("float")).cast("double").alias("value"), "k"), "thickness")
    means = scaled.groupBy("specimen").agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("value")) / F.sum("k")).alias("mean"), F.max("value").alias("max"))
    off = F.col("value") - F.col("mean")
    spread = scaled.join(means, "specimen").groupBy("specimen").agg(F.sum(F.col("k") * off * off).alias("squares"))
    return means.join(spread, "specimen").select("specimen", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).otherwise(0.0).alias("sd"), "max")


def surface_cases(slabs: DataFrame) -> DataFrame:
    """(specimen, case, n): marching cubes of each case with a surface, of volumes of any size."""
    counts = _surface(slabs).filter("case >= 0")
    return counts.groupBy("specimen", "case").agg(F.sum("n").alias("n"))


def _surface(slabs: DataFrame) -> DataFrame:
    def kernel(inside: np.ndarray, place: dict) -> list[dict]:
        cases, vertices = L.surface_counts(inside, place["below"], place["z0"] + place["layers"] == place["depth"])
        return [{"case": int(c), "n": int(cases[c])} for c in np.flatnonzero(cases) if 0 < c < 255] + [{"case": -1, "n": vertices}]

    return per_slab(slabs, kernel, "case int, n long")


def surface(slabs: DataFrame) -> DataFrame:
    """(specimen, area, midpoint_area, vertices, triangles) of the bone's surface: cases are counted by slab, and each
    case has its area and its triangles. Cubes between two slabs belong to the upper one, so surfaces close."""
    spacing = slabs.groupBy("specimen").agg(F.min("h_um").alias("h_um"))
    of = lambda values: F.lit([float(x) for x in values])[F.col("case")]
    h2 = F.col("h_um") * F.col("h_um")
    cube = F.when(F.col("case") >= 0, F.col("n")).otherwise(0)
    case = F.greatest(F.col("case"), F.lit(0))
    found = _surface(slabs).withColumns({"k": cube, "v": F.col("n") - cube, "case": case}).groupBy("specimen").agg(
        F.sum(F.col("k") * of(surfaces.case_areas())).alias("area"), F.sum(F.col("k") * of(surfaces.case_areas("middle"))).alias("middle"), F.sum("v").alias("vertices"), F.sum(F.col("k") * of([len(t) for t in surfaces.case_table()])).cast("long").alias("triangles")
    )
    return found.join(spacing, "specimen").select("specimen", (F.col("area") * h2).alias("area"), (F.col("middle") * h2).alias("midpoint_area"), "vertices", "triangles")


def _counted(values: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Slab, value and count of each value >= 0 of slabs [slab, z, y, x] among the voxels ``at``."""
    slab = np.repeat(np.arange(len(values)), np.count_nonzero(at, axis=(1, 2, 3)))
    found, k = np.unique(slab << 32 | values[at], return_counts=True)
    return pa.array(found >> 32), found & 0xFFFFFFFF, k


def value_counts(found: DataFrame, column: str) -> DataFrame:
    """(specimen, d2, n): how many voxels of the slabs' own layers have each positive value."""
    ddl = f"specimen {found.schema['specimen'].dataType.simpleString()}, d2 long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, some, all_ in _of_slabs(batches, column):
            own = all_[:, place["below"] : place["below"] + place["layers"]]
            slab, values, n = _counted(own, own > 0)
            yield pa.RecordBatch.from_arrays([some.column("specimen").take(slab), pa.array(values), pa.array(n)], names=["specimen", "d2", "n"])

    return found.mapInArrow(run, ddl).groupBy("specimen", "d2").agg(F.sum("n").alias("n"))

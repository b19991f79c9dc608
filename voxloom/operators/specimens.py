"""Volumes as rows, and kernels over them.

A volume is one row: specimen, width, height, depth, h_um, bone, roi; the masks are packed bits
in z, y, x order. Kernels run inside Arrow batches, one volume at a time, so a task holds one
specimen, and no shuffle comes between a scan and any number of measures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxloom.functions.voxels import MorphometryError


def VOLUME_SCHEMA(kind: pa.DataType) -> pa.Schema:  # noqa: N802
    return pa.schema([("specimen", kind), ("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32()), ("h_um", pa.float64()), ("bone", pa.binary()), ("roi", pa.binary())])


def pack(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpack(data: bytes, shape: tuple[int, int, int]) -> np.ndarray:
    n = int(np.prod(shape))
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool).reshape(shape)


Kernel = Callable[[np.ndarray, np.ndarray, float], "dict | list[dict]"]


def per_specimen(volumes: DataFrame, kernel: Kernel, schema: str, on_error: str = "keep") -> DataFrame:
    """Rows that ``kernel(bone, roi, h)`` gives for each volume, with the specimen.

    on_error: ``keep`` gives a row with status FAIL and the error; ``omit`` leaves the specimen
    out; ``raise`` fails the job. A missing region is the whole image. Where volumes have a column
    ``problem``, rows with one fail with it.
    """
    kind = volumes.schema["specimen"].dataType.simpleString()
    ddl = f"specimen {kind}, {schema}" + (", status string, error string" if on_error == "keep" else "")
    target = to_arrow_schema(StructType.fromDDL(ddl))
    names = ["specimen", "width", "height", "depth", "h_um", "bone", "roi", *(["problem"] if "problem" in volumes.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n) for n in names}
            for i in range(b.num_rows):
                v = {n: c[i].as_py() for n, c in cols.items()}
                shape = (v["depth"], v["height"], v["width"])
                try:
                    if v.get("problem") is not None:
                        raise MorphometryError(v["problem"])
                    bone = unpack(v["bone"], shape)
                    roi = unpack(v["roi"], shape) if v["roi"] is not None else np.ones(shape, bool)
                    found = kernel(bone, roi, v["h_um"])
                    rows = [r | {"status": "OK", "error": None} for r in (found if isinstance(found, list) else [found])]
                except MorphometryError as why:
                    if on_error == "raise":
                        raise
                    rows = [{"status": "FAIL", "error": str(why)}] if on_error == "keep" else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v["specimen"] if f.name == "specimen" else _plain(r.get(f.name)) for r in rows], f.type) for f in target], schema=target)

    return volumes.select(*names).mapInArrow(run, ddl)


def _plain(v):
    return v.item() if isinstance(v, np.generic) else v.tolist() if isinstance(v, np.ndarray) else v


def check(volumes: DataFrame) -> DataFrame:
    """Volumes with their problems as a column: empty regions, a missing phase, bad spacing."""

    def kernel(bone: np.ndarray, roi: np.ndarray, h: float) -> dict:
        why = None
        if min(bone.shape) < 2:
            why = "every side needs two voxels"
        elif not (np.isfinite(h) and h > 0):
            why = "spacing must be finite and positive"
        elif not roi.any():
            why = "empty region"
        elif not (bone & roi).any() or not (~bone & roi).any():
            why = "the region needs both phases"
        return {"problem": why}

    return per_specimen(volumes, kernel, "problem string", "raise")


def voxels(volumes: DataFrame) -> DataFrame:
    """Voxel rows of volumes: specimen, x, y, z, bone, roi; only what lies in bone or region."""

    def kernel(bone: np.ndarray, roi: np.ndarray, h: float) -> list[dict]:
        return [{"z": z, "y": y, "x": x, "bone": bool(bone[z, y, x]), "roi": bool(roi[z, y, x])} for z, y, x in np.argwhere(bone | roi).tolist()]

    return per_specimen(volumes, kernel, "x int, y int, z int, bone boolean, roi boolean", "raise")


def slices(volumes: DataFrame) -> DataFrame:
    """One row for each z layer, for sinks and distribution of large volumes."""

    def kernel(bone: np.ndarray, roi: np.ndarray, h: float) -> list[dict]:
        return [{"z": z, "width": bone.shape[2], "height": bone.shape[1], "bone": pack(bone[z]), "roi": pack(roi[z])} for z in range(len(bone))]

    return per_specimen(volumes, kernel, "z int, width int, height int, bone binary, roi binary", "raise")


def from_slices(layers: DataFrame) -> DataFrame:
    """Volumes of layer rows (specimen, z, width, height, h_um, bone, roi). One aggregation by
    specimen; a layer is moved packed. Layers that are not 0, 1, 2 ... once each, or differ in size,
    fail the job: files of one name would make a volume that never was."""
    kind = layers.schema["specimen"].dataType
    arrow = to_arrow_schema(StructType().add("specimen", kind)).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v in b.to_pylist():
                parts = v["layers"]
                if [p["z"] for p in parts] != list(range(len(parts))) or not v["even"]:
                    raise ValueError(f"layers of {v['specimen']} are no volume")
                shape = (v["height"], v["width"])
                masks = {k: [np.unpackbits(np.frombuffer(p[k], np.uint8), count=shape[0] * shape[1]) for p in parts] for k in ("bone", "roi")}
                row = {"specimen": [v["specimen"]], "width": [shape[1]], "height": [shape[0]], "depth": [len(parts)], "h_um": [v["h_um"]]}
                row |= {k: [np.packbits(np.concatenate(m)).tobytes()] for k, m in masks.items()}
                yield pa.RecordBatch.from_pydict(row, schema=VOLUME_SCHEMA(arrow))

    held = layers.groupBy("specimen").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.first("h_um").alias("h_um"), (F.count_distinct("width", "height") == 1).alias("even"), F.sort_array(F.collect_list(F.struct("z", "bone", "roi"))).alias("layers"))
    return held.mapInArrow(run, f"specimen {kind.simpleString()}, width int, height int, depth int, h_um double, bone binary, roi binary")

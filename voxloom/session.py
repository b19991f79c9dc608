"""Session settings and run configuration."""

from __future__ import annotations

import math
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from voxloom.functions import intercepts

FAMILIES = ("paper", "skeleton", "mechanical", "soi", "orientation", "minkowski")
PRESETS = {"core": ("paper", "skeleton"), "manuscript": FAMILIES}
MODES = ("bonej", "standard", "classic", "refined", "experimental")


class ConfigError(ValueError):
    pass


def session(name: str = "voxloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are planned for. On a cluster the master,
    memory and checkpoint folder come from spark-submit."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=defaults | conf).getOrCreate()


@dataclass(frozen=True)
class Config:
    """Run options; ``check`` holds the rules between them."""

    binary_dir: str = ""
    roi_dir: str | None = None
    spacing_dir: str | None = None
    spacing_csv: str | None = None
    voxel_size: float | None = None
    subdirs: tuple[str, ...] = ()
    mode: str = "standard"
    advanced: bool = False
    descriptors: tuple[str, ...] = ()
    preset: str | None = None
    da_directions: int = intercepts.DIRECTIONS
    da_lines: int = intercepts.LINES
    da_increment: float = intercepts.INCREMENT
    da_repetitions: int = intercepts.REPETITIONS
    da_seed: int = intercepts.SEED
    ef_window_radius: int = 4
    curvature_sigma_um: float = 30.0
    threshold: int = 0
    strict_binary: bool = False
    continue_on_error: bool = False
    warnings: list[str] = field(default_factory=list, compare=False)

    def check(self) -> Config:
        def rule(ok: bool, why: str) -> None:
            if not ok:
                raise ConfigError(why)

        rule(self.mode in MODES, f"unknown mode {self.mode}")
        rule(sum(x is not None for x in (self.spacing_csv, self.spacing_dir, self.voxel_size)) <= 1, "name one source of voxel spacing")
        rule(self.voxel_size is None or (math.isfinite(self.voxel_size) and self.voxel_size > 0), "voxel size must be finite and positive")
        rule(self.mode not in ("bonej", "standard") or self.roi_dir is not None, f"mode {self.mode} needs regions of interest")
        rule(not self.advanced or self.mode == "standard", "advanced columns belong to the standard mode")
        rule(not (self.descriptors or self.preset) or self.mode == "standard", "descriptor families belong to the standard mode")
        rule(not (self.advanced and (self.descriptors or self.preset)), "advanced columns and descriptor families exclude each other")
        rule(not (self.descriptors and self.preset), "name descriptors or a preset")
        rule(self.preset is None or self.preset in PRESETS, f"unknown preset {self.preset}")
        rule(all(f in FAMILIES for f in self.descriptors), "unknown descriptor family")
        rule(self.da_directions >= 9 and self.da_lines > 0 and self.da_repetitions > 0, "too few directions, lines or repetitions")
        rule(math.isfinite(self.da_increment) and self.da_increment >= math.sqrt(3) - 1e-12, "the increment must be at least the voxel diagonal")
        rule(self.ef_window_radius >= 1, "the window radius must be at least 1")
        rule(math.isfinite(self.curvature_sigma_um) and self.curvature_sigma_um > 0, "sigma must be finite and positive")
        if self.advanced and not 20 <= self.curvature_sigma_um <= 40:
            self.warnings.append("curvature is calibrated for sigma of 20 to 40 micrometres")
        return self

    @property
    def families(self) -> tuple[str, ...]:
        """Requested families in order, each once."""
        return tuple(dict.fromkeys(self.descriptors or PRESETS.get(self.preset, ())))

    @property
    def strict(self) -> bool:
        """Samples must be 0 or 255: always in the modes that compare with other tools."""
        return self.strict_binary or self.mode in ("bonej", "standard")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master
    gets a folder of its own, any other an error: executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="voxloom-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps start from there."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

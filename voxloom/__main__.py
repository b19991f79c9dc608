"""Command line: ``python -m voxloom --binary-dir ... --roi-dir ... --output ...``."""

from __future__ import annotations

import argparse

from voxloom import session
from voxloom.functions import intercepts
from voxloom.operators.report import CATALOGUE
from voxloom.plans.job import run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxloom")
    a = p.add_argument
    a("--list-descriptors", action="store_true")
    a("--binary-dir", default="")
    a("--roi-dir")
    a("--spacing-dir", "--original-dir")
    a("--spacing-csv")
    a("--voxel-size", type=float)
    a("--subdirs", default="")
    a("--output", default="morphometry.csv")
    a("--feature-mode", default="standard", choices=session.MODES)
    a("--advanced", action="store_true")
    a("--descriptors", default="")
    a("--preset", choices=sorted(session.PRESETS))
    a("--da-directions", type=int, default=intercepts.DIRECTIONS)
    a("--da-lines", type=int, default=intercepts.LINES)
    a("--da-sampling-increment", type=float, default=intercepts.INCREMENT)
    a("--da-repetitions", type=int, default=intercepts.REPETITIONS)
    a("--da-seed", type=int, default=intercepts.SEED)
    a("--ef-window-radius", type=int, default=4)
    a("--curvature-sigma-um", type=float, default=30.0)
    a("--threshold", type=int, default=0)
    a("--strict-binary", action="store_true")
    a("--threads", type=int, help="local threads; a cluster's cores come from spark-submit")
    a("--continue-on-error", action="store_true")
    return p


def config(o: argparse.Namespace) -> session.Config:
    words = lambda s: tuple(x.strip() for x in s.split(",") if x.strip())
    if o.threads is not None and o.threads < 1:
        raise session.ConfigError("threads must be at least 1")
    return session.Config(
        binary_dir=o.binary_dir, roi_dir=o.roi_dir, spacing_dir=o.spacing_dir, spacing_csv=o.spacing_csv, voxel_size=o.voxel_size, subdirs=words(o.subdirs),
        mode=o.feature_mode, advanced=o.advanced, descriptors=words(o.descriptors), preset=o.preset, da_directions=o.da_directions, da_lines=o.da_lines,
        da_increment=o.da_sampling_increment, da_repetitions=o.da_repetitions, da_seed=o.da_seed, ef_window_radius=o.ef_window_radius,
        curvature_sigma_um=o.curvature_sigma_um, threshold=o.threshold, strict_binary=o.strict_binary, continue_on_error=o.continue_on_error,
    ).check()


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    if o.list_descriptors:
        for name, what in CATALOGUE:
            print(f"{name:12} {what}")
        return
    cfg = config(o)
    for w in cfg.warnings:
        print("warning:", w)
    spark = session.session(master=f"local[{o.threads}]" if o.threads else None)
    run(spark, cfg, o.output)


if __name__ == "__main__":
    main()

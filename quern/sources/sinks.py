"""Result files of a run: tables as CSV, parameters and statistics as text."""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame

from quern.functions.geometry import Transform
from quern.operators import agreement
from quern.operators.viewer import common_columns
from quern.operators.workflow import Alignment, Outcome


def write_table(df: DataFrame, path: str | Path, single: bool = True) -> bool:
    """Only if there are rows; single: one part file, for tables that people read."""
    if df.limit(1).count() == 0:
        return False
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(str(path), header=True, nullValue="NA")
    return True


def transform_text(t: Transform, rms: float | None = None) -> str:
    lines = [f"Scale: {round(t.scale, 6)}", f"Rotation: {round(t.rotation_deg, 4)}", f"tx: {round(t.tx, 4)}", f"ty: {round(t.ty, 4)}", f"Reflected: {str(t.reflected).upper()}"]
    lines += ["Matrix: " + " ".join(f"{v:.8f}" for v in row) for row in t.matrix]
    return "\n".join(lines + ([f"ICP RMS: {round(rms, 4)}"] if rms is not None else [])) + "\n"


def statistics_text(stats: DataFrame) -> str:
    r = stats.first().asDict()
    out = []
    for k, v in r.items():
        out.append(f"{k}: {100 * v:.1f}%" if k.endswith("rate") else f"{k}: {v:.3f}" if isinstance(v, float) else f"{k}: {v}")
    return "\n".join(out) + "\n"


def export(run_dir: Path, tables: dict[str, DataFrame], transform: Transform | None = None, rms: float | None = None, stats: DataFrame | None = None) -> list[str]:
    done = [name for name, df in tables.items() if write_table(df, run_dir / f"{name}.csv")]
    if transform is not None:
        (run_dir / "transform_params.txt").write_text(transform_text(transform, rms))
    if stats is not None:
        (run_dir / "match_statistics.txt").write_text(statistics_text(stats))
    return done


#: Columns of the coordinate join's quality table, as far as there are such columns. Fixed values.
COORD_QUALITY = ["particle_id", "x_um", "y_um", "coord_match_cost", "coord_source", "material", "quality", "feret_max_um"]


def log_to(stream=sys.stderr) -> logging.Logger:
    """The engine's log as "[time] [level] message"."""
    log = logging.getLogger("quern")
    handler = logging.StreamHandler(stream)
    handler.setFormatter(logging.Formatter("[%(asctime)s] [%(levelname)s] %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    return log


def third_transform_text(a: Alignment) -> str:
    t = a.transform
    rows = {"scale": round(t.scale, 6), "rotation_deg": round(t.rotation_deg, 4), "tx": round(t.tx, 4), "ty": round(t.ty, 4), "reflected": str(t.reflected).upper(), "icp_converged": str(a.converged).upper(), "icp_final_rms": f"{round(a.rms, 4)} um"}
    return "# LDIR-to-Raman Transform Parameters\n" + "".join(f"{k}: {v}\n" for k, v in rows.items())


def distortion_text(distortion: DataFrame) -> str:
    r = distortion.first()
    told = {"systematic_distortion": str(r.assessment in ("Distortion", "Recommended")).upper(), "recommend_tps": str(r.assessment == "Recommended").upper(), "dx_range_um": r.dx_range, "dy_range_um": r.dy_range, "assessment": r.assessment}
    return "# TPS (Thin-Plate Spline) Assessment\n" + "".join(f"{k}: {v}\n" for k, v in told.items())


def export_third(run_dir: Path, found: Outcome, ldir: DataFrame, with_places: DataFrame | None = None, extracted: DataFrame | None = None) -> list[str]:
    """The third instrument's files, each only if it has rows."""
    tables = {"ldir_material_distribution": agreement.distribution(ldir).withColumnRenamed("n", "count")}
    if found.third_match is not None:
        tables |= {"ldir_raman_matched": found.third_match.matched, "unmatched_ldir": found.third_match.unmatched_src}
        tables |= {"ldir_ftir_matched": found.third_src_match.matched, "triplets_3way": found.triplets, "ldir_raman_agreement": agreement.detail(found.third_graded)}
        (run_dir / "ldir_transform_params.txt").write_text(third_transform_text(found.third))
    if with_places is not None and "coord_match_cost" in with_places.columns:
        tables["ldir_coord_quality"] = with_places.select(*common_columns(COORD_QUALITY, with_places))
    if extracted is not None:
        tables["ldir_image_extracted"] = extracted
    return [name for name, df in tables.items() if write_table(df, run_dir / f"{name}.csv")]


def export_outcome(run_dir: Path, found: Outcome, ldir: DataFrame | None = None, **third: DataFrame) -> list[str]:
    """Everything that a run gives: matches, agreement, triage, composites, distortion, plot data, the third instrument."""
    m = found.match
    graded = found.graded.withColumn("match_id", found.graded["src_idx"])
    tables = {"matched_particles": m.matched, "unmatched_ftir": m.unmatched_src, "unmatched_raman": m.unmatched_ref, "agreement_summary": agreement.detail(graded), "agreement_pairwise": graded, "agreement_by_category": agreement.by_category(graded)}
    tables |= {"triage": agreement.triage(graded), "composite_matches": found.composites, "tps_quadrant_residuals": found.quadrants}
    tables |= {f"plot_{k}": df for k, df in found.diagnostics.items()}
    done = export(run_dir, tables, found.alignment.transform, found.alignment.rms if found.alignment.history else None, m.stats)
    (run_dir / "tps_assessment.txt").write_text(distortion_text(found.distortion))
    return done + (export_third(run_dir, found, ldir, **third) if ldir is not None else [])

"""All tunables of the engine in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    hqi_threshold: float = 70.0
    ftir_quality: float = 0.0
    ldir_quality: float = 0.6
    min_size_um: float = 0.0
    normalize_scale: bool = False
    ftir_anchors: tuple[str, ...] = ("PET", "Polypro")
    raman_anchors: tuple[str, ...] = ("Polyethylene terephtalate", "Polypropylene")
    ldir_anchors: tuple[str, ...] = ("Polyethylene terephthalate", "Polypropylene", "Polycarbonate")
    anchor_min_size_um: float = 20.0
    scan_diameter_um: float = 13000.0
    landmark_min_size_um: float = 100.0
    landmark_fiber_aspect: float = 3.0
    landmark_fiber_min_um: float = 100.0
    landmark_min_count: int = 4
    landmark_inlier_ratio: float = 0.5
    landmark_residual_um: float = 50.0
    landmark_skip_full: bool = True
    coarse_step_deg: float = 1.0
    ransac_iterations: int = 2000
    ransac_sample: int = 3
    ransac_inlier_um: float = 200.0
    allow_mirror: bool = True
    icp_iterations: int = 100
    icp_tolerance: float = 0.01
    icp_max_pair_um: float = 500.0
    icp_reciprocal: bool = True
    icp_trim: float = 0.10
    icp_elongation: float = 0.5
    match_method: str = "optimal"
    match_threshold_um: float = 100.0
    match_size_fraction: float = 0.15
    match_size_weight: float = 0.2
    area_weight: float = 0.3
    feret_weight: float = 0.3
    aspect_weight: float = 0.1
    ambiguity_radius_um: float = 50.0
    ftir_map: dict[str, str] | None = field(default=None, hash=False)
    raman_map: dict[str, str] | None = field(default=None, hash=False)

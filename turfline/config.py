"""Thresholds of all operators, with their defaults and limits."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

BALL, GOALKEEPER, PLAYER, REFEREE = 0, 1, 2, 3
CLASS_IDS = {"ball": BALL, "goalkeeper": GOALKEEPER, "player": PLAYER, "referee": REFEREE}

# Defaults of every section.


@dataclass(frozen=True)
class IO:
    auto_letterbox: bool = True
    letterbox_threshold: float = 20.0
    crop_top: int = 0
    crop_bottom: int = 0
    crop_left: int = 0
    crop_right: int = 0
    frame_start: int = 0
    frame_stop: int | None = None
    frame_stride: int = 1

    def __post_init__(self) -> None:
        for name in ("crop_top", "crop_bottom", "crop_left", "crop_right"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative")


@dataclass(frozen=True)
class Detection:
    conf: float = 0.25
    ball_conf: float | None = None


@dataclass(frozen=True)
class Tracking:
    mask_margin_m: float = 1.0
    mask_margin_referee_m: float = 3.0
    min_conf: float = 0.1
    track_high_thresh: float = 0.5
    track_low_thresh: float = 0.1
    new_track_thresh: float = 0.6
    match_thresh: float = 0.8
    track_buffer: int = 30


@dataclass(frozen=True)
class TeamID:
    torso_top: float = 0.2
    torso_bottom: float = 0.5
    torso_width: float = 0.6
    min_kept_fraction: float = 0.35
    min_box_h_px: float = 24.0
    grass_hue_lo: float = 30.0
    grass_hue_hi: float = 90.0
    grass_sat_min: float = 50.0
    shadow_l_min: float = 20.0
    highlight_l_max: float = 250.0
    min_silhouette: float = 0.5
    reject_k_mad: float = 3.5
    min_reject_radius: float = 20.0
    min_samples_fit: int = 5
    min_track_frames_fit: int = 15
    min_samples_assign: int = 3
    min_margin: float = 1.25
    gk_zone_m: float = 20.0
    gk_zone_frac: float = 0.6
    max_goalkeepers: int = 2


@dataclass(frozen=True)
class Stitch:
    max_gap_s: float = 3.0
    v_max_ms: float = 9.0
    pos_sigma_m: float = 1.6
    w_pos: float = 1.0
    w_time: float = 0.2
    max_link_cost: float = 0.6
    roster_outfield: int = 11
    min_tracklet_s: float = 0.08
    velocity_window_s: float = 0.08
    role_trust_conf: float = 0.9
    w_role_mismatch: float = 0.2
    short_fragment_max_gap_s: float = 0.25
    overlap_tolerance_s: float = 0.1


@dataclass(frozen=True)
class Ball:
    roi_size: int = 640
    roi_conf: float = 0.1
    roi_max_coast: int = 45
    merge_dist_px: float = 20.0
    mask_margin_m: float = 6.0
    min_box_px: float = 4.0
    max_box_px: float = 40.0
    q_pos: float = 1.0
    q_vel: float = 0.5
    r_px: float = 5.0
    gate_chi2: float = 9.21
    max_gap: int = 60
    max_speed_px: float = 40.0
    miss_cost: float = 0.3
    conf_weight: float = 0.2
    speed_weight: float = 0.1
    max_interp_gap: int = 30
    airborne_window: int = 31
    airborne_min_frames: int = 18
    airborne_curvature_min: float = 0.05
    airborne_residual_px: float = 3.0
    airborne_speed_ms: float = 25.0
    airborne_max_hole: int = 5
    airborne_speed_max_dt: int = 3


@dataclass(frozen=True)
class Pitch:
    length: float = 105.0
    width: float = 68.0

    def __post_init__(self) -> None:
        if not (100 <= self.length <= 110 and 64 <= self.width <= 75):
            raise ValueError("a pitch is 100 to 110 m long and 64 to 75 m wide")


@dataclass(frozen=True)
class Possession:
    radius_m: float = 2.0
    acquire_frames: int = 12
    max_ball_speed_mps: float = 10.0
    max_unknown_s: float = 2.0


@dataclass(frozen=True)
class Projection:
    smooth_window: int = 15
    fps: float = 60.0
    scale_px_per_m: float = 10.0
    margin_px: int = 40


@dataclass(frozen=True)
class Calibration:
    ransac_thresh_px: float = 10.0
    min_inliers: int = 6
    max_reproj_px: float = 12.0
    max_propagated_frames: int = 240
    max_anchor_gap: int = 150
    min_inlier_ratio: float = 0.7
    end_zone_m: float = 11.0
    jitter_noise_px: float = 2.0


@dataclass(frozen=True)
class Config:
    io: IO = field(default_factory=IO)
    detection: Detection = field(default_factory=Detection)
    tracking: Tracking = field(default_factory=Tracking)
    team_id: TeamID = field(default_factory=TeamID)
    stitch: Stitch = field(default_factory=Stitch)
    ball: Ball = field(default_factory=Ball)
    pitch: Pitch = field(default_factory=Pitch)
    possession: Possession = field(default_factory=Possession)
    projection: Projection = field(default_factory=Projection)
    calibration: Calibration = field(default_factory=Calibration)


def from_mapping(values: dict | None) -> Config:
    """A config from nested mappings; what is left out keeps its default, unknown names are errors."""
    sections = {f.name: f.default_factory for f in fields(Config)}
    values = values or {}
    if unknown := set(values) - set(sections):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    return Config(**{name: sections[name](**(part or {})) for name, part in values.items()})


def from_yaml(path: str) -> Config:
    import yaml

    with open(path) as f:
        return from_mapping(yaml.safe_load(f))

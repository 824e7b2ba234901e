"""Every threshold in one place. Results must use these."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Validity and coverage
    valid_scl: tuple[int, ...] = (4, 5, 6, 7, 11)
    cloud_scl: tuple[int, ...] = (3, 8, 9, 10)
    snow_scl: int = 11
    min_coverage: float = 0.30
    min_overlap: float = 0.30
    # Registration by features
    features: int = 5000
    feature_matches: int = 15
    feature_ratio: float = 0.3
    feature_reach: float = 3.0
    # Radiometry
    pif_percentile: float = 0.20
    pif_slope: tuple[float, float] = (0.5, 2.0)
    pif_iterations: int = 2
    pif_tolerance: float = 1e-3
    pif_min_pixels: int = 1000
    pif_strips: int = 8
    strip_rows: int = 512
    # Detection
    min_magnitude: float = 0.03
    min_blob_px: int = 100
    near_dilations: tuple[int, ...] = (10, 5)
    large_dilations: tuple[int, ...] = (30, 20)
    group_min_blobs: int = 3
    group_min_px: int = 500
    group_max_extent: int = 500
    group_max_px: int = 250_000
    # Confidence
    w_alignment: float = 0.35
    w_cluster: float = 0.35
    w_terrain: float = 0.15
    w_coverage: float = 0.15
    terrain: float = 1.0
    same_tile_quality: float = 0.90
    candidate_coverage: float = 0.30
    stored_confidence: float = 0.3
    store_cap: int = 5000
    area_reserve: int = 500
    display_cap: int = 200
    # Seasons
    season_days: int = 30
    season_priors: int = 3
    season_min_valid: float = 0.5
    season_sample_px: int = 256
    season_sigmas: float = 2.0
    season_min_std: float = 0.05
    season_factor: float = 0.5
    unverified_factor: float = 0.85
    ndvi_drop: float = 0.15
    # Classes and directions
    ndvi_veg: float = 0.3
    ndvi_bare: float = 0.15
    growth: float = 1.2
    shrink: float = 0.8
    dndvi_direction: float = 0.05
    brightness_gain: float = 0.15
    search_boost: float = 0.2
    # Search
    match_percentile: float = 0.75
    match_cap: int = 50
    search_top_k: int = 10
    # Crops and display
    crop: int = 224
    crop_valid: float = 0.5
    display_factor: float = 4.0
    watch_cap: int = 500


P = Params()

CHANGE_TYPES = ("clearance", "construction", "revegetation", "urban_expansion", "vegetation_loss", "vegetation_retreat", "water_loss")
DIRECTIONS = ("appearance", "disappearance", "expansion", "contraction", "unclassified")
SEASONAL_TYPES = ("clearance", "vegetation_loss", "vegetation_retreat")
#: Words of a query that hint at a direction.
HINTS = {
    "appearance": ("new", "appeared", "built", "construction"),
    "disappearance": ("cleared", "removed", "demolished", "deforestation"),
    "expansion": ("growing", "expanding", "sprawl"),
    "contraction": ("shrinking", "retreating", "receding"),
}

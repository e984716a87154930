"""Settings of a selection, and the named variations that an evaluation compares."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SelectConfig:
    """Knobs of ``tessera.plans.select``; times are seconds from a sequence's start."""

    sample_fps: float = 1.0
    max_decoded_frames: int = 900
    long_edge_px: int = 1280
    blur_neighbor_ratio: float = 0.6
    blur_neighbor_window_sec: float = 3.0
    blur_global_floor_ratio: float = 0.05
    min_sharpness_lapvar: float = 8.0
    clipped_ratio_max: float = 0.30
    luma_range: tuple[float, float] = (0.06, 0.94)
    rescue_luma_below: float = 0.18
    rescue_clip_low_above: float = 0.12
    unrecoverable_luma_below: float = 0.015
    unrecoverable_clip_low_above: float = 0.65
    scene_similarity_threshold: float | None = None
    duplicate_shot_threshold: float | None = None
    min_shot_gap_sec: float = 1.5
    max_shot_cut_rate: float = 0.25
    max_keyframes: int = 16
    selection_strategy: str = "diverse"
    text_nms_gap_ratio: float = 0.5
    text_weight: float = 0.35
    enhance: bool = True
    enhance_textness_drop_limit: float = 0.03
    jpeg_quality: int = 92

    def __post_init__(self) -> None:
        if self.selection_strategy not in ("diverse", "text_nms"):
            raise ValueError(f"selection_strategy is {self.selection_strategy!r}; it is diverse or text_nms")
        for name in ("sample_fps", "max_decoded_frames", "long_edge_px", "max_keyframes", "blur_neighbor_window_sec"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        for name in ("clipped_ratio_max", "max_shot_cut_rate", "text_weight", "rescue_luma_below", "rescue_clip_low_above"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in 0..1")
        low, high = self.luma_range
        if not 0 <= low < high <= 1:
            raise ValueError("luma_range must rise within 0..1")

    def bound_to(self, scene: float, duplicate: float) -> SelectConfig:
        """The thresholds of an embedder where none are set."""
        return replace(
            self,
            scene_similarity_threshold=scene if self.scene_similarity_threshold is None else self.scene_similarity_threshold,
            duplicate_shot_threshold=duplicate if self.duplicate_shot_threshold is None else self.duplicate_shot_threshold,
        )


#: Scene and duplicate thresholds of the embedders by name.
EMBEDDER_THRESHOLDS = {"perceptual": (0.88, 0.95), "dinov3": (0.97, 0.97)}


def ablations(base: SelectConfig) -> dict[str, SelectConfig]:
    """Variations by label."""
    return {
        "full": base,
        "no-enhance": replace(base, enhance=False),
        "no-rescue": replace(base, rescue_luma_below=0.0, rescue_clip_low_above=1.0),
        "text-det": replace(base, selection_strategy="text_nms"),
        "no-dedup": replace(base, scene_similarity_threshold=1.0, duplicate_shot_threshold=1.0, max_keyframes=200),
    }

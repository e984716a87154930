"""Scores and predicates of a row as Column expressions; none leaves whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import SelectConfig


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def readability(m: dict[str, Column], reference: Column, text_weight: float = 0.35) -> Column:
    """Weighted legibility of a frame in 0..1 from its metrics and the reference sharpness of its stratum."""
    sharp = clip(m["lapvar"] / F.greatest(reference, F.lit(1e-6)))
    exposure = clip(1 - 2 * F.abs(m["luma"] - 0.5))
    contrast = clip(m["rms"] / 0.25)
    colour = clip(m["colorfulness"] / 60.0)
    lost = clip(m["clip_low"] + m["clip_high"])
    base = 0.40 * sharp + 0.20 * exposure + 0.15 * contrast + 0.10 * colour - 0.15 * lost - 0.10 * clip(m["noise"] / 12.0)
    return clip((1 - text_weight) * base + text_weight * m["textness"])


def needs_rescue(luma: Column, clip_low: Column, cfg: SelectConfig) -> Column:
    """Dark, but not beyond recovery."""
    beyond = (luma < cfg.unrecoverable_luma_below) | (clip_low > cfg.unrecoverable_clip_low_above)
    return F.when(beyond, False).otherwise((luma < cfg.rescue_luma_below) | (clip_low >= cfg.rescue_clip_low_above))


def effective(raw: Column, rescued: Column) -> Column:
    return F.coalesce(rescued, raw)


def reject_reason(luma: Column, clip_low: Column, clip_high: Column, lapvar: Column, cut: Column, cfg: SelectConfig) -> Column:
    """The first test that a frame fails, or null if it is kept."""
    low, high = cfg.luma_range
    return (
        F.when((clip_low > cfg.clipped_ratio_max) | (luma < low), "underexposed")
        .when((clip_high > cfg.clipped_ratio_max) | (luma > high), "overexposed")
        .when((lapvar < cfg.min_sharpness_lapvar) | (lapvar < cut), "blur")
    )


def reject_detail(reason: Column, luma: Column, clip_low: Column, clip_high: Column, lapvar: Column, cut: Column, rescued: Column) -> Column:
    """What a test saw: the measures, and for blur the stratum that the cut comes from."""
    stratum = F.when(rescued, "rescued").otherwise("normal")
    return (
        F.when(reason == "underexposed", F.format_string("luma=%.3f clip_low=%.3f", luma, clip_low))
        .when(reason == "overexposed", F.format_string("luma=%.3f clip_high=%.3f", luma, clip_high))
        .when(reason == "blur", F.format_string("lapvar=%.2f cut=%.2f (%s)", lapvar, cut, stratum))
    )


def keeps_enhanced(candidate: Column, reference: Column, limit: Column | float) -> Column:
    """Whether an enhanced image may replace its original: its text score has not dropped by more than the limit."""
    return candidate >= reference - limit


def gamma_for(mean: Column, target: float = 0.48, low: float = 0.45, high: float = 2.2) -> Column:
    """The exponent that moves a mean luma to the target; 1 where nothing can or need be done."""
    g = clip(F.log(F.lit(target)) / F.log(mean), low, high)
    return F.when((mean <= 1e-4) | (mean >= 1 - 1e-4) | (F.abs(g - 1) < 0.02), 1.0).otherwise(g)


def textness(area_ratio: Column, regions: Column, alignment: Column) -> Column:
    """Text saliency from the share of area that regions cover, their number and how well they align."""
    return clip(0.5 * clip(area_ratio / 0.35) + 0.2 * clip(regions / 120.0) + 0.3 * alignment)


def passes_geometry(w: Column, h: Column, frame_area: Column) -> Column:
    """Whether a region may be a letter."""
    sized = (w > 0) & (h > 0) & F.when(h != 0, (w / h).between(0.08, 12)).otherwise(False)
    return sized & h.between(8, 400) & (w * h >= 40) & (w * h <= 0.20 * frame_area)


def scaled_size(width: Column, height: Column, long_edge: int) -> tuple[Column, Column]:
    """Width and height with the longer edge at most ``long_edge``, never larger, and even."""
    top = F.greatest(width, height)
    ratio = F.least(F.lit(1.0), F.lit(long_edge) / top)
    even = lambda x: (F.floor(x * ratio / 2) * 2).cast("int")
    return F.when(top <= long_edge, width).otherwise(even(width)), F.when(top <= long_edge, height).otherwise(even(height))


def nms_gap(total: Column, budget: int, ratio: float = 0.5) -> Column:
    """Frames that must lie between picks: a share of the even spacing of all samples."""
    return F.when((F.lit(budget) <= 0) | (total <= 0), 0).otherwise(F.floor(F.lit(ratio) * total / budget)).cast("int")


def random_hit(n: Column, m: Column, k: int) -> Column:
    """Chance that ``k`` of ``n`` samples drawn without return hold one of ``m``."""
    miss = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(k), n.cast("int")) - 1), F.lit(1.0), lambda p, i: p * F.greatest(n - m - i, F.lit(0)) / (n - i))
    return F.when((n <= 0) | (m <= 0) | F.lit(k <= 0), 0.0).otherwise(1 - miss)

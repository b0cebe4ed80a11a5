"""Tunables of the rating and ranking jobs, and the user filters that bend them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

DAYS_PER_MONTH = 30.44
DAYS_PER_YEAR = 365.25

# K multiplier by finish method.
FINISH_MULTIPLIERS = {"KO/TKO": 1.4, "SUB": 1.35, "U-DEC": 1.0, "M-DEC": 0.9, "S-DEC": 0.8}

# Fixed values: (rating, display score) anchors, linear in between, clamped outside.
DISPLAY_ANCHORS = (
    (1427, 25), (1500, 42), (1560, 62), (1610, 80),
    (1645, 91), (1680, 97), (1715, 99), (1760, 100),
)

# Seed score by external rank.
EXTERNAL_RANK_SCORES = {
    "C": 100, "1": 90, "2": 85, "3": 85, "4": 78, "5": 78, "6": 78,
    "7": 70, "8": 70, "9": 70, "10": 70,
    "11": 62, "12": 62, "13": 62, "14": 62, "15": 62,
}

# Division -> (gender, weight ordinal, short code).
DIVISIONS = {
    "Flyweight": ("Male", 1, "FLW"),
    "Bantamweight": ("Male", 2, "BW"),
    "Featherweight": ("Male", 3, "FW"),
    "Lightweight": ("Male", 4, "LW"),
    "Welterweight": ("Male", 5, "WW"),
    "Middleweight": ("Male", 6, "MW"),
    "Light Heavyweight": ("Male", 7, "LHW"),
    "Heavyweight": ("Male", 8, "HW"),
    "Women's Strawweight": ("Female", 1, "WSW"),
    "Women's Flyweight": ("Female", 2, "WFLW"),
    "Women's Bantamweight": ("Female", 3, "WBW"),
}

# Credit multiplier by organisation tier.
TIER_MULTIPLIERS = {
    "tier1": 1.0, "tier2": 0.78, "tier2_5": 0.68, "tier3": 0.55, "tier4": 0.35, "historical": 0.68,
}


@dataclass(frozen=True)
class EngineConfig:
    """Everything the chronological rating sweep reads."""

    initial_rating: float = 1500.0
    base_k: float = 24.0
    provisional_contests: int = 5
    provisional_multiplier: float = 1.5
    retention_per_year: float = 0.92
    grace_months: float = 12.0
    boundary_years: float | None = 5.0
    boundary_regression: float = 0.5
    move_penalty: float = 0.10
    finish_spread: float = 1.0
    era_start_year: int | None = None
    half_life_months: float = 15.0
    finish_multipliers: dict = field(default_factory=lambda: dict(FINISH_MULTIPLIERS))

    def finish_factor(self, method: str) -> float:
        """Spread stretches or shrinks every multiplier's distance from 1."""
        return 1.0 + (self.finish_multipliers[method] - 1.0) * self.finish_spread


@dataclass(frozen=True)
class FilterParams:
    """The four user filters; 0.5 on a weight is neutral."""

    era_start_year: int | None = None
    finish_weight: float = 0.5
    recency_weight: float = 0.5
    activity_weight: float = 0.5

    def engine(self, base: EngineConfig | None = None) -> EngineConfig:
        base = base or EngineConfig()
        if self == FilterParams():
            return base
        return replace(
            base,
            finish_spread=base.finish_spread * (self.finish_weight / 0.5),
            base_k=base.base_k * (0.6 + 0.8 * self.recency_weight),
            half_life_months=_clamp(base.half_life_months * (1.5 - self.recency_weight), 3, 36),
            retention_per_year=_clamp(
                base.retention_per_year - (self.activity_weight - 0.5) * 0.4, 0.5, 0.99),
            era_start_year=self.era_start_year,
        )

    @staticmethod
    def parse(params: dict[str, str]) -> "FilterParams":
        """Lenient request parameters: bad numbers fall back, weights are clamped to [0, 1]."""
        era = params.get("era")
        return FilterParams(
            era_start_year=_int_prefix(era) if era and era != "all" else None,
            finish_weight=_clamp(_number(params.get("finish")), 0, 1),
            recency_weight=_clamp(_number(params.get("recency")), 0, 1),
            activity_weight=_clamp(_number(params.get("activity")), 0, 1),
        )


def _clamp(value, low, high):
    return max(low, min(high, value))


def _number(text, fallback=0.5):
    try:
        value = float(text)
    except (TypeError, ValueError):
        return fallback
    return value if value == value and abs(value) != float("inf") else fallback


def _int_prefix(text):
    digits = ""
    for ch in text.strip():
        if not ch.isdigit():
            break
        digits += ch
    return int(digits) if digits else None


@dataclass(frozen=True)
class RankingConfig:
    """Bounded adjustments and reorder rules layered on the ratings."""

    cutoff_months: float = 48.0
    min_contests: int = 3
    depth: int = 40
    # schedule nudge
    schedule_years: float = 3.0
    schedule_anchor: float = 1500.0
    schedule_slope: float = 0.05
    schedule_cap: float = 30.0
    # metrics composite
    metrics_scale: float = 30.0
    metrics_recent: int = 5
    metrics_confidence: int = 5
    w_volume: float = 0.40
    w_accuracy: float = 0.20
    w_knockdown: float = 0.20
    w_takedown: float = 0.20
    n_volume: float = 40.0
    n_accuracy: float = 0.25
    n_knockdown: float = 1.5
    n_takedown: float = 3.0
    # schedule activity (display only)
    activity_grace: float = 12.0
    activity_decay: float = 33.0
    activity_floor: float = 0.7
    activity_target: float = 2.0
    activity_cadence: float = 0.3
    # external ranking seed
    external_scale: float = 0.4
    floor_champion: int = 2
    floor_top5: int = 8
    floor_top15: int = 25
    floor_streak: int = 2
    champion_band: float = 8.0
    # head to head
    h2h_months: float = 18.0
    h2h_gap: float = 50.0
    # pedigree
    pedigree_full: int = 5
    pedigree_cap: float = 0.75
    pedigree_max: float = 25.0
    pedigree_taper: int = 6


# The tuning grid, one line per knob.
SEARCH_GRID = {
    "base_k": (12, 18, 24, 32, 40, 50),
    "provisional_contests": (3, 5, 8, 10),
    "provisional_multiplier": (1.0, 1.25, 1.5, 2.0),
    "retention_per_year": (0.8, 0.86, 0.92, 0.96, 1.0),
    "move_penalty": (0, 0.1, 0.2, 0.3),
    "finish_spread": (0, 0.5, 1.0, 1.5, 2.0),
}

"""Fixed business values and small frozen settings shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: these must equal the published rules for right results -----
MONTH_NUMBERS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3,
    "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "september": 9, "oct": 10, "october": 10,
    "nov": 11, "november": 11, "dec": 12, "december": 12,
}
MONTH_ABBREVIATIONS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

EXACT_ANCHOR_METHODS = (
    "dealer_wholesale_exact",
    "dealer_wholesale_volume_resolved",
    "dealer_wholesale_variant_alias",
    "source_brand_kus",
)

ROLE_PATTERNS = {
    "date": ["date", "yyyymm", "invoice dt", "ivc dt", "month", "period",
             "deliminated date", "delimited date"],
    "brand": ["brand", "cmp knd", "company kind", "make"],
    "model": ["model", "seri", "series", "vehicle model"],
    "model_year": ["model year", "mdl yy", "year"],
    "part_number": ["part number", "part no", "pno", "sku", "item"],
    "part_description": ["part description", "description", "desc"],
    "plc": ["plc", "product list catalog"],
    "installation_quantity": ["inst qt", "installation quantity", "install qty",
                              "quantity", "qty", "units", "volume"],
    "revenue": ["revenue", "sales revenue", "sales", "amount", "price", "cfm pri", "value"],
}

BUSINESS_HEADER_SIGNALS = (
    "pis mst ivc dt", "pis cmp knd", "pis seri", "pis mdl yy", "pis pno",
    "sumofpis inst qt", "sumofpis crp cfm pri", "model", "part description",
)
DATE_HINTS = ("date", "dt", "yyyymm", "month", "period")
NUMERIC_HINTS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov",
                 "dec", "total", "qty", "quantity", "revenue", "sales", "amount", "volume")
HEADERISH_TOKENS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov",
                    "dec", "model", "brand", "total")

#: What counts for and against a candidate header, and the share of columns that makes a leading label a prefix.
HEADER_WEIGHTS = {"named": 4.0, "distinct": 3.0, "filled": 2.0, "numbers": 2.0, "headerish": 3.0, "numeric_name": 5.0, "step": 0.05}
PREFIX_SHARE = 0.7

#: Governed method of each anchor.
ANCHOR_METHODS = {"HMA": "tuned_smoothing", "GMA": "naive_last", "KUS": "working_day_adjusted_seasonal"}

# name, months of history needed, family
BASELINE_MODELS = (
    ("naive_last", 2, "baseline"),
    ("mean", 2, "baseline"),
    ("weighted_moving_average", 3, "recent"),
    ("trailing_12_mean", 12, "recent"),
    ("trend_adjusted_moving_average", 6, "trend"),
    ("damped_trend", 6, "trend"),
    ("log_linear_trend", 6, "trend"),
    ("seasonal_naive", 18, "seasonal"),
    ("seasonal_mean", 18, "seasonal"),
    ("ets_additive", 24, "seasonal"),
    ("croston_sba", 8, "intermittent"),
)
MODEL_COMPLEXITY = {
    "naive_last": 1, "mean": 1, "weighted_moving_average": 2, "trailing_12_mean": 2,
    "seasonal_naive": 2, "seasonal_mean": 3, "trend_adjusted_moving_average": 3,
    "damped_trend": 3, "log_linear_trend": 3, "croston_sba": 3, "ets_additive": 4, "auto": 5,
}
REGIME_PENALTY = {"stable": 0.0, "declining": 4.0, "accelerating": 4.0, "volatile": 7.0,
                  "structural_drop": 18.0, "structural_ramp": 16.0, "sparse_history": 15.0}
REGIME_PRIORITY = {"structural_drop": 0.45, "structural_ramp": 0.4, "declining": 0.22,
                   "accelerating": 0.2, "volatile": 0.18, "sparse_history": 0.16, "stable": 0.0}
# --- end of fixed values -------------------------------------------------------


# --- fixed values: the policy of anchors ---
@dataclass(frozen=True)
class AnchorPolicy:
    """How a company label becomes one of the governed anchors."""

    anchors: tuple[str, ...] = ("HMA", "GMA", "KUS")
    # ordered (anchor, words looked for in the label, source letter that also decides)
    keyword_rules: tuple[tuple[str, tuple[str, ...], str], ...] = (
        ("KUS", ("KUS", "KIA"), "K"),
        ("GMA", ("GMA", "GENESIS"), ""),
        ("HMA", ("HMA", "HYUNDAI"), ""),
    )
    prefix_anchor: str = "GMA"
    prefixes: tuple[str, ...] = ("G70", "G80", "G90", "GV60", "GV70", "GV80")
    letter_rules: tuple[tuple[str, str], ...] = (("H", "HMA"),)
    fallback_letter: str = "K"
    fallback_letter_anchor: str = "KUS"
    default_anchor: str = "HMA"
    letter_method: str = "source_brand_kus"
    prefix_method: str = "genesis_name_fallback"
    default_method: str = "hma_default_fallback"
# --- end of fixed values ---


@dataclass(frozen=True)
class BacktestContract:
    """Rolling-origin comparison contract."""

    minimum_training_months: int = 24
    horizons: tuple[int, ...] = (1, 2, 3)
    tie_band_wape: float = 0.005

    def __post_init__(self) -> None:
        if self.minimum_training_months < 2:
            raise ValueError("minimum_training_months must be at least 2")
        if not self.horizons or min(self.horizons) < 1:
            raise ValueError("horizons must contain positive integers")

    def expected_counts(self, months: int) -> dict[str, int]:
        out = {str(h): max(0, months - self.minimum_training_months - h + 1) for h in self.horizons}
        out["combined"] = sum(out.values())
        return out


@dataclass(frozen=True)
class BasketPolicy:
    """Which sales may be served by fleet vehicles, and since when."""

    anchor: str = "KUS"
    effective_month: str = "2026-06"
    eligible_plc: str = "Carpet Floor Mat"
    eligible_model_year: str = "2027"


@dataclass(frozen=True)
class Roles:
    """Business role -> column name of a sales table."""

    date: str = "sale_date"
    brand: str = "brand"
    model: str = "model_name"
    model_code: str = "model_code"
    model_year: str = "model_year"
    part_number: str = "part_number"
    part_description: str = "part_description"
    plc: str = "plc"
    quantity: str = "quantity"
    revenue: str = "revenue"

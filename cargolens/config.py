"""Analysis parameters.

Everything that shapes a result and is not data lives here, so a query is a
function of (tables, config). Values marked *fixed* must equal the
reference's for the results to agree; the rest are ours.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's):
#   analysis window            [2017-01-01, 2018-09-01), 20 complete months
#   year-on-year               months 1-8 of 2018 vs 2017
#   extra translations         pc_gamer -> pc_gaming,
#                              portateis_cozinha_e_preparadores_de_alimentos
#                                -> portable_kitchen_food_processors
#   size tiers (grams)         <=500 small, <=2000 medium, <=10000 large,
#                              else extra_large, NULL weight unknown
#   minimum group sizes        100 items (freight ratio), 50 orders
#                              (state / seller state / category / review
#                              state), 30 orders (multi-factor)
#   Pareto cut                 80 %
#   high-freight cut           freight_pct > 30
#   freight risk colours       > 50 and > 30
#   state late-rate colours    > 12 and > 8 (percent)
#   anomalous payment          value = 0 or type 'not_defined'
#   delay bands (SQL 3.6)      -10, -5, 0, 0, 5, 10
#   delay bands (SQL 4.3)      -7, -3, 0, 0, 3, 7
#   delay bins (notebook)      -999, -10, -5, -3, 0, 3, 5, 10, 999, right-closed
#   description length bins    0, 200, 500, 1000, 10000, right-closed
#   histogram bins             50 (delivery, delay), 40 (estimated vs actual)
# ---------------------------------------------------------------------------

REFERENCE_EXTRA_TRANSLATIONS: tuple[tuple[str, str], ...] = (
    ("pc_gamer", "pc_gaming"),
    ("portateis_cozinha_e_preparadores_de_alimentos", "portable_kitchen_food_processors"),
)


@dataclass(frozen=True)
class Config:
    window_start: dt.datetime = dt.datetime(2017, 1, 1)
    window_end: dt.datetime = dt.datetime(2018, 9, 1)  # exclusive
    yoy_current_year: int = 2018
    yoy_previous_year: int = 2017
    yoy_last_month: int = 8
    extra_translations: tuple[tuple[str, str], ...] = REFERENCE_EXTRA_TRANSLATIONS

    min_items_freight_ratio: int = 100
    min_orders_group: int = 50
    min_orders_multi_factor: int = 30

    pareto_cut_pct: float = 80.0
    high_freight_pct: float = 30.0
    freight_risk_high_pct: float = 50.0
    state_late_red_pct: float = 12.0
    state_late_orange_pct: float = 8.0

    top_states: int = 10
    top_categories: int = 20
    top_trend_categories: int = 5
    bottom_categories: int = 15
    top_freight_risk: int = 15
    top_multi_review_orders: int = 10

    delivery_hist_bins: int = 50
    buffer_hist_bins: int = 40

    # README-only analyses (definitions marked as ours in SURVEY 2.6)
    earth_radius_km: float = 6371.0
    distance_edges_km: tuple[float, ...] = (100.0, 500.0, 1000.0, 2000.0)
    weight_band_edges_g: tuple[float, ...] = (500.0, 2000.0, 5000.0)
    seller_tier_edges: tuple[int, ...] = (10, 100)
    slowest_seller_share: float = 0.10
    top_state_share_n: int = 5
    whatif_extra_days: int = 3
    whatif_min_km: float = 1000.0
    handoff_hours: tuple[int, ...] = (24, 36, 48)

    # Exact percentiles rank distinct values by value range (bounded tasks,
    # two passes); percentile_approx is one sketch pass (accuracy below).
    exact_percentiles: bool = True
    approx_accuracy: int = 10000
    # Key profiles (distinct counts) may use approx_count_distinct at scale.
    approx_key_profiles: bool = False

    extra: dict = field(default_factory=dict, compare=False, hash=False)


def driver_config() -> Config:
    """Config for the driver's TPC-H-shaped tables (FIXTURES.md §3).

    Those orders span 1995-2001, so the 20-month window moves to
    [1997-01-01, 1998-09-01) and year on year compares 1998 with 1997. The two
    extra translations are the two brands the adapter leaves out of the
    translation table, so the fix has work to do.
    """
    from .sources.adapter import UNTRANSLATED_BRANDS

    return Config(
        window_start=dt.datetime(1997, 1, 1),
        window_end=dt.datetime(1998, 9, 1),
        yoy_current_year=1998,
        yoy_previous_year=1997,
        extra_translations=tuple((b, b.lower()) for b in UNTRANSLATED_BRANDS),
    )

"""Settings, in one group for each step that reads them.

Every operator takes its group as an argument. Nothing is sampled, capped or
left out by default; ``Sampling`` and ``Masking.pool_rows`` do so when set.
"""
from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

# --- column roles -----------------------------------------------------------
NUMERIC = ["risk_score", "dti", "emp_length_yrs", "amount_requested"]
CATEGORICAL = ["state"]
CONTEXT = ["zip3", "app_year"]
FEATURES = NUMERIC + CATEGORICAL

# --- fixed values: plausibility windows, a value outside is treated as missing
SCORE_WINDOW = (300.0, 900.0)
DTI_WINDOW = (0.0, 100.0)
AMOUNT_WINDOW = (500.0, 40000.0)

# --- method names -----------------------------------------------------------
METHODS = ["parcelling", "fuzzy", "ipw", "heckman"]
NO_CORRECTION = "none (biased baseline)"

# --- fixed values: numbers of the published study. Results are compared with
# its tables, so these defaults have to be its own.
STUDY_SEED = 20260901
STUDY_BINS = dict(most=8, least_share=0.05, pseudo_count=0.5, rare_share=0.01)
STUDY_POINTS = dict(doubling=20.0, anchor=600.0, anchor_odds=50.0)
STUDY_RATES = (0.10, 0.30, 0.50, 0.70)
STUDY_POLICIES = ("risk_hard", "risk_soft", "random")
STUDY_FUNDING = (0.020, 0.030, 0.045)


@dataclass(frozen=True)
class Sampling:
    """Which rows enter an audit: all of them, unless a field says otherwise."""

    declined_rate: float = 1.0  # Bernoulli share of the declined file
    accepted_rows: int | None = None  # fixed-size sample of settled loans
    scored_only: bool = True  # declines without a score cannot be modelled


@dataclass(frozen=True)
class BinRules:
    most: int = STUDY_BINS["most"]
    least_share: float = STUDY_BINS["least_share"]
    one_way: bool = True  # bad rates rise or fall over the whole range
    pseudo_count: float = STUDY_BINS["pseudo_count"]
    rare_share: float = STUDY_BINS["rare_share"]


@dataclass(frozen=True)
class FitRules:
    inverse_penalty: float = 1.0
    test_share: float = 0.30


@dataclass(frozen=True)
class PointRules:
    """Score at ``anchor_odds`` good to bad, and the points that double them."""

    doubling: float = STUDY_POINTS["doubling"]
    anchor: float = STUDY_POINTS["anchor"]
    anchor_odds: float = STUDY_POINTS["anchor_odds"]


@dataclass(frozen=True)
class Labelling:
    """How declined applicants get outcomes and weights."""

    decline_multiple: float = 2.0  # assumed bad rate of a band's declines over its approvals
    bands: int = 10
    band_rows: int = 50  # below this a band takes the overall rate
    least_approval: float = 1e-4
    weight_percentile: float = 99.0


@dataclass(frozen=True)
class Masking:
    """The artificial policies of the backtest."""

    policies: tuple = STUDY_POLICIES
    rates: tuple = STUDY_RATES
    replicates: int = 5
    slope: float = 2.5  # of the soft policy, per standard deviation
    held_share: float = 0.30
    pool_rows: int | None = None  # rows drawn per replicate; all when not set
    # a scenario with fewer rows on a side is reported as skipped, not fitted
    fit_approved: int = 2_000
    fit_declined: int = 500


@dataclass(frozen=True)
class ScaleCheck:
    """The backtest over assumed multiples of the bad rate."""

    multiples: tuple = (1.0, 1.5, 2.0, 3.0)
    policies: tuple = ("risk_hard", "random")
    between: tuple = (0.2, 0.6)  # decline rates
    replicates: int = 2


@dataclass(frozen=True)
class CashRules:
    """What a loan earns and costs, per year and dollar."""

    funding: float = STUDY_FUNDING[1]
    servicing: float = 0.010
    funding_range: tuple = STUDY_FUNDING
    life_share: float = 0.55  # average life over term
    loss_default: float = 0.80
    term_default: float = 36.0
    bands: int = 10
    bands_from: str = "applicants"  # cut on these, or on the "calibration" loans


@dataclass(frozen=True)
class Resampling:
    """Poisson bootstrap of a total."""

    replicates: int = 2000
    confidence: float = 0.90
    blocks: int = 8192


@dataclass(frozen=True)
class RegionRules:
    least_applications: int = 500
    flag_at: float = 3.0


@dataclass(frozen=True)
class Audit:
    seed: int = STUDY_SEED
    sample: Sampling = field(default_factory=Sampling)
    bins: BinRules = field(default_factory=BinRules)
    fit: FitRules = field(default_factory=FitRules)
    points: PointRules = field(default_factory=PointRules)
    labelling: Labelling = field(default_factory=Labelling)
    masking: Masking = field(default_factory=Masking)
    scale_check: ScaleCheck = field(default_factory=ScaleCheck)
    cash: CashRules = field(default_factory=CashRules)
    resampling: Resampling = field(default_factory=Resampling)
    regions: RegionRules = field(default_factory=RegionRules)

    def digest(self, *inputs: str) -> str:
        """Short name of these settings and inputs; cached tables carry it in their path."""
        said = json.dumps([asdict(self), list(inputs)], sort_keys=True)
        return hashlib.blake2b(said.encode(), digest_size=8).hexdigest()

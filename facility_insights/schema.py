"""Fixed values and column groups.

Everything under "FIXED VALUES" must equal the behaviour being reproduced (tokens, thresholds,
constants); it is stated here once, in natural order, and used by name elsewhere.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the reproduced behaviour)
# ---------------------------------------------------------------------------------------------

# Cell texts that mean "missing" in the survey table.
SURVEY_MISSING_TOKENS = ["Not Available", "Not  Available", "Not Applicable"]
# Cell texts that mean "missing" in the provider table.
PROVIDER_MISSING_TOKENS = ["Not Available", "*", "Less than 11"]
# Territories removed from the provider table (rows with no state are kept at this step).
EXCLUDED_STATES = ["VI", "GU", "MP", "PR"]
# Measure codes containing this text are dropped from the provider table.
DROPPED_CODE_MARK = "DENOMINATOR"
# Usage file: only provider rows of the hospice service are kept.
USAGE_SUMMARY_CATEGORY = "PROVIDER"
USAGE_SERVICE_CATEGORY = "HOS"
# Days of operation are counted up to this date; certification dates are MM/dd/yyyy text.
OPERATION_REFERENCE_DATE = "2017-01-01"
CERT_DATE_FORMAT = "MM/dd/yyyy"
# Ownership level that sets the for-profit flag.
FOR_PROFIT_LEVEL = "For-Profit"
# Level given to null answers of the care-setting questions.
MISSING_LEVEL = "Missing"
# Demographic shares: null shares become 0 when the known shares sum to more than this.
DEMOGRAPHIC_FILL_THRESHOLD = 95.0
# Rating estimate weights of the bottom, middle and top answer bins (applied to percentages).
RATING_BIN_WEIGHTS = (3.5, 7.5, 9.5)
# Adjusted top-box score: TBV / (1 + ADJ_FACTOR * BBV).
ADJ_FACTOR = 0.01
# Radius features in miles (strict "<" comparison) and the haversine constants.
RADII_MILES = (30.0, 60.0, 90.0)
EARTH_RADIUS_KM = 6371.0088
KM_TO_MILES = 0.621371192
# Train/test split: share of each state that goes to the test part, and the default seed.
TEST_SHARE = 0.33
DEFAULT_SEED = 42
# kNN imputer and kNN regression neighbour counts (library defaults used by the reference).
KNN_IMPUTE_K = 5
KNN_REGRESS_K = 30
# Number of folds / random splits in model comparison and the held-out share per split.
N_FOLDS = 5
RESAMPLE_TEST_SHARE = 0.2
# Gradient boosting search grid (learning rate, depth, min child weight, gamma, column sample).
SEARCH_GRID = {
    "learning_rate": [0.05, 0.10, 0.15, 0.20, 0.25, 0.30],
    "max_depth": [3, 4, 5, 6, 8, 10, 12, 15],
    "min_child_weight": [1, 3, 5, 7],
    "gamma": [0.0, 0.1, 0.2, 0.5, 1.0],
    "colsample_bytree": [0.3, 0.4, 0.5, 0.7],
}
SEARCH_DRAWS = 10
# Trees of a boosted model, those of a search and the one it picks included, and of each model of a comparison.
BOOST_ROUNDS = 100
COMPARE_ROUNDS = 20
# Growth of the quantile comparator: leaves of a tree and least rows of a leaf.
QUANTILE_LEAVES = 50
QUANTILE_LEAF_ROWS = 20
# Key-hash blocks within which a feature is permuted, at any number of rows.
PERMUTATION_BLOCKS = 16
# Accuracy of the approximate quantiles of residuals (relative rank error 1 / accuracy).
QUANTILE_ACCURACY = 10000
# Levels a one-hot source column may have when they are discovered; more raise.
MAX_LEVELS = 1000
# Quantile of the quantile-boosting comparator (library default).
QUANTILE_ALPHA = 0.9

# ---------------------------------------------------------------------------------------------
# Column groups of the shape views (see sources/shapes.py)
# ---------------------------------------------------------------------------------------------

SURVEY_STEMS = ["RECOMMEND", "RATING", "SYMPTOMS", "TRAINING", "EMO_REL"]
SURVEY_CODES = [f"{s}_{b}" for s in SURVEY_STEMS for b in ("BBV", "MBV", "TBV")]
# Survey stems with a middle bin that feed MANAGED_x = TBV + MBV; EMO_REL has TBV only.
MANAGED_STEMS = ["SYMPTOMS", "TRAINING"]
MANAGED_TOP_ONLY = ["EMO_REL"]
# Targets ("sentiments") whose presence conditions the missing-value matrix.
SENTIMENT_COLUMNS = ["RECOMMEND_BBV", "RECOMMEND_MBV", "RECOMMEND_TBV", "RATING_BBV", "RATING_MBV", "RATING_TBV"]
# Ratio variables that are reverse min-max scaled after the BTR step.
RATIO_VARS = ["RECOMMEND_BTR", "RATING_BTR", "SYMPTOMS_BTR", "TRAINING_BTR", "EMO_REL_BTR"]

PROVIDER_CODES = [
    "Average_Daily_Census",
    "H_001_01_OBSERVED",
    "H_001_01_DENOMINATOR",
    "H_002_01_OBSERVED",
    "Pct_Pts_w_Cancer",
]
PROVIDER_FLOATS = [c for c in PROVIDER_CODES if DROPPED_CODE_MARK not in c]
PROVIDER_ID_COLUMNS = ["ccn", "name", "address", "city", "state", "zip", "county"]

DEMOGRAPHIC_COLUMNS = ["perc_white", "perc_black", "perc_asian", "perc_hisp", "perc_native", "perc_other"]

USAGE_MEASURES = ["distinct_bens", "total_charge", "nurse_visit_ct", "perc_rural", "all_missing"]
# Long usage header -> short name (the data dictionary used for renaming).
USAGE_DICTIONARY = {
    "Distinct Beneficiaries (non-zero)": "distinct_bens",
    "Total Charge Amount": "total_charge",
    "Nurse Visit Count": "nurse_visit_ct",
    "Percent Rural Zip Code": "perc_rural",
    "Suppressed Column": "all_missing",
}

CARE_SETTING_COLUMNS = ["care_home"]
DUMMY_SOURCE_COLUMNS = ["ownership", "care_home"]

FEATURES_NUM = ["x1", "x2", "x3", "x4"]
FEATURES_DENSE = ["x1", "x2"]
TARGETS = ["y1", "y2"]
FEATURE_LABELS = {
    "x1": "Orders per Customer",
    "x2": "Account Balance",
    "x3": "Order Value (thousands)",
    "x4": "Key Pattern Score",
}

# Columns of the feature table that the insight model reads, in order, with their labels; the flag is not scaled.
INSIGHT_LABELS = {
    "for_profit": "For-Profit",
    "n_win_60": "Facilities Within 60 mi",
    "H_001_01_OBSERVED": "Treatment Preferences Observed",
    "MANAGED_EMO_REL": "Team Met Emotional Needs",
    "MANAGED_SYMPTOMS": "Team Managed Symptoms",
    "MANAGED_TRAINING": "Staff Adequately Trained",
    "H_002_01_OBSERVED": "Beliefs Addressed Observed",
    "Average_Daily_Census": "Average Daily Census",
    "Pct_Pts_w_Cancer": "% Patients With Cancer",
    "days_operation": "Days of Operation",
    "nurse_visit_ct_pb": "Nurse Visits per Patient",
    "total_charge_pb": "Total Charge per Patient",
    "perc_rural": "% Rural Zip",
}
INSIGHT_FEATURES = list(INSIGHT_LABELS)
INSIGHT_UNSCALED = ["for_profit"]
# What a facility can act on: no ownership, place or neighbourhood.
ACTIONABLE_FEATURES = [f for f in INSIGHT_FEATURES if f not in ("for_profit", "n_win_60", "perc_rural")]
INSIGHT_TARGETS = ["would_recommend", "RATING_EST"]
# The column whose gap marks an entity that only the prediction model scores.
OBSERVED_COLUMN = "RECOMMEND_BBV"

# Data dictionaries used for the variable catalog (variable -> description), by source.
SURVEY_BIN_NAMES = {"BBV": "bottom box", "MBV": "middle box", "TBV": "top box"}
SURVEY_DESCRIPTIONS = {f"{s}_{b}": f"{s.replace('_', ' ').title()} - {n} percent" for s in SURVEY_STEMS for b, n in SURVEY_BIN_NAMES.items()}
PROVIDER_DESCRIPTIONS = {
    "Average_Daily_Census": "Average daily census",
    "H_001_01_OBSERVED": "Treatment preferences observed percent",
    "H_002_01_OBSERVED": "Beliefs and values addressed observed percent",
    "Pct_Pts_w_Cancer": "Percent of patients with cancer",
    "name": "Facility name",
    "state": "State",
}
USAGE_DESCRIPTIONS = {v: k for k, v in USAGE_DICTIONARY.items()}

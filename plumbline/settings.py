"""Default thresholds.

Fixed values: results depend on them, so they are listed here and every
operator takes them as keyword defaults.
"""

SEED = 42

# segmentation
CLUSTERS = 3
ELBOW_MAX_K = 10
KMEANS_RESTARTS = 10
PCA_COMPONENTS = 2
GOOD_SILHOUETTE = 0.5
DBSCAN_EPS = 0.5
DBSCAN_MIN_SAMPLES = 5

# outliers
IQR_MULTIPLIER = 1.5
ZSCORE_LIMIT = 3.0
MAD_LIMIT = 3.5
MAD_SCALE = 0.6745
CONSENSUS_VOTES = 2

# time series
SEASONAL_PERIOD = 12
ACF_LAGS = 40
LAGS_LISTED = 10
CHANGEPOINT_SIGMAS = 2.0
CHANGEPOINTS_LISTED = 20

# hypothesis tests
ALPHA = 0.05
GROUP_SIZE_SETTING = 30
MIN_GROUP_ROWS = 3  # the larger of 3 and a tenth of GROUP_SIZE_SETTING

# quality gates
MAX_MISSING_RATE = 0.3
MIN_UNIQUE_RATIO = 0.01
MAX_UNIQUE_RATIO = 0.95

# feature importance
FOREST_TREES = 100
MIN_IMPORTANCE = 0.01
PERMUTATION_REPEATS = 10

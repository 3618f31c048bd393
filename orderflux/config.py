"""Choices that the specification leaves open, in one place.

Every value here is ours; tests name the constant they rely on.
"""

# Store and import
NULL_KEYS_COLLAPSE = False          # True: rows without an order id collapse to one
RESTATEMENT_SAMPLES = 25
FRESH_AMBER_DAYS = 2
FRESH_RED_DAYS = 7

KEY_BUCKETS = 32                    # of the order id index, fixed when it is made
KEY_FILTER_WORDS = 1 << 16          # of 64 bits in the Bloom filter of a bucket
KEY_FOLDERS = 8                     # beyond so many a bucket is merged
COMMIT_ATTEMPTS = 5                 # merges of one batch while others write the same rows
RETAINED_VERSIONS = 10
RETAINED_SECONDS = 86_400.0

# Metrics
REFUND_RATE_MIN_ORDERS = 200
DENOMINATION_BAND_EDGES = (10, 20, 30, 40)
PACKAGE_TIER_EDGES_MB = (1024, 10240, 30720)
UNLIMITED_MB = 1024 * 1024          # sentinel for unlimited packages, sorts last
RESELLER_MIN_NUMBERS = 4
SUPPLIER_TOP_SHARE_LIMIT = 0.80
LTV_WINDOW_DAYS = 90
PIN_STOCK_WEEKS = 4

MEDIAN_VALUES = 100_000             # ordered in one task to find a median

# Signals
ANOMALY_THRESHOLD = 0.30            # |last 7 days / prior 4-week baseline - 1|
DIGEST_REFUND_RATE = 0.10
DIGEST_ROUTING_GAP = 100
DIGEST_DATA_AGE_DAYS = 2

# Demand
DEMAND_TOP_GROUPS = 60
DEMAND_WEEKS = 12

# Country scrub: application names seen in the country column
COUNTRY_JUNK = ("useepay", "alipay", "wechat")

"""Fixed values of the domain. Changing one changes results."""

# --- product code -----------------------------------------------------------
VALID_HEADER = "001"
VALID_COMPANIES = ("8804823", "8805843", "8809437")
MAX_AGE_DAYS = 5 * 365
EPC_PARTS = 6
PRODUCT_DIGITS, LOT_DIGITS, SERIAL_DIGITS = 7, 6, 9

# --- score weights ------------------------------------------------------------
SCORE_HEADER = 20
SCORE_COMPANY = 25
SCORE_PRODUCT = 15
SCORE_LOT = 15
SCORE_SERIAL = 10
SCORE_DATE = 20
SCORE_DATE_OLD = 15
SCORE_CONSECUTIVE = 25
SCORE_CONSECUTIVE_EXTRA = 15
SCORE_LOCATION_UNKNOWN = 20
SCORE_LOCATION_REVERSE = 30
SCORE_MAX = 100

SEVERITY_CUTS = (("HIGH", 70), ("MEDIUM", 40), ("LOW", 20))

# --- anomaly types, in the order that breaks ties -----------------------------
ANOMALY_TYPES = ("epcFake", "epcDup", "jump", "evtOrderErr", "locErr")
STATS_TYPES = ("epcFake", "epcDup", "locErr", "evtOrderErr", "jump")

# --- place names: first keyword contained in the name decides -------------------
UNKNOWN_LEVEL = 99
LOCATION_KEYWORDS = (
    ("공장", 0), ("factory", 0), ("제조", 0), ("manufacturing", 0),
    ("물류센터", 1), ("물류", 1), ("logistics", 1), ("hub", 1), ("센터", 1), ("center", 1),
    ("도매상", 2), ("도매", 2), ("wholesale", 2), ("w_stock", 2), ("창고", 2), ("warehouse", 2),
    ("소매상", 3), ("소매", 3), ("retail", 3), ("r_stock", 3), ("pos", 3), ("매장", 3), ("store", 3),
)
FACTORY_WORD = "공장"
WAREHOUSE_WORD = "창고"

# --- event types: first keyword contained in the lower-cased name decides ---------
EVENT_KEYWORDS = (
    ("aggregation", "inbound", "aggregation"),
    ("wms_inbound", "inbound", "wms"),
    ("wms_outbound", "outbound", "wms"),
    ("hub_inbound", "inbound", "hub"),
    ("hub_outbound", "outbound", "hub"),
    ("w_stock_inbound", "inbound", "w_stock"),
    ("w_stock_outbound", "outbound", "w_stock"),
    ("r_stock_inbound", "inbound", "r_stock"),
    ("r_stock_outbound", "outbound", "r_stock"),
    ("pos_sell", "other", "pos"),
)
STAGE_OF_STEP = {
    "aggregation": "production",
    "wms": "logistics", "hub": "logistics", "w_stock": "logistics",
    "r_stock": "retail", "pos": "retail",
}
STAGE_RANK = {"production": 1, "logistics": 2, "retail": 3}

# --- business steps ---------------------------------------------------------------
STEP_LEVEL = {"Factory": 1, "WMS": 2, "Wholesaler": 3, "Retailer": 4}
SKIPPED_LEVELS = ((2, 4), (1, 3), (1, 4))
STEP_ORDINALS = {
    "basic": ({"Factory": 1, "WMS": 2, "Logistics_HUB": 3, "Distribution": 4}, 99),
    "retail": ({"Factory": 1, "WMS": 2, "Logistics_HUB": 3, "Distribution": 4, "Retail": 5}, 0),
    "customer": (
        {"Factory": 1, "WMS": 2, "Logistics_HUB": 3, "Distribution": 4, "Retail": 5, "Customer": 6},
        None,
    ),
}

# --- travel -------------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
MAX_SPEED_KMH = 100.0
JUMP_IMPOSSIBLE = 95
JUMP_BANDS = ((2.0, 0), (3.0, 60), (4.0, 80))
MAX_REASONABLE_GAP_HOURS = 168.0

# --- event findings -------------------------------------------------------------------
EVENT_ORDER_SCORE, EVENT_DUPLICATE_SCORE, EVENT_LOCATION_SCORE = 25.0, 90.0, 30.0
DUPLICATE_BASE, DUPLICATE_PER_PLACE = 80, 10

# --- labels, thresholds, calibration ----------------------------------------------------
LABEL_THRESHOLD = 50
TARGET_POSITIVE_RATIO = {"epcFake": 0.05, "epcDup": 0.02, "evtOrderErr": 0.10, "locErr": 0.08, "jump": 0.03}
# target rate, smallest and largest threshold
CALIBRATION = {
    "epcFake": (0.005, 60.0, 95.0),
    "epcDup": (0.025, 30.0, 90.0),
    "locErr": (0.015, 40.0, 85.0),
    "evtOrderErr": (0.020, 35.0, 80.0),
    "jump": (0.008, 50.0, 95.0),
}
ALERT_COST = 50.0
MISS_COST = {"epcFake": 1000.0, "epcDup": 200.0, "locErr": 300.0, "evtOrderErr": 150.0, "jump": 500.0}
REDUCED_THRESHOLDS = {"epcFake": 15, "epcDup": 10, "evtOrderErr": 12, "locErr": 8, "jump": 15}

# --- alerts and risk ------------------------------------------------------------------------
ALERT_CUTS = {
    "HIGH": {"epcFake": 0.8, "epcDup": 0.8, "locErr": 0.7, "evtOrderErr": 0.7, "jump": 0.8},
    "MEDIUM": {"epcFake": 0.5, "epcDup": 0.5, "locErr": 0.4, "evtOrderErr": 0.4, "jump": 0.5},
    "LOW": {"epcFake": 0.2, "epcDup": 0.2, "locErr": 0.2, "evtOrderErr": 0.2, "jump": 0.2},
}
RISK_CUTS = {
    "three": ((0.8, "high"), (0.6, "medium"), (None, "low")),
    "four": ((0.8, "HIGH"), (0.5, "MEDIUM"), (0.2, "LOW"), (None, "NORMAL")),
}

# --- texts shown to users ----------------------------------------------------------------------
TYPE_NAMES = {
    "epcFake": "EPC 형식 위반",
    "epcDup": "불가능한 중복 스캔",
    "jump": "비논리적인 시공간 이동",
    "evtOrderErr": "이벤트 순서 오류",
    "locErr": "위치 계층 위반",
}
TYPE_SENTENCES = {
    "epcFake": "EPC 코드 형식 위반 감지",
    "epcDup": "동일 시간 다른 위치 중복 스캔 감지",
    "jump": "{place}에서 비논리적 시간점프 이동 발생",
    "evtOrderErr": "{step} 이벤트 순서 오류",
    "locErr": "위치 계층 순서 위반",
}
TYPE_PHRASES = {
    "epcFake": "Counterfeit product detection",
    "epcDup": "Impossible duplicate scanning",
    "locErr": "Supply chain flow violations",
    "evtOrderErr": "Event sequence anomalies",
    "jump": "Impossible travel time detection",
}
# words that must all occur in the factor name, advice; first match wins
FACTOR_ADVICE = (
    (("time", "gap"), "Review scanning timing patterns and procedures"),
    (("location",), "Verify supply chain route and location compliance"),
    (("business hours",), "Check for unauthorized after-hours activities"),
    (("frequency",), "Analyze scanning frequency for operational issues"),
)
TYPE_ADVICE = {
    "epcFake": "Verify product authenticity and EPC format compliance",
    "epcDup": "Check for duplicate scanning equipment or procedures",
    "jump": "Investigate impossible travel times between locations",
    "locErr": "Review supply chain flow and location hierarchy",
    "evtOrderErr": "Examine event sequencing and timing issues",
}

# --- costs used in evaluation -------------------------------------------------------------------
# missed, false alert
REVIEW_COSTS = {
    "epcFake": (100.0, 10.0), "epcDup": (30.0, 5.0), "locErr": (50.0, 8.0), "evtOrderErr": (40.0, 6.0), "jump": (80.0, 12.0)}
# false alert, missed
ACCURACY_COSTS = {
    "epcFake": (1.0, 100.0), "epcDup": (0.1, 5.0), "locErr": (2.0, 50.0), "evtOrderErr": (1.5, 25.0), "jump": (5.0, 200.0)}
# false alert, missed, right alert, right silence
CURVE_COSTS = {
    "epcFake": (5.0, 50.0, -10.0, 0.0), "epcDup": (2.0, 20.0, -5.0, 0.0), "locErr": (10.0, 100.0, -15.0, 0.0),
    "evtOrderErr": (8.0, 80.0, -12.0, 0.0), "jump": (15.0, 200.0, -25.0, 0.0)}

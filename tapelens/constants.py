"""Thresholds, weights, word lists and price lists that results depend on."""

# --- fixed values: components, in report order, and the probe behind each -----------------
PROBE_COMPONENT = {
    "broker_concentration": "BCI",
    "volume_anomaly": "VAS",
    "price_fundamental": "PFD",
    "free_float": "FFS",
    "foreign_flow": "FRD",
    "structural": "SSS",
}
PROBES = list(PROBE_COMPONENT)
COMPONENTS = list(PROBE_COMPONENT.values())
WEIGHTS = {"BCI": 0.25, "VAS": 0.22, "PFD": 0.12, "FFS": 0.18, "FRD": 0.15, "SSS": 0.08}
WEIGHTS_VERSION = "cal-2026-09-10-sementara"
MIN_POSITIVES_FOR_CALIBRATION = 30

BANDS = [(80, "sangat_waspada"), (60, "waspada"), (30, "perhatian"), (0, "normal")]

# --- fixed values: probe windows and score anchors -----------------------------------------
MAD_TO_SIGMA = 1.4826
VAS_BASELINE, VAS_MIN_BASELINE, VAS_LOOKBACK = 90, 30, 120
BCI_SESSIONS, BCI_MIN_BROKERS = 20, 3
PFD_SESSIONS, PFD_MIN_SESSIONS, PFD_LAG_QUARTERS = 100, 30, 4
FFS_STALE_DAYS = 400
FRD_SESSIONS, FRD_MIN_SESSIONS = 30, 10
SSS_MONTHS, SSS_FILING_DAYS = 24, 90

# --- fixed values: word lists ---------------------------------------------------------------
UNUSUAL_REASONS = [
    "tidak wajar", "di luar kebiasaan", "unusual", "unusual market activity",
    "uma", "pergerakan harga", "peningkatan harga", "aktivitas transaksi",
]
POSITIVE_REASONS = [
    "tidak wajar", "di luar kebiasaan", "unusual", "uma",
    "pergerakan harga", "peningkatan harga", "aktivitas transaksi",
]
# Both spellings of the rights issue: the feed says right_issue, reports say rights_issue.
RISKY_ACTIONS = [
    "rights_issue", "rights issue", "right_issue", "private_placement", "private placement",
    "reverse_stock", "reverse stock",
]
SELL_WORDS = ["sell", "jual"]
MOVEMENT_PATTERN = (
    "peningkatan harga kumulatif|cooling down|pergerakan harga.*di luar kebiasaan"
    "|aktivitas transaksi.*tidak wajar|unusual market activity"
)
ADMIN_PATTERN = (
    "laporan keuangan|biaya pencatatan|papan pemantauan|kelangsungan usaha"
    "|peraturan bursa|delisting|buyback|suspend more than"
)

# --- fixed values: daily screen -------------------------------------------------------------
SCREEN_WEIGHTS = {
    "return_5d": 0.25, "return_20d": 0.15, "volume_z": 0.40, "small_cap": 0.10, "event": 0.10,
}
SCREEN_FULL = {
    "return_5d": 0.30, "return_20d": 0.60, "volume_z": 6.0, "small_cap": 1.0, "event": 1.0,
}
SMALL_CAP = 5_000_000_000_000
SCREEN_MIN_ROWS, SCREEN_SESSIONS, SCREEN_FRESH, WATCHLIST_SIZE = 20, 21, 5, 15
EVENT_DAYS = 5

# --- fixed values: calibration ----------------------------------------------------------------
LAGS = [1, 3, 5, 10]
EPISODE_GAP_DAYS = 10
MIN_PRICE_ROWS = 40
CONTROLS_PER_POSITIVE = 3
FLOAT_TOLERANCE = 0.05

# --- fixed values: selection -------------------------------------------------------------------
COOLDOWN_SESSIONS, COOLDOWN_CONFIDENCE, COOLDOWN_MOVE = 2, 0.6, 0.05
DEFAULT_TOP, REQUEST_QUOTA = 3, 3
SLOW_COMPONENT_DAYS = {"FFS": 15, "SSS": 7}

# --- fixed values: price list (credits per unit, units per call, rows per unit, preferred route,
#     verified) and the endpoints each probe buys ------------------------------------------------
ENDPOINTS = {
    "fetch-close": (1, 1, 0, "mcp", True),
    "fetch-most-traded-stocks": (2, 1, 0, "rest", True),
    "fetch-companies-top-changes": (1, 1, 0, "rest", True),
    "fetch-suspensions": (1, 1, 0, "rest", True),
    "fetch-filings": (1, 1, 0, "rest", True),
    "fetch-daily-transaction": (1, 1, 0, "rest", True),
    "fetch-broker-summary-top": (2, 1, 0, "mcp", True),
    "fetch-broker-summary": (1, 1, 0, "mcp", True),
    "fetch-foreign-flow": (1, 1, 0, "rest", True),
    "fetch-free-float": (1, 1, 100, "mcp", True),
    "fetch-company-report": (2, 1, 0, "rest", False),
    "fetch-quarterly-financials": (1, 5, 1, "mcp", True),
    "fetch-corporate-actions": (1, 1, 0, "mcp", True),
    "fetch-shareholders-composition": (1, 1, 0, "mcp", True),
    "fetch-companies-by-subsector": (1, 1, 0, "mcp", False),
}
PROBE_ENDPOINTS = {
    "broker_concentration": ["fetch-broker-summary-top", "fetch-broker-summary"],
    "volume_anomaly": ["fetch-daily-transaction"],
    "price_fundamental": ["fetch-daily-transaction", "fetch-quarterly-financials"],
    "free_float": ["fetch-free-float"],
    "foreign_flow": ["fetch-foreign-flow", "fetch-daily-transaction"],
    "structural": ["fetch-suspensions", "fetch-filings", "fetch-corporate-actions"],
}
TIER2_ENDPOINTS = [
    "fetch-company-report", "fetch-filings", "fetch-daily-transaction",
    "fetch-broker-summary-top", "fetch-foreign-flow", "fetch-quarterly-financials",
    "fetch-corporate-actions",
]
TIER2_DATED = [
    "fetch-daily-transaction", "fetch-broker-summary-top", "fetch-foreign-flow",
    "fetch-corporate-actions", "fetch-filings",
]
PRICE_SESSIONS, CALL_WINDOW_SESSIONS, CALL_WINDOW_DAYS = 120, 90, 135

PHASE_CAPS = {"dev": 120, "backfill": 400, "eval": 130, "daily": 250, "reserve": 100}
ALARM_LEVELS = [0.70, 0.90]


def call_cost(endpoint: str) -> int:
    per_unit, units, *_ = ENDPOINTS[endpoint]
    return per_unit * units


PROBE_COST = {p: sum(call_cost(e) for e in eps) for p, eps in PROBE_ENDPOINTS.items()}
BASELINE_COST = sum(PROBE_COST.values())

# --- fixed values: text rules ----------------------------------------------------------------
# The disclaimer after the name of the service that opens it (a parameter where it is used).
SERVICE = "Layanan"
DISCLAIMER_TEXT = " adalah alat informasi dan analisis, bukan saran investasi."
UNIT_PATTERN = "%|persen|σ|sigma|×|x|M|T|Jt|jt|juta|miliar|triliun|rb|ribu"
UNIT_NAMES = {
    "%": "%", "persen": "%", "σ": "σ", "sigma": "σ", "×": "×", "x": "×", "rb": "rb",
    "ribu": "rb", "jt": "jt", "juta": "jt", "m": "m", "miliar": "m", "t": "t", "triliun": "t",
}
ALLOWED_CAPITAL_WORDS = ["RUPS", "IUPK", "LQ45"]
FORBIDDEN_PHRASES = [
    (r"target\s+harga", "price target"),
    (r"harga\s+target", "price target"),
    (r"rekomendasi", "recommendation"),
    (r"\bcuan\b", "profit promotion"),
    (r"pasti\s+(naik|untung|cuan)", "promised result"),
    (r"dijamin\s+(naik|untung|cuan)", "promised result"),
    (r"(wajib|layak|saatnya|buruan|segera|jangan)\s+(beli|jual)", "call to trade"),
    (r"\b(beli|jual)lah\b", "order to trade"),
    (r"\bportofolio\s+anda\b", "advice on the reader's holdings"),
    (r"saran\s+investasi", "investment advice"),
]
SENSITIVE_WORDS = ["beli", "jual"]
WORDS_BEFORE = [
    "net", "aksi", "transaksi", "tekanan", "volume", "nilai", "harga", "porsi",
    "pangsa", "total", "sisi", "arus", "pihak", "rasio", "jumlah", "aktivitas",
]
WORDS_AFTER = ["insider", "bersih", "asing", "ritel", "domestik"]
COLLOCATION_REACH, QUOTE_REACH = 24, 38
BAND_OPENERS = {
    "normal": "Tidak ada pola tidak biasa yang menonjol pada {s}.",
    "perhatian": "Beberapa indikator pada {s} berada di luar kebiasaan.",
    "waspada": "Beberapa indikator pada {s} menunjukkan pola tidak biasa.",
    "sangat_waspada": "Banyak indikator pada {s} menunjukkan pola tidak biasa secara bersamaan.",
}
NUMBER_WORDS = [
    "nol", "satu", "dua", "tiga", "empat", "lima", "enam", "tujuh", "delapan", "sembilan",
    "sepuluh",
]
MASK = "***REDACTED***"
FALLBACK_PLAN_PREFIX = "Rencana cadangan berbasis aturan"
FALLBACK_DECISION_PREFIX = "Keputusan cadangan berbasis aturan"
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des"]
WEEKDAY_NAMES = ["Minggu", "Senin", "Selasa", "Rabu", "Kamis", "Jumat", "Sabtu"]

# --- fixed values: evidence id -> (label, endpoint) ------------------------------------------
EVIDENCE = {
    "vas.zscore": ("Z-score volume vs baseline 90 hari", "fetch-daily-transaction"),
    "vas.volume_ratio": ("Volume hari terakhir vs median baseline", "fetch-daily-transaction"),
    "bci.top3_share": ("Pangsa net buy 3 broker teratas", "fetch-broker-summary-top"),
    "bci.hhi": ("Indeks Herfindahl konsentrasi broker", "fetch-broker-summary"),
    "bci.top3_codes": ("Kode 3 broker net buy teratas", "fetch-broker-summary-top"),
    "bci.broker_count": ("Jumlah broker dengan net buy positif", "fetch-broker-summary"),
    "pfd.return_90d": ("Return 90 hari bursa", "fetch-daily-transaction"),
    "pfd.earnings_change": ("Perubahan laba bersih year-on-year", "fetch-quarterly-financials"),
    "pfd.divergence": ("Selisih return terhadap pertumbuhan laba", "fetch-quarterly-financials"),
    "ffs.pct": ("Free float", "fetch-free-float"),
    "ffs.data_age_days": ("Umur data free float", "fetch-free-float"),
    "frd.foreign_net_30d": ("Arus asing bersih 30 hari bursa", "fetch-foreign-flow"),
    "frd.outflow_ratio": (
        "Arus keluar asing terhadap nilai transaksi periode", "fetch-foreign-flow"),
    "frd.price_change_30d": ("Perubahan harga 30 hari bursa", "fetch-daily-transaction"),
    "sss.prior_suspension": ("Suspensi terakhir", "fetch-suspensions"),
    "sss.suspension_count": ("Jumlah suspensi 24 bulan terakhir", "fetch-suspensions"),
    "sss.suspension_unusual": (
        "Alasan suspensi terkait pergerakan tidak wajar", "fetch-suspensions"),
    "sss.insider_sells": ("Transaksi jual insider 90 hari terakhir", "fetch-filings"),
    "sss.rights_issues": (
        "Rights issue / private placement 24 bulan terakhir", "fetch-corporate-actions"),
    "sss.clean": ("Peristiwa struktural terdeteksi", "fetch-suspensions"),
}

# --- fixed values: payload shapes -------------------------------------------------------------
ACTION_DATE_FIELD = {
    "agm": "agm_date", "bonus": "payment_date", "dividend": "ex_date", "right_issue": "ex_date",
    "stock_split": "date", "warrant": "ex_date", "upcoming_dividend": "ex_date",
}
ENVELOPE_KEYS = ["data", "results", "items", "rows", "records"]
FIELD_ALIASES = {
    "symbol": ["symbol", "ticker", "kode", "stock"],
    "trade_date": ["trade_date", "date", "tanggal"],
    "close_price": ["close_price", "close", "price"],
    "market_cap": ["market_cap", "market_capitalization"],
    "broker_code": ["broker_code", "broker", "code"],
    "net_value": ["net_idr", "net_value", "net", "net_amount"],
    "buy_value": ["buy_idr", "buy_value", "buy", "total_buy"],
    "sell_value": ["sell_idr", "sell_value", "sell", "total_sell"],
    "foreign_net": ["net_foreign_inflow", "net_value", "foreign_net", "net", "foreign_net_buy"],
    "start_date": ["start_date", "suspension_date", "date", "start"],
    "end_date": ["end_date", "resume_date", "end"],
    "reason": ["reason", "alasan", "note", "description"],
    "filing_date": ["filing_date", "timestamp", "date", "transaction_date"],
    "holder_name": ["holder_name", "holder", "name"],
    "holder_type": ["holder_type", "type", "category"],
    "transaction_type": ["transaction_type", "action", "side"],
    "shares": ["shares", "amount_transaction", "volume"],
    "free_float_pct": ["free_float_pct", "free_float", "percentage", "pct"],
    "as_of": ["as_of", "date"],
    "action_date": ["action_date", "date", "ex_date"],
    "action_type": ["action_type", "type", "action"],
    "detail": ["detail", "description", "note"],
    "report_date": ["report_date", "date", "period", "quarter_date"],
    "revenue": ["revenue", "total_revenue", "sales"],
    "net_income": ["net_income", "earnings", "profit"],
    "total_assets": ["total_assets", "assets"],
    "company_name": ["company_name", "name", "nama"],
    "sub_sector": ["sub_sector", "subsector", "sector"],
    "listing_date": ["listing_date", "ipo_date", "listing"],
    "price_change": ["price_change", "change", "pct_change"],
    "last_close": ["last_close_price", "last_close", "close", "price"],
    "share_pct": ["share_pct", "percentage", "share_percentage"],
}

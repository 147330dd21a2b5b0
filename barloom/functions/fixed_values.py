"""Weights, thresholds, word lists, tables and patterns that results depend on."""

# ---- scoring weights ---------------------------------------------------------------------------
PRE_RESULT_WEIGHTS = {
    "timing": 0.10, "rel_strength": 0.22, "acceleration": 0.12, "participation": 0.16,
    "history": 0.12, "fundamentals": 0.14, "catalysts": 0.08, "liquidity": 0.06,
}
SIGNAL_WEIGHTS = {
    "trend": 0.30, "momentum": 0.20, "supertrend": 0.15, "volume": 0.10, "sentiment": 0.15, "fundamental": 0.10,
}
SIGNAL_THRESHOLDS = {"STRONG BUY": 40, "BUY": 15, "SELL": -15, "STRONG SELL": -40}

# ---- currency rates used to read amounts in crore ---------------------------------------------
USD_RATE = 88.0
EUR_RATE = 88.0 * 1.08

# ---- sector labels and their benchmark indices -------------------------------------------------
MARKET_INDEX = "Nifty 500"
SECTOR_INDEX = {
    "financial services": "Nifty Fin Service",
    "information technology": "Nifty IT",
    "automobile and auto components": "Nifty Auto",
    "fast moving consumer goods": "Nifty FMCG",
    "healthcare": "Nifty Pharma",
    "metals & mining": "Nifty Metal",
    "realty": "Nifty Realty",
    "oil gas & consumable fuels": "Nifty Energy",
    "power": "Nifty Energy",
    "media entertainment & publication": "Nifty Media",
    "chemicals": "Nifty Chemicals",
    "construction": "Nifty Infra",
    "construction materials": "Nifty Infra",
    "capital goods": "Nifty Infra",
    "telecommunication": "Nifty Infra",
    "utilities": "Nifty Energy",
    "consumer services": "Nifty FMCG",
    "consumer durables": "Nifty FMCG",
}
SECTOR_KEYWORDS = [
    ("Nifty Fin Service", ["bank", "financ", "nbfc", "insurance", "lending", "broking", "capital market",
                           "asset management"]),
    ("Nifty IT", ["software", "it services", "it enabled", "information technology", "computers"]),
    ("Nifty Pharma", ["pharma", "drug", "hospital", "healthcare", "diagnostic", "biotech"]),
    ("Nifty Auto", ["auto", "tyre", "two wheeler", "vehicle"]),
    ("Nifty Metal", ["steel", "metal", "alumin", "copper", "zinc", "mining", "iron"]),
    ("Nifty Energy", ["refiner", "oil", "gas", "coal", "power", "energy", "petroleum"]),
    ("Nifty Chemicals", ["chemical", "fertili", "pesticide", "agrochem", "dyes", "pigment"]),
    ("Nifty Realty", ["realty", "real estate", "residential", "commercial projects"]),
    ("Nifty Media", ["media", "entertainment", "broadcast", "publishing"]),
    ("Nifty FMCG", ["food", "beverage", "personal care", "fmcg", "tobacco", "household", "consumer"]),
    ("Nifty Infra", ["cement", "construction", "infra", "engineering", "electrical equipment", "capital goods",
                     "industrial"]),
]

# ---- source formats ------------------------------------------------------------------------------
LISTED_SERIES = ["EQ", "BE"]
DELIVERY_SERIES = ["EQ", "BE", "BZ", "SM", "ST"]
SIZE_BUCKETS = ["Large", "Mid", "Small", "Micro"]
MEETING_DATE_FORMATS = ["d MMM yyyy", "d-MMM-yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d MMMM yyyy"]
MEETING_COLUMNS = {
    "code": ["security code", "bse code", "scrip code", "code"],
    "company": ["company name", "company", "name"],
    "date": ["meeting date", "result date", "date", "board meeting date"],
    "industry": ["industry"],
    "purpose": ["purpose"],
}
FUNDAMENTAL_COLUMNS = [
    "Industry Group", "Industry", "Current Price", "Price to Earning", "Market Capitalization", "Dividend yield",
    "Net Profit latest quarter", "YOY Quarterly profit growth", "Sales latest quarter", "YOY Quarterly sales growth",
    "Return on capital employed", "PEG Ratio", "CFO by PAT", "Debt to equity", "OPM", "Change in FII holding",
]

# ---- screen presets --------------------------------------------------------------------------------
FIELD_ALIASES = {
    "marketcap": "marketCap", "mcap": "marketCap", "price": "ltp", "change": "changePct", "rsi": "rsi",
    "signal": "signal", "relvol": "relVol", "fund": "fundamentalScore", "score": "signalScore", "volume": "volume",
}
FUNDAMENTAL_PRESETS = {
    "Growth": {"YOY Quarterly profit growth": (25, None), "YOY Quarterly sales growth": (15, None)},
    "Quality": {"Return on capital employed": (20, None), "Debt to equity": (None, 0.5), "CFO by PAT": (0.7, None)},
    "Value + growth": {"Price to Earning": (None, 25), "PEG Ratio": (None, 1.5), "YOY Quarterly profit growth": (20, None)},
    "Margin expansion": {"OPM": (15, None), "YOY Quarterly profit growth": (30, None)},
}

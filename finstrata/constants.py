"""Names, thresholds and costs that results depend on."""

from __future__ import annotations

# ---- fixed values: the sixteen indicators, in canonical order -------------------------------
INDICATORS = [
    "revenue",
    "cost_of_sales",
    "inventory",
    "selling_general_admin",
    "operating_cash_flow",
    "total_assets",
    "cash_and_equivalents",
    "operating_income",
    "current_assets",
    "current_liabilities",
    "net_income",
    "stockholders_equity",
    "liabilities",
    "receivables",
    "short_term_investments",
    "retained_earnings",
]

# ---- fixed values: indicators that are activity of a period (the others are balances) -------
DURATION_INDICATORS = [
    "revenue",
    "cost_of_sales",
    "selling_general_admin",
    "operating_cash_flow",
    "operating_income",
    "net_income",
]

# ---- fixed values: filing tags per indicator, highest priority first ------------------------
TAGS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"],
    "cost_of_sales": ["CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"],
    "inventory": ["InventoryNet"],
    "selling_general_admin": ["SellingGeneralAndAdministrativeExpense"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "total_assets": ["Assets"],
    "cash_and_equivalents": ["CashAndCashEquivalentsAtCarryingValue"],
    "operating_income": ["OperatingIncomeLoss"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "net_income": ["NetIncomeLoss"],
    "stockholders_equity": ["StockholdersEquity"],
    "liabilities": ["Liabilities"],
    "receivables": ["ReceivablesNetCurrent", "AccountsReceivableNetCurrent"],
    "short_term_investments": ["ShortTermInvestments"],
    "retained_earnings": ["RetainedEarningsAccumulatedDeficit"],
}

# ---- fixed values: fallback tags, used only when asked for -----------------------------------
FALLBACK_TAGS = {
    "revenue": ["Revenues", "SalesRevenueGoodsNet"],
    "cost_of_sales": ["CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization"],
    "inventory": ["InventoryFinishedGoods", "InventoryGross"],
    "selling_general_admin": ["SellingAndMarketingExpense", "GeneralAndAdministrativeExpense"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "cash_and_equivalents": ["CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"],
    "net_income": ["ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"],
    "stockholders_equity": ["StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "receivables": ["AccountsNotesAndLoansReceivableNetCurrent"],
}

# ---- fixed values: tags that reveal quarters and year ends ------------------------------------
QUARTER_TAGS = [
    "NetIncomeLoss",
    "OperatingIncomeLoss",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "SalesRevenueNet",
    "NetCashProvidedByUsedInOperatingActivities",
]
YEAR_TAGS = ["NetIncomeLoss", "Assets"]
BALANCE_TAGS = ["AssetsCurrent", "Assets"]

# ---- fixed values: ratios as (numerator, denominator) ------------------------------------------
# An operand is an indicator, a difference "a - b", or "total_liabilities" (reported or derived).
RATIOS = {
    "gross_margin": ("revenue - cost_of_sales", "revenue"),
    "operating_margin": ("operating_income", "revenue"),
    "net_margin": ("net_income", "revenue"),
    "sgna_pct_revenue": ("selling_general_admin", "revenue"),
    "current_ratio": ("current_assets", "current_liabilities"),
    "quick_ratio": ("current_assets - inventory", "current_liabilities"),
    "debt_to_assets": ("total_liabilities", "total_assets"),
    "debt_to_equity": ("total_liabilities", "stockholders_equity"),
    "inventory_to_sales": ("inventory", "revenue"),
    "receivables_to_sales": ("receivables", "revenue"),
    "cash_to_assets": ("cash_and_equivalents", "total_assets"),
    "ocf_to_sales": ("operating_cash_flow", "revenue"),
    "retained_to_assets": ("retained_earnings", "total_assets"),
    "revenue_per_asset": ("revenue", "total_assets"),
}

# ---- fixed values: indicators with a year-over-year growth feature ----------------------------
GROWTH_FIELDS = [
    "revenue",
    "cost_of_sales",
    "inventory",
    "operating_cash_flow",
    "total_assets",
    "cash_and_equivalents",
    "operating_income",
    "current_assets",
    "current_liabilities",
    "net_income",
]

# ---- fixed values: trajectory features -----------------------------------------------------------
PATH_FEATURES = [
    "current_ratio_min_window",
    "ocf_to_sales_min_window",
    "net_margin_min_window",
    "revenue_drawdown_window",
    "negative_ni_streak",
    "negative_ocf_streak",
]

FEATURE_GROUPS = {
    "ratios_latest": [f"{r}_latest" for r in RATIOS],
    "ratios_yoy": [f"{r}_yoy" for r in RATIOS],
    "growth": [f"{g}_yoy_growth" for g in GROWTH_FIELDS],
    "structure": ["working_capital_to_assets"],
    "stress": ["distress_quarters_in_window", "revenue_cv"],
    "path": list(PATH_FEATURES),
}

FEATURES = (
    [f"{r}_{suffix}" for r in RATIOS for suffix in ("latest", "yoy")]
    + FEATURE_GROUPS["growth"]
    + FEATURE_GROUPS["structure"]
    + FEATURE_GROUPS["stress"]
    + FEATURE_GROUPS["path"]
)

# ---- fixed values: the six stress signals ---------------------------------------------------------
STRESS_SIGNALS = [
    "net_income<0",
    "operating_cash_flow<0",
    "operating_income<0",
    "current_liabilities>current_assets",
    "stockholders_equity<0",
    "revenue_yoy<-5%",
]

# ---- fixed values: windows, thresholds, costs ----------------------------------------------------
LOOKBACK = 8
MIN_HISTORY = 5
FX_RATE = 25000
STRESS_MIN_SIGNALS = 1
FORWARD_HORIZON = 4
ALTMAN_CUT = 1.1
N_TEST, N_VALIDATION, N_PURGE = 8, 4, 1
SPLITS = ["train", "validation", "test", "purged"]
EVAL_THRESHOLDS = [0.30, 0.35, 0.40, 0.50, 0.60, 0.656]
COST_FN, COST_FP = 5.0, 1.0
LAB_COST_FN, LAB_COST_FP = 10.0, 1.0
FBETA = 2.0
PRECISION_TARGET = 0.5
SEED = 42
N_BOOT = 2000
MIN_PAIRS = 30
BANKRUPTCY_ITEM = "1.03"
DISTRESS_ITEMS = ["2.06", "4.01", "4.02"]
QUARTER_DAYS = (80, 100)
YEAR_DAYS = (330, 399)
AUDIT_QUARTER_DAYS = (70, 105)
METHODS = ["instant", "reported_quarter", "reported_first_quarter", "current_ytd_minus_previous_ytd", "absent"]

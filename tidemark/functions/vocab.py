"""Names, word lists, weights, thresholds and patterns that define the results.

Everything in this file is data. Changing an entry changes what the operators compute.
"""

# ---- months -------------------------------------------------------------------------------
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# ---- diffusion-index reports --------------------------------------------------------------
MANUFACTURING_INDICES = [
    "Manufacturing PMI", "New Orders", "Production", "Employment", "Supplier Deliveries",
    "Inventories", "Customers' Inventories", "Prices", "Backlog of Orders",
    "New Export Orders", "Imports",
]
SERVICES_INDICES = [
    "Services PMI", "Business Activity", "New Orders", "Employment", "Supplier Deliveries",
    "Inventories", "Inventory Sentiment", "Prices", "Backlog of Orders",
    "New Export Orders", "Imports",
]
HEADLINE = {"Manufacturing": "Manufacturing PMI", "Services": "Services PMI"}

# positive / negative category of every index; any other index is Growing / Declining
CATEGORIES = {
    "Supplier Deliveries": ("Slower", "Faster"),
    "Inventories": ("Higher", "Lower"),
    "Customers' Inventories": ("Too High", "Too Low"),
    "Inventory Sentiment": ("Too High", "Too Low"),
    "Prices": ("Increasing", "Decreasing"),
}
DEFAULT_CATEGORIES = ("Growing", "Declining")

# short column names of the wide monthly table
SHORT_NAMES = {
    "PMI": "Manufacturing PMI", "New Orders": "New Orders", "Production": "Production",
    "Employment": "Employment", "Deliveries": "Supplier Deliveries", "Inventories": "Inventories",
    "Customer Inv": "Customers' Inventories", "Prices": "Prices",
    "Ord Backlog": "Backlog of Orders", "Exports": "New Export Orders", "Imports": "Imports",
}

MANUFACTURING_INDUSTRIES = [
    "Apparel, Leather & Allied Products", "Chemical Products", "Computer & Electronic Products",
    "Electrical Equipment, Appliances & Components", "Fabricated Metal Products",
    "Food, Beverage & Tobacco Products", "Furniture & Related Products", "Machinery",
    "Miscellaneous Manufacturing", "Nonmetallic Mineral Products", "Paper Products",
    "Petroleum & Coal Products", "Plastics & Rubber Products", "Primary Metals",
    "Printing & Related Support Activities", "Textile Mills", "Transportation Equipment",
    "Wood Products",
]
SERVICES_INDUSTRIES = [
    "Accommodation & Food Services", "Agriculture, Forestry, Fishing & Hunting",
    "Arts, Entertainment & Recreation", "Construction", "Educational Services",
    "Finance & Insurance", "Health Care & Social Assistance", "Information",
    "Management of Companies & Support Services", "Mining",
    "Professional, Scientific & Technical Services", "Public Administration",
    "Real Estate, Rental & Leasing", "Retail Trade", "Transportation & Warehousing",
    "Utilities", "Wholesale Trade", "Other Services",
]

# headline imputation: components averaged when the headline is missing
HEADLINE_COMPONENTS = {
    "Manufacturing": ["New Orders", "Production", "Employment", "Supplier Deliveries", "Inventories"],
    "Services": ["Business Activity", "New Orders", "Employment", "Supplier Deliveries"],
}

# the same quantity under the names of the two report types
EQUIVALENT_INDICES = {
    "Manufacturing PMI": "Services PMI", "Production": "Business Activity",
    "New Orders": "New Orders", "Employment": "Employment",
    "Supplier Deliveries": "Supplier Deliveries", "Inventories": "Inventories",
    "Customers' Inventories": "Inventory Sentiment", "Prices": "Prices",
    "Backlog of Orders": "Backlog of Orders", "New Export Orders": "New Export Orders",
    "Imports": "Imports",
}

# renames applied per report type (old name -> new name)
RENAMES_KEEP_BOTH = {
    "Services": {"Manufacturing PMI": "Services PMI", "Production": "Business Activity",
                 "Customers' Inventories": "Inventory Sentiment"},
    "Manufacturing": {"Services PMI": "Manufacturing PMI"},
}
RENAMES_DROP_OLD = {
    "Services": {"PMI": "Services PMI", "Manufacturing PMI": "Services PMI",
                 "Production": "Business Activity"},
    "Manufacturing": {"PMI": "Manufacturing PMI", "Services PMI": "Manufacturing PMI",
                      "Business Activity": "Production"},
}
REPORT_TYPE_ALIASES = {
    "manufacturing": "Manufacturing", "mfg": "Manufacturing", "man": "Manufacturing",
    "manufacturing pmi": "Manufacturing",
    "services": "Services", "svc": "Services", "service": "Services", "services pmi": "Services",
    "non-manufacturing": "Services",
}

# direction vocabulary
DIRECTION_WORDS = {
    "growing": "Growing", "growth": "Growing", "expanding": "Growing", "expansion": "Growing",
    "increasing": "Growing", "increased": "Growing", "higher": "Growing",
    "contracting": "Contracting", "contraction": "Contracting", "declining": "Contracting",
    "decreased": "Contracting", "decreasing": "Contracting", "lower": "Contracting",
    "slowing": "Slowing", "slower": "Slowing", "faster": "Faster",
    "too high": "Too High", "too low": "Too Low",
}
# the words that levels, changes and directions are told by in report sentences
PERCENT = "percent"
LEVEL_VERBS = ["registering", "registered", "was", "at"]
LEVEL_NOUNS = ["index", "reading"]
LEVEL_SUBJECTS = ["index", "pmi"]
SURE_VERBS = ["registered", "was", "at"]
SURE_ENDS = ["a reading", "an increase", "a decrease"]
CHANGE_VERBS = ["increased", "decreased", "rose", "fell", "up", "down"]
CHANGE_NOUNS = ["change", "increase", "decrease"]
DIRECTION_MENTIONS = [
    "growing", "growth", "expanding", "expansion", "contracting", "contraction", "declining", "increasing",
    "decreasing", "faster", "slower",
]
# the words of glance rows: before the value, and in the last column; the Prices row says Increasing or Decreasing
GLANCE_VERBS = ["at", "was", "registered", "is"]
GLANCE_DIRECTIONS = ["Growing", "Contracting", "Too High", "Too Low", "Slowing", "Faster"]
PRICE_DIRECTIONS = ["Increasing", "Decreasing"]
# the words of sentences that list industries without a list rule
LIST_NOUNS = ["industries", "sectors"]
GROWTH_WORDS = ["growth", "growing", "increased"]
DECLINE_WORDS = ["decline", "contracting", "decreased"]
# indices whose small values are taken for percent changes
CHANGE_PRONE_INDICES = ["New Export Orders", "Supplier Deliveries"]

# report type classifier: keyword weights, structure patterns, industry mentions
TYPE_KEYWORDS = {
    "Manufacturing": {
        "MANUFACTURING PMI": 10, "MANUFACTURING INDEX": 8, "MANUFACTURING ISM": 8,
        "PRODUCTION INDEX": 6, "NEW ORDERS INDEX": 6, "MANUFACTURING SECTOR": 5,
        "MANUFACTURING BUSINESS": 4, "FABRICATED METAL": 3, "PETROLEUM & COAL": 3,
        "COMPUTER & ELECTRONIC PRODUCTS": 3,
    },
    "Services": {
        "SERVICES PMI": 10, "SERVICES INDEX": 8, "SERVICES ISM": 8, "BUSINESS ACTIVITY": 6,
        "NON-MANUFACTURING": 5, "SERVICE SECTOR": 5, "NMI": 4, "INFORMATION": 2,
        "HEALTH CARE": 2, "FINANCE & INSURANCE": 2, "ACCOMMODATION & FOOD SERVICES": 2,
        "SERVICE MANAGEMENT": 2,
    },
}
TYPE_STRUCTURES = {
    "Manufacturing": [
        r"MANUFACTURING AT A GLANCE", r"MANUFACTURING INDEX SUMMARIES",
        r"MANUFACTURING PMI®\s+AT\s+\d+\.\d+",
        r"COMMODITIES UP IN PRICE.*?COMMODITIES DOWN IN PRICE",
    ],
    "Services": [
        r"SERVICES AT A GLANCE", r"SERVICES INDEX SUMMARIES",
        r"SERVICES PMI®\s+AT\s+\d+\.\d+",
        r"SERVICE COMMODITIES UP IN PRICE.*?SERVICE COMMODITIES DOWN IN PRICE",
        r"BUSINESS ACTIVITY/PRODUCTION",
    ],
}
TYPE_INDUSTRIES = {
    "Manufacturing": [
        "CHEMICAL", "COMPUTER & ELECTRONIC", "FABRICATED METAL", "FOOD, BEVERAGE", "MACHINERY",
        "PETROLEUM & COAL", "PLASTICS & RUBBER", "PRIMARY METALS", "TRANSPORTATION EQUIPMENT",
        "WOOD", "NONMETALLIC MINERAL", "PAPER", "PRINTING", "APPAREL", "TEXTILE",
        "ELECTRICAL EQUIPMENT",
    ],
    "Services": [
        "FINANCE & INSURANCE", "HEALTH CARE", "INFORMATION", "PROFESSIONAL SERVICES",
        "ACCOMMODATION & FOOD", "EDUCATIONAL SERVICES", "UTILITIES", "RETAIL TRADE",
        "WHOLESALE TRADE", "REAL ESTATE", "TRANSPORTATION & WAREHOUSING",
        "PUBLIC ADMINISTRATION", "AGRICULTURE", "MINING", "MANAGEMENT",
    ],
}
TYPE_SCORE_WEIGHTS = (0.5, 0.3, 0.2)
# the quick vote: five phrases per side, presence only
TYPE_VOTE_WORDS = {
    "Services": ["SERVICES PMI", "SERVICES ISM", "SERVICES INDEX", "NON-MANUFACTURING",
                 "BUSINESS ACTIVITY"],
    "Manufacturing": ["MANUFACTURING PMI", "MANUFACTURING ISM", "MANUFACTURING INDEX",
                      "PRODUCTION INDEX", "NEW ORDERS INDEX"],
}

# ---- news ---------------------------------------------------------------------------------
PREMIUM_SOURCES = {
    "bloomberg.com": 18, "reuters.com": 18, "wsj.com": 17, "ft.com": 16, "nytimes.com": 20,
    "cnbc.com": 12, "marketwatch.com": 12, "barrons.com": 14, "economist.com": 13,
    "fortune.com": 10, "businessinsider.com": 8,
}
UNWANTED_SOURCES = {
    "benzinga.com": -5, "fool.com": -5, "zacks.com": -5, "investorplace.com": -4,
    "thestreet.com": -4,
}
UNKNOWN_SOURCE_WEIGHT = 0.3
FINANCE_KEYWORDS = {
    "earnings": 1.0, "revenue": 1.0, "profit": 0.9, "eps": 1.0, "guidance": 0.9, "forecast": 0.8,
    "outlook": 0.8, "analyst": 0.9, "rating": 0.8, "target": 0.8, "upgrade": 0.9,
    "downgrade": 0.9, "stock": 0.7, "shares": 0.7, "price": 0.6, "market": 0.5,
    "acquisition": 1.0, "merger": 1.0, "deal": 0.8, "investment": 0.8, "ceo": 0.8, "cfo": 0.8,
    "management": 0.7, "board": 0.7, "product": 0.6, "launch": 0.7, "partnership": 0.7,
}
FINANCE_PATTERNS = [
    r"\$[\d,]+(?:\.\d+)?[kmb]?", r"\d+(?:\.\d+)?%", r"q[1-4]\s+\d{4}", r"fy\s*\d{4}",
    r"\d+\.\d+\s*eps",
]
BUSINESS_PHRASES = [
    "quarterly results", "annual report", "sec filing", "press release", "financial results",
    "business update", "market share", "competitive",
]
NEGATIVE_INDICATORS = [
    "job", "career", "hiring", "apply", "employment", "work at", "directory", "listing",
    "yellow pages", "contact us",
]
SOURCE_TYPE_QUALITY = {"alphavantage_premium": 0.4, "nyt_api": 0.3, "rss_feed": 0.2}
SCORE_KEYWORDS = ["earnings", "revenue", "stock", "analyst", "price target"]
BACKFILL_KEYWORDS = ["stock", "earnings", "revenue", "analyst", "investment"]
RSS_FINANCE_WORDS = ["stock", "earnings", "revenue", "business", "financial"]
# words that count as a mention although the company name itself is absent
COMPANY_SYNONYMS = {"apple": ["apple", "aapl", "iphone", "ios", "mac"]}
COMPANY_SUFFIXES = [" Inc", " Corp", " Corporation", " Company", " Ltd", " Limited"]
COMPANY_ALIASES = {
    "apple": ("AAPL", "Apple Inc"), "microsoft": ("MSFT", "Microsoft Corporation"),
    "google": ("GOOGL", "Alphabet Inc"), "alphabet": ("GOOGL", "Alphabet Inc"),
    "amazon": ("AMZN", "Amazon.com Inc"), "tesla": ("TSLA", "Tesla Inc"),
    "meta": ("META", "Meta Platforms Inc"), "facebook": ("META", "Meta Platforms Inc"),
    "nvidia": ("NVDA", "NVIDIA Corporation"), "netflix": ("NFLX", "Netflix Inc"),
    "adobe": ("ADBE", "Adobe Inc"), "salesforce": ("CRM", "Salesforce Inc"),
    "oracle": ("ORCL", "Oracle Corporation"), "intel": ("INTC", "Intel Corporation"),
    "amd": ("AMD", "Advanced Micro Devices"), "cisco": ("CSCO", "Cisco Systems"),
    "jpmorgan": ("JPM", "JPMorgan Chase & Co"), "jp morgan": ("JPM", "JPMorgan Chase & Co"),
    "bank of america": ("BAC", "Bank of America Corp"),
    "wells fargo": ("WFC", "Wells Fargo & Company"),
    "goldman sachs": ("GS", "Goldman Sachs Group"), "morgan stanley": ("MS", "Morgan Stanley"),
    "visa": ("V", "Visa Inc"), "mastercard": ("MA", "Mastercard Inc"),
    "johnson & johnson": ("JNJ", "Johnson & Johnson"), "pfizer": ("PFE", "Pfizer Inc"),
    "walmart": ("WMT", "Walmart Inc"), "coca cola": ("KO", "Coca-Cola Company"),
    "pepsi": ("PEP", "PepsiCo Inc"), "nike": ("NKE", "Nike Inc"),
    "boeing": ("BA", "Boeing Company"), "general electric": ("GE", "General Electric"),
    "exxon": ("XOM", "Exxon Mobil Corporation"), "chevron": ("CVX", "Chevron Corporation"),
}
TITLE_SIMILARITY = 0.7
TARGET_ARTICLES = 30
EMPTY_SECTION = "No significant developments identified in this category."
DATE_META_TAGS = [
    ("property", "article:published_time"), ("itemprop", "datePublished"), ("name", "dc.date"),
    ("name", "date"), ("name", "pubdate"), ("name", "publish_date"),
    ("name", "article:published_time"),
]

# ---- retired news rules -------------------------------------------------------------------
AMBIGUOUS_TICKERS = [
    "ONTO", "INTO", "WITH", "FROM", "OVER", "UNDER", "ABOVE", "BELOW", "ALL", "ANY", "SOME",
    "MOST", "MANY", "FEW", "MORE", "LESS", "BIG", "SMALL", "HIGH", "LOW", "NEW", "OLD", "GOOD",
    "BAD", "UP", "DOWN", "IN", "OUT", "ON", "OFF", "AT", "BY", "TO", "FOR",
]
# {t} stands for the lower-case ticker
OBVIOUS_PREPOSITION_PHRASES = [
    "off the pitch and {t} the", "{t} the catwalk", "{t} the runway", "{t} the stage",
    "{t} the field", "{t} the court", "pass {t} his", "pass {t} her", "give {t} to",
]
LIKELY_PREPOSITION_PHRASES = [
    "pass {t}", "move {t}", "sign {t}", "put {t}", "get {t}", "take {t}", "bring {t}", "send {t}",
    "give {t}", "{t} the", "{t} his", "{t} her", "{t} their", "{t} someone", "{t} others",
]
NON_BUSINESS_SECTIONS = ["sports", "fashion", "style", "arts", "entertainment", "travel", "food"]
BUSINESS_WORDS = ["stock", "company", "business", "financial", "ceo", "cfo", "earnings"]
ENHANCED_SOURCE_WEIGHTS = {
    "alphavantage_premium": 2.0, "nyt_api": 1.8, "rss_feed": 1.5, "google_search": 1.0,
}
ENHANCED_PREMIUM = ["bloomberg.com", "reuters.com", "wsj.com", "ft.com", "nytimes.com"]
RETIRED_FINANCE_WORDS = [
    "earnings", "revenue", "stock", "shares", "analyst", "price", "market", "business",
    "financial", "investment", "profit", "sales", "growth",
]
RETIRED_NEGATIVE_WORDS = ["jobs", "careers", "hiring", "apply", "work at", "directory"]
QUALITY_TERMS = ["revenue", "margin", "eps", "ebitda", "guidance", "target", "estimate", "%", "$"]
QUANTIFIED_PATTERNS = [
    r"\d+[\-–]\d+%", r"\$\d+[kmb]?", r"\d+\.\d+x", r"\d+%\s+(probability|chance|confidence)",
    r"Q[1-4]\s+\d{4}",
]

# ---- portfolios and companies -------------------------------------------------------------
TRADING_DAYS = 252
RISK_FREE_PCT = 4.5
SCENARIO_ACTIONS = ["trim_25", "trim_50", "exit", "add_10"]
ATTRIBUTION_PERIODS = ["30d", "90d", "ytd", "1y"]

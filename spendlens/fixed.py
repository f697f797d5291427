"""Word lists, patterns and tables that results depend on."""

from __future__ import annotations

# Category labels in id order (id = position).
CATEGORIES = [
    "Food & Dining",
    "Transportation",
    "Shopping & Retail",
    "Entertainment & Recreation",
    "Healthcare & Medical",
    "Utilities & Services",
    "Financial Services",
    "Income",
    "Government & Legal",
    "Charity & Donations",
]

# Whole-text markers of the cleaner, first hit wins.
CLEAN_MARKERS = [
    (r"^AMZN\s*MKTP", "AMAZON MARKETPLACE"),
    (r"E[- ]?TRANSFER\s*-?\s*(AUTODEPOSIT|RECEIVED|FROM\b)", "E-TRANSFER-IN"),
    (r"E[- ]?TRANSFER\s*-?\s*(SENT|TO\b)", "E-TRANSFER-OUT"),
    (r"^ATM\s*WITHDRAWAL", "ATM-WITHDRAWAL"),
    (r"^MOBILE\s*CHEQUE\s*DEPOSIT", "MOBILE-DEPOSIT"),
    (r"^CLIENT\s*CARD\s*REPLACEMENT\s*FEE", "CARD-REPLACEMENT-FEE"),
]

# Provinces and territories stripped from the end of a text.
PROVINCES = "(ON|QC|BC|AB|MB|SK|NS|NB|NL|PE|YT|NT|NU)"

# The cleaner's replacements in order. RE2-safe (no look-around).
CLEAN_STEPS = [
    (r"^(CONTACTLESS\s*)?INTERAC\s*(PURCHASE)?\s*(REFUND)\s*-\s*", "REFUND - "),
    (
        r"^(POS\s*PURCHASE|(CONTACTLESS\s*)?INTERAC\s*PURCHASE|VISA\s*DEBIT\s*PURCHASE"
        r"|ONLINE\s*BANKING\s*PAYMENT)\s*-?\s*([0-9]+\s+)?",
        "",
    ),
    (
        r"^(PAY/PAIE|INTERNET\s*BILL\s*PMT|PRE-?AUTHORIZED\s*(DEBIT|PAYMENT)|BILL\s*PAYMENT"
        r"|RECURRING\s*PAYMENT|MISC\s*PAYMENT|PAYROLL\s*DEPOSIT|CANADA\s*CARBON\s*REBATE)\s+",
        "",
    ),
    (r"^REFUND\s*-\s*([0-9]+\s+)?", ""),
    (r"^TFR-(TO|FR)\s+", "TRANSFER "),
    (r"^TST-\s*", ""),
    (r"^SQ\s*\*\s*", ""),
    (r"^\*[A-Z]+-", ""),
    (r"^[0-9]{4,}\s+", ""),
    (r"\*X{3,}", " "),
    (r"#[0-9]+", " "),
    (r"\b[0-9]{3,}\b", " "),
    (r"[^\p{L}0-9&'./ -]", " "),
    (r"\s+", " "),
    (r"\s+[A-Z]+\s+" + PROVINCES + r"(\s+CA)?\s*$", ""),
    (r"\s+" + PROVINCES + r"\s*$", ""),
    (r"\s+", " "),
]

# Direction patterns on the upper-cased raw text, first hit wins.
DIRECTION_PATTERNS = [
    (r"^PAYROLL\s*DEPOSIT", "Income"),
    (r"DIRECT\s*DEPOSIT", "Income"),
    (r"E-?\s*TRANSFER\s*-?\s*(AUTODEPOSIT|RECEIVED)", "Income"),
    (r"\bGST\b", "Government & Legal"),
    (r"TAX\s*REFUND", "Government & Legal"),
    (r"CANADA\s*CARBON\s*REBATE", "Government & Legal"),
    (r"^CRA\b", "Government & Legal"),
]

# Structural rules in file order as (pattern, category, type, priority).
RULES = [
    ("E-TRANSFER-OUT", "Financial Services", "contains", 200),
    ("TRANSFER", "Financial Services", "contains", 100),
    ("MORTGAGE", "Financial Services", "contains", 150),
    (r"LOAN\s*(PMT|PAYMENT)", "Financial Services", "regex", 150),
    (r"CREDIT\s*CARD\s*(PMT|PAYMENT)", "Financial Services", "regex", 150),
    ("NSF", "Financial Services", "contains", 100),
    ("OVERDRAFT", "Financial Services", "contains", 100),
    (r"SERVICE\s*CHARGE", "Financial Services", "regex", 100),
    ("MONTHLY FEE", "Financial Services", "contains", 100),
    ("E-TRANSFER-IN", "Income", "contains", 200),
    ("PAYROLL", "Income", "contains", 200),
    ("SALARY", "Income", "contains", 200),
    ("DEPOSIT", "Income", "contains", 100),
    ("REFUND", "Income", "contains", 100),
    (r"CASH\s*BACK", "Income", "regex", 90),
    (r"CRA\b", "Government & Legal", "regex", 100),
    (r"CANADA\s*REVENUE", "Government & Legal", "regex", 100),
    (r"SERVICE\s*CANADA", "Government & Legal", "regex", 100),
    (r"SERVICE\s*ONTARIO", "Government & Legal", "regex", 100),
    (r"GOV\s*(OF|'T)", "Government & Legal", "regex", 100),
    (r"TAX\b", "Government & Legal", "regex", 80),
    ("PARKING", "Transportation", "contains", 100),
    ("PHARMACY", "Healthcare & Medical", "contains", 100),
    ("DENTAL", "Healthcare & Medical", "contains", 100),
    ("HOSPITAL", "Healthcare & Medical", "contains", 100),
    ("CLINIC", "Healthcare & Medical", "contains", 80),
    ("OPTOM", "Healthcare & Medical", "contains", 100),
    ("GYM", "Entertainment & Recreation", "contains", 80),
    ("FITNESS", "Entertainment & Recreation", "contains", 80),
]

# Single descriptor words and their hints.
DESCRIPTOR_WORDS = {
    "GAS": "gas station, fuel",
    "GASOLINE": "gas station, fuel",
    "FUEL": "gas station, fuel",
    "WHOLESALE": "wholesale warehouse shopping",
    "GROCERY": "grocery food retail",
    "GROCERIES": "grocery food retail",
    "SUPERMARKET": "supermarket grocery",
    "RESTAURANT": "dining restaurant",
    "CAFE": "cafe coffee shop",
    "COFFEE": "coffee shop cafe",
    "BAKERY": "bakery baked goods",
    "PIZZA": "pizza restaurant",
    "GRILL": "grill restaurant dining",
    "SHAWARMA": "shawarma restaurant dining",
    "SUSHI": "sushi restaurant dining",
    "CHICKEN": "chicken restaurant dining",
    "BURRITO": "burrito restaurant dining",
    "DOWNLOADS": "digital content downloads",
    "DOWNLOAD": "digital content downloads",
    "PRIME": "subscription membership service",
    "TUITION": "education tuition fees",
    "INSURANCE": "insurance coverage",
    "ELECTRONICS": "electronics retail",
    "CLOTHING": "clothing apparel retail",
    "FURNITURE": "furniture home retail",
    "HARDWARE": "hardware tools retail",
    "BOOKS": "bookstore retail",
    "SHIPPING": "shipping delivery service",
    "LAUNDRY": "laundry cleaning service",
    "BARBER": "barbershop hair service",
    "SALON": "salon beauty service",
    "VENDING": "vending machine snacks",
    "CONV.": "convenience store snacks",
    "CONV": "convenience store snacks",
    "CONVENIENCE": "convenience store snacks",
}

# Two-word descriptor phrases and their hints, in order.
DESCRIPTOR_PHRASES = {
    "WEB SERVICES": "cloud computing, technology services",
    "WEB SERV": "cloud computing, technology services",
    "DRUG MART": "pharmacy drugstore",
    "GAS BAR": "gas station, fuel",
    "COIN WASH": "laundry cleaning service",
    "FINE FOODS": "specialty food retail",
}

# Location tokens. The two-word name can never equal one token.
LOCATIONS = [
    "OTTAWA", "TORONTO", "MONTREAL", "VANCOUVER", "CALGARY", "EDMONTON",
    "WINNIPEG", "QUEBEC", "HAMILTON", "KITCHENER", "LONDON", "VICTORIA",
    "HALIFAX", "REGINA", "SASKATOON", "BARRIE", "GUELPH", "KINGSTON",
    "MISSISSAUGA", "BRAMPTON", "MARKHAM", "RICHMOND", "SURREY", "BURNABY",
    "KANATA", "NEPEAN", "ORLEANS", "BARRHAVEN", "STITTSVILLE", "GLOUCESTER",
    "GATINEAU", "HULL", "LAVAL", "LONGUEUIL", "SCARBOROUGH", "ETOBICOKE",
    "BAYSHORE", "RIDEAU", "DOWNTOWN", "MIDTOWN", "UPTOWN",
    "HALTON", "OAKVILLE", "BURLINGTON", "OSHAWA", "WHITBY", "AJAX",
    "PICKERING", "NEWMARKET", "VAUGHAN", "THORNHILL", "RICHMOND HILL",
    "CAMPBELL", "STITTSVILL",
]

# Noise tokens (short codes, digits, branch codes).
NOISE_PATTERN = r"^([A-Z]?[0-9]+|[A-Z]{1,2}|#[0-9]+)$"

# Hints that settle a category on their own.
OVERRIDE_HINTS = {
    "gas station, fuel": "Transportation",
    "cloud computing, technology services": "Utilities & Services",
    "digital content downloads": "Entertainment & Recreation",
    "pharmacy drugstore": "Healthcare & Medical",
    "grocery food retail": "Food & Dining",
}

# Label keywords per category, in table order.
LABEL_KEYWORDS = {
    "Food & Dining": [
        "DINING AND DRINKING", "RESTAURANT", "CAFE", "COFFEE", "TEA HOUSE", "BAKERY",
        "BUBBLE TEA", "FOOD AND BEVERAGE RETAIL", "FOOD AND BEVERAGE SERVICE",
        "FOOD SERVICE", "GROCERY", "SUPERMARKET", "DELI", "BUTCHER", "ICE CREAM",
        "PIZZA", "BURGER", "FAST FOOD", "SANDWICH", "CONVENIENCE STORE", "DESSERT",
        "JUICE", "BISTRO", "STEAKHOUSE", "SEAFOOD", "NOODLE", "SUSHI", "DONUT", "BAGEL",
        "BREAKFAST", "BRUNCH", "WINGS", "BBQ", "RAMEN", "POKE", "SOUP", "FOOD TRUCK",
        "CATERING",
    ],
    "Transportation": [
        "TRANSPORTATION", "GAS STATION", "FUEL STATION", "PARKING", "CAR WASH", "TRANSIT",
        "AIRPORT", "TRAIN STATION", "BUS STATION", "REST AREA",
    ],
    "Shopping & Retail": [
        "RETAIL", "STORE", "SHOP", "CLOTHING", "ELECTRONICS", "DEPARTMENT STORE",
        "BOOKSTORE", "FURNITURE", "DISCOUNT STORE", "JEWELRY", "SHOPPING MALL",
        "WAREHOUSE", "WHOLESALE", "THRIFT", "VINTAGE", "GIFT", "PET STORE",
        "SPORTING GOODS", "TOY", "COSMETICS", "MISCELLANEOUS STORE",
    ],
    "Entertainment & Recreation": [
        "ARTS AND ENTERTAINMENT", "MOVIE THEATER", "MUSEUM", "GYM", "FITNESS",
        "SPORTS AND RECREATION", "RECREATION", "ARCADE", "NIGHT CLUB", "MUSIC VENUE",
        "CASINO", "BOWLING", "AMUSEMENT", "THEME PARK", "PERFORMING ARTS", "CONCERT",
        "STADIUM", "ARENA", "GAMING",
    ],
    "Healthcare & Medical": [
        "HEALTH AND MEDICINE", "PHARMACY", "DENTAL", "HOSPITAL", "DOCTOR", "CLINIC",
        "MEDICAL", "OPTICAL", "OPTOMETRIST", "VETERINARIAN", "PHYSIOTHERAPY",
        "CHIROPRACT", "MENTAL HEALTH",
    ],
    "Utilities & Services": [
        "UTILITY", "TELECOMMUNICATION", "INTERNET SERVICE PROVIDER", "REPAIR", "LAUNDRY",
        "DRY CLEANER", "HOME SERVICE", "HOME IMPROVEMENT SERVICE", "POST OFFICE",
        "SHIPPING", "BARBER", "SALON", "CLEANING SERVICE", "CONTRACTOR", "PLUMBER",
        "ELECTRICIAN", "LOCKSMITH", "TAILOR", "PRINTING", "MOVING", "STORAGE",
    ],
    "Financial Services": [
        "FINANCIAL SERVICE", "BANK", "ATM", "INSURANCE", "CREDIT UNION",
        "CURRENCY EXCHANGE", "LOAN", "ACCOUNTING", "TAX PREPARATION",
    ],
    "Government & Legal": [
        "GOVERNMENT", "LEGAL SERVICE", "COURTHOUSE", "EMBASSY", "EDUCATION", "COLLEGE",
        "UNIVERSITY", "SCHOOL",
    ],
    "Charity & Donations": [
        "NONPROFIT", "SOCIAL SERVICE", "RELIGIOUS ORGANIZATION", "CHARITY",
        "COMMUNITY CENTER", "SPIRITUAL CENTER", "CHURCH", "MOSQUE", "SYNAGOGUE", "TEMPLE",
        "PLACE OF WORSHIP",
    ],
}

# Keywords that only weigh 1.0 instead of 2.0.
GENERIC_KEYWORDS = ["RETAIL", "STORE", "SHOP", "SERVICE", "CENTER", "CENTRE"]

# Automotive service keywords, counted for Transportation first.
AUTOMOTIVE_KEYWORDS = [
    "AUTOMOTIVE SERVICE", "AUTOMOTIVE REPAIR", "TIRE", "OIL CHANGE", "AUTO BODY",
]

# Smallest share the winning category of a label list must hold.
LABEL_SHARE = 0.40

# Words one of which a statement page must hold.
PAGE_WORDS = [
    "date", "description", "activity", "withdrawal", "deposit", "amount", "posting",
    "transaction",
]

# Statement line shapes.
CARD_DATE = r"^(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+[0-9]{1,2}$"
CARD_LEADING_DATE = r"^(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+[0-9]{1,2}\s+"
ACCOUNT_DATE = r"(?i)^[0-9]{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)$"
REFERENCE_NUMBER = r"^[0-9]{15,}$"
AMOUNT_LINE = r"^-?\$?[0-9,]+\.[0-9]{2}$"
FOREX_LINE = r"(?i)^(Foreign Currency|Exchange rate)"
CARD_REWARD_LINE = (
    r"(?i)^(CASH (ADVANCE|BACK) (INTEREST|REWARD)|Previous Cash Back|Cash Back on|New Cash Back)"
)

# Header lines skipped on card and account statements.
CARD_HEADERS = ["TRANSACTION POSTING", "ACTIVITY DESCRIPTION", "AMOUNT ($)", "DATE"]
ACCOUNT_HEADERS = [
    "Date", "Description", "Withdrawals ($)", "Deposits ($)", "Balance ($)",
    "Opening Balance", "Closing Balance", "Details of your account activity",
    "Details of your account activity - continued",
]

# Lines that start or end the activity section.
CARD_START = "ACTIVITY DESCRIPTION"
CARD_STOPS = [
    "TOTAL ACCOUNT BALANCE", "Time to Pay", "CASH BACK SUMMARY", "IMPORTANT INFORMATION",
    "CONTACT US", "PAYMENTS & INTEREST RATES", "Thank you for choosing",
]
ACCOUNT_STARTS = ["Opening Balance", "Details of your account activity"]
ACCOUNT_STOP_INSIDE = "Closing Balance"
ACCOUNT_STOP_START = "Please check"

# Boilerplate line patterns. Patterns that name an account
# holder, a card or a street are the caller's (`extra_boilerplate`).
BOILERPLATE = [
    r"(?i)^RBC.*Mastercard",
    r"^[0-9]+ OF [0-9]+$",
    r"^STATEMENT FROM",
    r"^Thank you for choosing",
    r"^PRIMARY \(continued\)",
    r"^[0-9]+ of [0-9]+$",
    r"^Royal Bank of Canada",
    r"^C\.P\. [0-9]+",
    r"^Your RBC personal",
    r"^From \w+ [0-9]+",
    r"^Your account number",
    r"^How to reach us",
    r"^1-800-",
    r"^www\.",
    r"^https://",
    r"^RBPDA",
    r"^\*[0-9]+[A-Z]",
    r"^Your (opening|closing) balance",
    r"^Total (deposits|withdrawals)",
    r"^[=+\-] ?\$",
    r"^Summary of your account",
    r"^RBC Advantage Banking",
    r"^[0-9]+ [A-Z]+ RD,",
    r"^Please check this",
    r"^If you opted",
    r"^indicate that",
    r"^Please retain",
    r"^.Registered trade",
    r"^Royal Bank of Canada GST",
    r"^Royal Trust",
    r"^The Royal Trust",
    r"^Important information",
    r"^Protect your PIN",
    r"^Never share",
    r"^Cover the key",
    r"^Here are four ways",
    r"^[a-d]\) ",
    r"^or send a text",
    r"^company or agency",
    r"^or a gift card",
    r"^of a higher amount",
    r"^Stay Informed",
    r"^Quick, convenient",
    r"^Other payment options",
    r"^RBC Royal Bank ATM",
    r"^RBC Online Banking",
    r"^RBC Mobile app",
    r"^Earn [0-9]+%",
    r"^For all other purchases",
    r"^backI",
    r"^IRestrictions",
    r"^Visit www",
    r"^RBC ROYAL BANK$",
    r"^CREDIT CARD PAYMENT",
    r"^P\.O\.BOX",
    r"^TORONTO, ONTARIO",
    r"^NEW BALANCE$",
    r"^MINIMUM PAYMENT$",
    r"^PAYMENT DUE DATE$",
    r"^AMOUNT PAID$",
    r"^\$$",
    r"^01[0-9]{4}$",
    r"^[A-Za-z0-9]{10,14}$",
]

"""Seed merchants of the knowledge base.

Each row is (canonical name, aliases, category, mapping confidence, description).
"""

SEED_SOURCE = "curated_public"

SEEDS = [
    ("REAL CANADIAN SUPERSTORE", ["RCSS SOUTH KANATA", "RCSS"], "Food & Dining", 0.88,
     "grocery supermarket and food retailer in Canada"),
    ("QUICKIE", ["QUICKIE"], "Food & Dining", 0.78,
     "Canadian convenience store chain selling snacks, drinks, and quick grocery items"),
    ("HOT CRISPY CHICKEN", ["HOT CRISPY CHICKEN"], "Food & Dining", 0.97,
     "fast casual chicken restaurant"),
    ("RED SWAN PIZZA", ["RED SWAN PIZZA"], "Food & Dining", 0.98,
     "pizza restaurant and takeout chain"),
    ("MAC'S CONVENIENCE STORE", ["MACS CONV. STORE", "MACS CONV"], "Food & Dining", 0.78,
     "convenience store selling snacks, drinks, and quick grocery items"),
    ("RANG DE INDIAN CUISINE", ["RANG DE INDIAN CUISINE"], "Food & Dining", 0.98,
     "Indian restaurant"),
    ("BOURBON ST GRILL", ["RIDEAU BOURBON ST. GRI"], "Food & Dining", 0.95,
     "quick service grill restaurant in shopping malls"),
    ("TAHINI'S", ["TAHINIS - EA"], "Food & Dining", 0.97,
     "Mediterranean and shawarma restaurant chain"),
    ("O-FRANGO", ["O-FRANGO"], "Food & Dining", 0.95,
     "restaurant focused on grilled chicken meals"),
    ("WALMART SUPERCENTRE", ["WMT SUPRCTR"], None, 0.0,
     "Walmart supercentre with department store and grocery supermarket shopping"),
    ("KINDLE UNLIMITED", ["KINDLE UNLTD"], "Entertainment & Recreation", 0.85,
     "digital books and reading subscription service"),
    ("FIT4LESS", ["FIT4LESS"], "Entertainment & Recreation", 0.97,
     "budget gym and fitness club"),
    ("REAL FRUIT BUBBLE TEA", ["REAL FRUIT BUBBLE TEA", "REAL FRUIT BUBB"], "Food & Dining", 0.98,
     "bubble tea shop and cafe"),
    ("SIMBAD BAKERY", ["SIMBAD BAKERY", "SIMBAD BAKERY AND PERS"], "Food & Dining", 0.96,
     "bakery and prepared food shop"),
    ("SHAWARMA PRINCE", ["SHAWARMA PRINCE"], "Food & Dining", 0.98,
     "shawarma restaurant"),
    ("OPENAI CHATGPT", ["OPENAI CHATGPT"], "Utilities & Services", 0.84,
     "software subscription for AI assistant and online productivity service"),
    ("BARBERHOLIC BARBER", ["BARBERHOLIC BARBER"], "Utilities & Services", 0.91,
     "barbershop and hair care service"),
    ("SUSHI EKI", ["SUSHI EKI"], "Food & Dining", 0.98,
     "sushi restaurant"),
    ("D SPOT DESSERTS", ["D SPOT DESSERTS KANATA"], "Food & Dining", 0.97,
     "dessert restaurant and cafe"),
    ("COCO FRESH TEA & JUICE", ["COCO FRESH TEA & JUICE"], "Food & Dining", 0.98,
     "bubble tea and juice shop"),
    ("OSMOW'S", ["OSMOW'S"], "Food & Dining", 0.97,
     "shawarma and Mediterranean restaurant chain"),
    ("KETTLEMAN'S BAGEL", ["KETTLEMANS BAGEL - KAN"], "Food & Dining", 0.97,
     "bagel bakery and deli"),
    ("NO FORKS GIVEN", ["NO FORKS GIVEN"], "Food & Dining", 0.94,
     "restaurant and takeout food business"),
    ("THE FRY", ["THE FRY"], "Food & Dining", 0.97,
     "fried chicken restaurant"),
    ("RIDEAU CENTRE", ["RIDEAU CENTRE"], "Shopping & Retail", 0.96,
     "shopping mall and retail centre"),
    ("TEALIVE", ["TEALIVE"], "Food & Dining", 0.97,
     "bubble tea and beverage shop"),
    ("BARBURRITO", ["BAR BURRITO RESTAURANT"], "Food & Dining", 0.98,
     "Mexican restaurant and burrito chain"),
    ("UNIVERSITY OF OTTAWA", ["HTSP- UNIV OTTAWA"], None, 0.0,
     "public university with tuition, residence, and student fee payments"),
    ("RBC CREDIT CARD", ["RBC CREDIT CARD"], "Financial Services", 0.95,
     "banking credit card account or card payment"),
    ("CIBC CARD PAYMENT", ["CIBC CPD"], "Financial Services", 0.90,
     "banking card payment or credit account activity"),
    ("AMAZON MARKETPLACE", ["AMZN MKTP CA"], "Shopping & Retail", 0.95,
     "online retail marketplace"),
    ("Z3 SPECIALTY COFFEE", ["Z3 SPECIALTY COFFE"], "Food & Dining", 0.92,
     "specialty coffee shop and cafe"),
]

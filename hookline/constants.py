"""Constants of the URL threat rules.

Everything between the two FIXED VALUES markers must equal the values of the
original rules for the results to match: word lists, brand lists (in order —
several operators take the *first* brand that matches), TLD lists, legitimate
domains, substitution maps, thresholds and override probabilities.  They are
written out plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original rules) — begin
# ---------------------------------------------------------------------------

CLASSES = ["benign", "defacement", "malware", "phishing"]

# Brand keywords, ordered (62).
BRAND_KEYWORDS = [
    "google", "gmail", "facebook", "instagram", "whatsapp", "amazon",
    "microsoft", "apple", "icloud", "paypal", "netflix", "twitter",
    "linkedin", "youtube", "reddit", "tiktok", "pinterest", "snapchat",
    "flipkart", "paytm", "phonepe", "myntra", "snapdeal", "nykaa", "meesho",
    "icici", "hdfc", "sbi", "axis", "kotak", "pnb", "canara", "bob",
    "swiggy", "zomato", "ola", "uber", "makemytrip", "goibibo", "irctc",
    "ebay", "etsy", "yahoo", "github", "stackoverflow", "medium", "wordpress",
    "shopify", "adobe", "salesforce", "spotify", "zoom", "dropbox", "wikipedia",
    "chase", "wellsfargo", "citibank", "bankofamerica",
    "dhl", "fedex", "ups", "usps",
]

# Legitimate registrable domains (143), in the order they are written.
LEGITIMATE_DOMAINS = [
    "google.com", "google.co.in", "google.co.uk", "google.ca", "google.de",
    "google.fr", "google.com.au", "google.co.jp", "google.com.br",
    "gmail.com", "googleusercontent.com", "gstatic.com", "googleapis.com",
    "google-analytics.com", "googlevideo.com", "googletagmanager.com",
    "facebook.com", "fb.com", "fbcdn.net", "facebook.net",
    "instagram.com", "cdninstagram.com",
    "whatsapp.com", "whatsapp.net",
    "amazon.com", "amazon.in", "amazon.co.uk", "amazon.de", "amazon.fr",
    "amazon.ca", "amazon.com.au", "amazon.co.jp", "amazon.com.br",
    "amazonws.com", "amazonaws.com", "cloudfront.net", "awsstatic.com",
    "microsoft.com", "live.com", "outlook.com", "office.com", "office365.com",
    "microsoft.net", "microsoftonline.com", "azure.com", "visualstudio.com",
    "apple.com", "icloud.com", "apple.co", "me.com", "mac.com",
    "paypal.com", "paypal.me", "paypalobjects.com",
    "netflix.com", "nflxext.com", "nflxvideo.net", "nflximg.net",
    "twitter.com", "t.co", "twimg.com",
    "linkedin.com", "licdn.com",
    "youtube.com", "youtu.be", "ytimg.com", "youtube-nocookie.com",
    "reddit.com", "redd.it", "redditmedia.com",
    "tiktok.com", "tiktokcdn.com",
    "pinterest.com", "pinimg.com",
    "snapchat.com",
    "flipkart.com", "flipkart.net",
    "paytm.com", "paytmbank.com",
    "phonepe.com",
    "myntra.com",
    "snapdeal.com",
    "nykaa.com",
    "meesho.com",
    "ajio.com",
    "icicibank.com", "icicibank.co.in",
    "hdfcbank.com", "hdfcbank.co.in",
    "sbi.co.in", "onlinesbi.com", "onlinesbi.sbi",
    "axisbank.com", "axisbank.co.in",
    "kotak.com", "kotakbank.com",
    "pnbindia.in",
    "canarabank.in",
    "bankofbaroda.in",
    "unionbankofindia.co.in",
    "idbi.com",
    "swiggy.com", "swiggy.in",
    "zomato.com",
    "ola.cab", "olacabs.com",
    "uber.com",
    "makemytrip.com",
    "goibibo.com",
    "irctc.co.in", "irctc.com",
    "uidai.gov.in",
    "epfindia.gov.in",
    "chase.com", "wellsfargo.com", "bankofamerica.com", "citibank.com",
    "usbank.com", "capitalone.com",
    "ebay.com", "etsy.com",
    "yahoo.com", "yimg.com",
    "github.com", "githubusercontent.com",
    "stackoverflow.com", "stackexchange.com",
    "medium.com",
    "wordpress.com", "wordpress.org",
    "shopify.com",
    "adobe.com",
    "salesforce.com",
    "spotify.com", "scdn.co",
    "zoom.us",
    "dropbox.com",
    "wikipedia.org", "wikimedia.org",
    "dhl.com", "fedex.com", "ups.com", "usps.com",
]

# TLD lists of the 66-column feature set.  Three suspicious lists differ.
HIGH_TRUST_TLDS = ["com", "org", "net", "edu", "gov", "mil", "in", "co.in", "ac.in", "gov.in"]
SUSPICIOUS_TLDS_CATEGORY = ["tk", "ml", "ga", "cf", "gq", "pw", "cc", "top", "xyz", "club", "work", "buzz", "loan"]
SUSPICIOUS_TLDS_FLAG = ["tk", "ml", "ga", "cf", "gq", "pw", "cc", "top", "xyz", "club", "work", "info", "biz", "buzz", "loan"]
SUSPICIOUS_TLDS_BRAND_COMBO = ["tk", "ml", "ga", "cf", "gq", "pw", "top", "xyz", "club", "buzz", "loan", "work", "click"]

SUSPICIOUS_EXTENSIONS = [".exe", ".zip", ".apk", ".scr", ".bat", ".cmd"]
REDIRECT_WORDS = ["redirect", "url=", "next=", "continue=", "return="]
SUSPICIOUS_WORDS = [
    "login", "secure", "update", "account", "verify", "confirm", "click", "bank", "paypal",
    "signin", "password", "urgent", "suspended", "locked", "expire", "reward", "prize",
    "winner", "claim", "free", "wallet", "kyc", "blocked", "reactivate",
]
SENSITIVE_WORDS = ["bank", "paypal", "account", "password", "credit", "card", "wallet", "upi"]
ACTION_WORDS = ["click", "verify", "confirm", "update", "download", "install"]
SHORTENERS = ["bit.ly", "tinyurl", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly"]

# Leetspeak rules of has_character_substitution: letter -> replacement, every
# occurrence of the letter in the brand is replaced.
LEET_RULES = [("o", "0"), ("i", "1"), ("l", "1"), ("e", "3"), ("a", "@"), ("s", "$"), ("g", "9"), ("t", "7")]
# The four rules the advanced typosquatting fold tries on the cleaned domain.
TYPO_FOLD_RULES = [("o", "0"), ("i", "1"), ("l", "1"), ("e", "3")]

# Substitutions of the look-alike pattern generator (one letter -> several).
TYPO_SUBSTITUTIONS = {
    "o": ["0"],
    "i": ["1", "!", "|"],
    "l": ["1", "|"],
    "e": ["3"],
    "a": ["@", "4"],
    "s": ["$", "5"],
    "g": ["9"],
    "t": ["7"],
    "b": ["8"],
}

# Homoglyph map of the homograph check: Latin target -> look-alikes
# (the Cyrillic letters are U+0430, U+043E, U+0435, U+0456, U+0441).
HOMOGLYPHS = {
    "a": ["а", "@", "4"],
    "o": ["о", "0"],
    "e": ["е", "3"],
    "i": ["і", "1", "!", "|"],
    "l": ["1", "|", "I"],
    "c": ["с"],
    "s": ["$", "5"],
    "b": ["8"],
    "g": ["9"],
    "t": ["7"],
}

# Override outcomes: (prediction, benign, defacement, malware, phishing, reason)
WHITELIST_PROBS = {"benign": 0.999, "defacement": 0.0, "malware": 0.0005, "phishing": 0.0005}
TYPOSQUAT_PROBS = {"benign": 0.05, "defacement": 0.01, "malware": 0.02, "phishing": 0.92}
HOMOGRAPH_PROBS = {"benign": 0.08, "defacement": 0.01, "malware": 0.03, "phishing": 0.88}
HEURISTIC_PROBS = {"benign": 0.15, "defacement": 0.02, "malware": 0.03, "phishing": 0.80}
MODEL_CONFIDENT_THRESHOLD = 0.85
TYPOSQUAT_ACCEPT = 0.75
HEURISTIC_ACCEPT = 0.6

# Soft-vote weights.
VOTE_WEIGHTS = {"xgb": 0.3, "rf": 0.2, "lgb": 0.5}

# Browser-side quick risk score.
RISK_TLDS = ["tk", "ml", "ga", "cf", "gq", "pw"]
RISK_HOST_WORDS = ["verify", "secure", "account", "update", "confirm", "login", "signin"]
BLOCK_SCORE_THRESHOLD = 0.7
MODEL_BLOCK_THRESHOLD = 0.6

# Warning-page labels.
THREAT_TYPES = [
    ("phishing", "Phishing Attempt"),
    ("malware", "Malware Distribution"),
    ("suspicious", "Suspicious Activity"),
    ("ip address", "Suspicious IP-based URL"),
    ("ml", "Machine Learning Detection"),
]
DEFAULT_THREAT_TYPE = "Phishing / Malware"
BANKING_WORDS = ["paypal", "bank", "account"]
CRYPTO_WORDS = ["crypto", "bitcoin", "wallet"]

# Confidence bands.
HIGH_BAND = 0.85
MEDIUM_BAND = 0.60
BAND_ACTIONS = {"HIGH": "act", "MEDIUM": "warn", "LOW": "deep_analysis"}

# Page content scans.
TRUSTED_PASSWORD_HOSTS = ["google.com", "facebook.com", "github.com", "microsoft.com", "apple.com", "amazon.com"]
MINER_HOSTS = ["coinhive.com", "crypto-loot.com", "coin-hive.com", "webminer.pro", "monerominer.rocks", "jsecoin.com"]
XSS_PATTERNS = ["<script", "javascript:", "onerror=", "onload=", "<iframe", "eval\\("]
REDIRECT_ALERT_AFTER = 3

# Eleven-column feature sets (dataset script and browser side).
MINI_SUSPICIOUS_TLDS = ["tk", "ml", "ga", "cf", "gq"]
MINI_SUSPICIOUS_WORDS = ["verify", "secure", "account", "update", "confirm"]

# Synthetic corpus generator pools.
SYNTH_BRANDS = [
    "google", "facebook", "amazon", "apple", "microsoft", "youtube", "twitter", "instagram", "linkedin", "netflix",
    "paypal", "ebay", "spotify", "dropbox", "github", "stackoverflow", "reddit", "walmart", "target", "nike",
    "adidas", "samsung", "intel", "nvidia", "tesla", "uber", "ola", "airbnb", "booking", "expedia",
    "stripe", "visa", "mastercard", "americanexpress", "chase", "boa", "hsbc", "citibank", "wellsfargo",
    "flipkart", "myntra", "snapdeal", "paytm", "phonepe", "googlepay", "amazonpay", "irctc", "uidai", "zomato",
    "swiggy", "makemytrip", "goibibo", "nykaa", "ajio", "bigbasket", "grofers",
    "mozilla", "chrome", "firefox", "opera", "adobe", "oracle", "aws", "azure", "gcp", "docker",
    "slack", "zoom", "atlassian", "jetbrains", "discord", "tiktok", "pinterest", "quora", "medium", "tumblr",
    "bing", "yahoo", "duckduckgo", "protonmail", "mailchimp", "notion", "trello", "asana", "calendly", "canva",
    "stripe", "square", "intuit", "freshbooks", "xero", "zendesk", "okta", "oneplus", "xiaomi", "huawei",
    "lenovo", "asus", "acer", "hp", "dell", "lg", "panasonic", "sony", "philips", "seagate",
    "westernunion", "moneygram", "paypalme", "soundcloud", "vimeo", "behance", "dribbble", "envato", "etsy",
    "alibaba", "aliexpress", "mercadolibre", "rakuten", "indeed", "glassdoor", "monster", "zillow", "trulia",
    "tripadvisor", "skyscanner", "kayak", "expedia", "orbitz", "rbs", "svb", "sofi", "robinhood", "coinbase",
    "binance", "kraken", "bitpay", "ledger", "trezor", "epicgames", "riotgames", "ea", "ubisoft", "steam",
    "roblox", "twitch", "hulu", "disneyplus", "hbo", "pbs", "nationalgeographic", "cnn", "bbc", "nytimes",
    "forbes", "bloomberg", "reuters", "guardian", "amazonprime", "primevideo", "sainsburys", "tesco", "ikea",
    "homedepot", "lowes", "sephora", "ulta", "costco", "targetau", "argos", "currys",
]
SYNTH_PATTERNS = [
    "{brand}-login", "{brand}-secure", "{brand}-verify", "{brand}-account", "{brand}-recovery",
    "secure-{brand}", "verify-{brand}", "{brand}-help", "{brand}-support", "my-{brand}",
    "{brand}.com-login", "www.{brand}.com-secure", "{brand}-signin", "{brand}-update", "{brand}-auth",
    "login-{brand}", "accounts-{brand}", "{brand}-portal", "{brand}-portal-login", "{brand}-customer",
    "{brand}-payments", "{brand}-billing", "{brand}-checkout", "{brand}-otp", "{brand}-confirm",
    "{brand}-secure-login", "{brand}-verify-account", "{brand}-secure-update", "{brand}-notice", "{brand}-alert",
    "{brand}login", "{brand}secure", "{brand}verify", "{brand}account", "{brand}recovery",
]
SYNTH_TLDS = [
    ".com", ".net", ".org", ".info", ".biz", ".co", ".in", ".co.in", ".io", ".cc",
    ".tk", ".ml", ".ga", ".cf", ".gq", ".pw", ".xyz", ".top", ".club", ".online",
    ".site", ".website", ".space", ".store", ".tech", ".app", ".pro", ".me", ".shop",
]
SYNTH_SUBS = ["www", "login", "secure", "accounts", "safe", "verify", "portal", "update", "auth", "support", "help", "customer"]
SYNTH_PATH_WORDS = ["login", "secure", "account", "user", "update", "id"]
SYNTH_QUERY_KEYS = ["ref", "id", "m", "r", "token", "next"]
SYNTH_BRAND_PATH_WORDS = ["secure", "signin", "verify", "account", "auth", "user"]
SYNTH_HOMO = {"o": "0", "i": "1", "l": "1", "a": "@", "e": "3", "s": "5", "t": "7", "g": "9", "b": "8", "c": "("}
SYNTH_DIGIT_AFFIXES = ["1", "12", "123", "2023"]
SYNTH_DIGRAMS = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("er", "ar")]
SYNTH_PATH_DEPTH_WEIGHTS = [0.4, 0.35, 0.2, 0.05]
SYNTH_HTTPS_SHARE = 0.7
SYNTH_QUERY_SHARE = 0.25
SYNTH_PAIR_SHARE = 0.03
SYNTH_REPEAT_HOST_SHARE = 0.12

# Small labelled dataset script (five phishing shapes, sixteen legitimate sites).
SMALL_SET_LEGIT_SITES = ["paypal", "google", "facebook", "amazon", "microsoft", "apple"]
SMALL_SET_DOMAINS = [
    "google.com", "facebook.com", "youtube.com", "amazon.com",
    "wikipedia.org", "reddit.com", "github.com", "stackoverflow.com",
    "linkedin.com", "twitter.com", "instagram.com", "netflix.com",
    "apple.com", "microsoft.com", "adobe.com", "medium.com",
]
SMALL_SET_PATHS = ["", "/about", "/contact", "/products", "/services", "/blog", "/news"]

# Coverage check of a ranked domain list: category -> sites.
COVERAGE_SITES = [
    ("Global", ["google.com", "facebook.com", "youtube.com", "amazon.com", "microsoft.com"]),
    ("Indian Banks", ["icicibank.com", "hdfcbank.com", "sbi.co.in", "axisbank.com", "kotak.com"]),
    ("Payment Apps", ["paytm.com", "phonepe.com", "mobikwik.com"]),
    ("E-commerce", ["flipkart.com", "myntra.com", "snapdeal.com", "nykaa.com"]),
    ("Food/Services", ["swiggy.com", "zomato.com", "irctc.co.in", "makemytrip.com"]),
]
RANK_HEAD = 1000
RANK_SLICE = (40001, 48000)

# Word lists of the smaller URL profiles: first generation (V1), second generation (V2), 29-column
# host profile, 58-column decoded profile, 63-column draft.
V1_SUSPICIOUS_WORDS = ["login", "secure", "update", "account", "verify", "confirm", "click", "bank", "paypal"]
V1_SENSITIVE_WORDS = ["bank", "paypal", "account"]
V1_ACTION_WORDS = ["click", "verify", "confirm"]
V1_SHORTENERS = ["bit.ly", "tinyurl", "goo.gl"]
HOST29_SUSPICIOUS = ["login", "secure", "update", "bank"]
HOST29_SENSITIVE = ["password", "credit", "card"]
HOST29_ACTION = ["click", "submit", "run"]
HOST29_SHORTENERS = ["bit.ly", "t.co", "goo.gl"]
HOST29_SYMBOLS = "!@#$%^&*()=+{}[]|\\:;\"<>,?~`"
DECODED_DICTIONARY = ["google", "facebook", "amazon", "apple", "microsoft", "wikipedia", "paypal", "youtube", "twitter",
                      "linkedin", "instagram", "flipkart", "zomato", "swiggy", "nykaa", "icici", "hdfc", "sbi", "axis"]
DECODED_BRANDS = ["google", "facebook", "amazon", "microsoft", "apple", "paypal", "netflix", "instagram", "twitter",
                  "linkedin", "youtube", "yahoo", "ebay", "icici", "hdfc", "sbi", "axis", "swiggy", "zomato"]
DECODED_BRANDS_DOMAIN = ["google", "facebook", "amazon", "apple", "paypal", "youtube"]
V2_DICTIONARY = [
    "google", "facebook", "amazon", "microsoft", "apple", "youtube", "twitter", "instagram", "linkedin", "netflix",
    "wikipedia", "reddit", "github", "stackoverflow", "medium", "wordpress", "yahoo", "ebay", "paypal", "adobe",
    "salesforce", "spotify", "pinterest", "nike", "walmart", "target", "intel", "samsung", "tesla", "bmw", "ford",
    "shell", "python", "java", "mozilla", "chrome", "firefox", "opera", "ubuntu", "debian", "mysql", "oracle",
    "docker", "nginx", "apache",
]
V2_HIGH_TRUST = ["com", "org", "net", "edu", "gov", "mil"]
V2_SUSPICIOUS_CATEGORY = ["tk", "ml", "ga", "cf", "gq", "pw", "cc", "top", "xyz"]
V2_SUSPICIOUS_FLAG = ["tk", "ml", "ga", "cf", "gq", "pw", "cc", "top", "xyz", "club", "work", "info", "biz"]
V2_SUSPICIOUS_WORDS = [
    "login", "secure", "update", "account", "verify", "confirm", "click", "bank", "paypal", "signin", "password",
    "urgent", "suspended", "locked", "expire", "reward", "prize", "winner", "claim", "free",
]
V2_SENSITIVE_WORDS = ["bank", "paypal", "account", "password", "credit", "card"]
V2_BRANDS = [
    "google", "facebook", "amazon", "microsoft", "apple", "paypal", "netflix", "instagram", "twitter", "linkedin",
    "youtube", "yahoo", "ebay", "bank", "chase", "wellsfargo", "citibank", "hsbc", "dhl", "fedex", "usps", "irs", "uscis",
]
DRAFT_DICTIONARY = [
    "google", "facebook", "amazon", "microsoft", "apple", "youtube", "twitter", "instagram",
    "linkedin", "netflix", "wikipedia", "reddit", "github", "stackoverflow", "medium", "wordpress",
    "yahoo", "ebay", "paypal", "adobe", "salesforce", "spotify", "pinterest", "tiktok",
    "flipkart", "myntra", "snapdeal", "meesho", "ajio", "nykaa", "bigbasket", "grofers",
    "icici", "hdfc", "sbi", "axis", "kotak", "pnb", "canara", "bob", "unionbank", "idbi",
    "paytm", "phonepe", "googlepay", "bhim", "mobikwik", "freecharge", "amazonpay",
    "irctc", "uidai", "epfo", "nsdl", "swiggy", "zomato", "ola", "uber", "makemytrip", "goibibo",
    "nike", "walmart", "target", "intel", "samsung", "tesla", "bmw", "ford", "shell",
    "python", "java", "mozilla", "chrome", "firefox", "opera", "ubuntu", "debian",
    "mysql", "oracle", "docker", "nginx", "apache",
]
DRAFT_BRANDS = [
    "google", "facebook", "amazon", "microsoft", "apple", "paypal", "netflix", "instagram",
    "twitter", "linkedin", "youtube", "yahoo", "ebay", "chase", "wellsfargo", "citibank",
    "hsbc", "dhl", "fedex", "usps", "irs", "uscis",
    "flipkart", "paytm", "phonepe", "googlepay", "icici", "hdfc", "sbi", "axis", "kotak",
    "swiggy", "zomato", "ola", "irctc", "uidai", "epfo", "myntra", "snapdeal", "nykaa",
]
DRAFT_HYPHEN_PATTERNS = [
    "google-", "facebook-", "amazon-", "paypal-", "netflix-", "apple-",
    "microsoft-", "flipkart-", "paytm-", "icici-", "hdfc-", "sbi-",
    "axis-", "kotak-", "swiggy-", "zomato-",
]
DRAFT_LEGIT = [
    "google.com", "facebook.com", "amazon.com", "paypal.com", "netflix.com",
    "apple.com", "microsoft.com", "twitter.com", "instagram.com", "linkedin.com",
    "youtube.com", "yahoo.com", "ebay.com", "github.com", "stackoverflow.com",
    "flipkart.com", "paytm.com", "phonepe.com", "icicibank.com", "hdfcbank.com",
    "sbi.co.in", "axisbank.com", "kotak.com", "swiggy.com", "zomato.com",
    "myntra.com", "snapdeal.com", "nykaa.com", "makemytrip.com", "irctc.co.in",
]
DRAFT_CHECK_BRANDS = ["google", "facebook", "amazon", "paypal", "netflix", "apple", "microsoft", "flipkart", "paytm",
                      "icici", "hdfc", "sbi", "axis", "kotak", "swiggy", "zomato"]
DRAFT_MAJOR_BRANDS = ["google", "facebook", "amazon", "paypal", "netflix", "flipkart", "microsoft", "apple", "twitter",
                      "instagram", "youtube"]
DRAFT_COMBO_TLDS = ["tk", "ml", "ga", "cf", "gq", "pw", "top", "xyz", "club", "buzz", "loan"]

# ---------------------------------------------------------------------------
# FIXED VALUES — end
# ---------------------------------------------------------------------------

URL_SCHEMES_WITH_PARAMS = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps",
    "rtspu", "sip", "sips", "mms", "sftp", "tel",
]

# Suffixes of one kind of derived URL: plain, two labels, wildcard, exception.
ODD_SUFFIXES = [".tk", ".ru", ".com.cn", ".co.uk", ".gov.ck", ".www.ck", ".x.kobe.jp", ".city.kobe.jp", ".nosuchsuffix"]

#: Characters of the generators' random tokens.
TOKEN_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"

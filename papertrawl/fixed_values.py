"""Fixed values.

Word lists, lookup tables, patterns, thresholds and formats whose exact content decides the results.
They are stated plainly and in their natural order; all logic that uses them lives elsewhere.

Patterns are in Java dialect. Flags: U = Unicode classes, d = only "\\n" ends a line, i = ignore case,
m = ^ and $ at every line, s = dot matches newlines.
"""

# ---- Fixed values: text ---------------------------------------------------------------------------

WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"

# ---- Fixed values: contacts -----------------------------------------------------------------------

PHONE_PREFIXED = r"(?U)(?:\+91|91|0)[\s\-.]*([6-9][\d\s\-.]{9,15})"
PHONE_ANY = (
    r"(?U)(?:(?:\+91|91|0)[\s\-.]?[6-9]\d[\s\-.]?\d{4}[\s\-.]?\d{4}"
    r"|(?<!\d)[6-9]\d{9}(?!\d)"
    r"|\(?\d{2,4}\)?[\s\-.]\d{3,4}[\s\-.]\d{3,4})"
)
EMAIL = r"[a-zA-Z0-9._%+\-]{2,}@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,7}"
EMAIL_BLACKLIST = (
    r"(?i)@(sentry\.|example\.|test\.|domain\.|email\.|noreply|no-reply"
    r"|yoursite|yourcompany|yourdomain|localhost)"
)
ASSET_SUFFIX = r"(?i)\.(png|jpg|jpeg|gif|svg|webp|css|js|woff2?)$"
JSONLD_BLOCK = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
NAME_TAIL_AFTER_DASH = r"(?Ud)\s*[-–|]\s*.*$"
NAME_TAIL_PLACE = r"(?iUd)\s+(in|at|located in)\s+\w[\w\s]{0,30}$"

# ---- Fixed values: lead dimensions ----------------------------------------------------------------

# id, label, search phrases, listing search term, services slug
CATEGORIES = [
    ("importer", "Importer",
     ["importer trading company India", "import agent supplier India", "bulk importer India"],
     "importer", None),
    ("exporter", "Exporter",
     ["exporter company India", "export trading firm", "export supplier manufacturer"],
     "exporter", None),
    ("manufacturer", "Manufacturer",
     ["manufacturer supplier India", "manufacturing company India", "OEM manufacturer India"],
     "manufacturer", None),
    ("trader", "Trader",
     ["wholesale trader company India", "trading company wholesale India"],
     "trader", None),
    ("freight_forwarder", "Freight Forwarder",
     ["freight forwarding cargo agents", "customs clearance freight forwarder",
      "international cargo shipping agent"],
     "freight forwarding agent", "custom-clearance-agents"),
    ("customs_broker", "Customs Broker",
     ["customs clearance broker CHA India", "customs house agent India"],
     "customs broker", None),
    ("insurer", "Insurer",
     ["marine cargo insurance company India", "trade insurance broker India"],
     "insurance company", None),
    ("bank_trade_finance", "Bank / Trade Finance",
     ["trade finance bank LC India", "documentary credit export finance"],
     "trade finance", None),
    ("ca_firm", "CA Firm",
     ["chartered accountant CA firm GST", "CA firm audit tax services",
      "chartered accountant financial services"],
     "chartered accountant", "chartered-accountants"),
    ("virtual_cfo", "Virtual CFO",
     ["virtual CFO finance consulting services", "CFO services financial advisory",
      "outsourced CFO financial management"],
     "CFO services", "ca-services"),
    ("accounting", "Accounting",
     ["accounting bookkeeping tax consultants", "GST filing bookkeeping services",
      "tax consultant accounting firm"],
     "accounting services", "accounting-services"),
    ("logistics", "Logistics",
     ["logistics company transport India", "courier freight transport company",
      "supply chain logistics services"],
     "logistics company", "packers-movers"),
    ("fintech", "Fintech",
     ["fintech startup company India", "financial technology firm India"],
     "fintech", None),
    ("ecommerce", "E-commerce",
     ["ecommerce company India online retail", "online marketplace seller India"],
     "ecommerce", None),
    ("marketing_sales", "Marketing & Sales",
     ["digital marketing agency advertising", "SEO social media marketing agency",
      "branding advertising digital agency"],
     "digital marketing agency", "digital-marketing"),
    ("operations", "Operations / Tech",
     ["IT services technology company India", "software development company India"],
     "IT services", None),
    ("startup_sme", "Startup / SME",
     ["startup SME small business consulting", "business advisory management consulting",
      "SME growth consulting services"],
     "business consultant", "management-consulting"),
]

# name, region
CITIES = [
    ("Hyderabad", "South"), ("Mumbai", "West"), ("Bangalore", "South"), ("Delhi", "North"),
    ("Chennai", "South"), ("Pune", "West"), ("Kolkata", "East"), ("Ahmedabad", "West"),
    ("Surat", "West"), ("Jaipur", "North"), ("Lucknow", "North"), ("Kochi", "South"),
    ("Coimbatore", "South"), ("Nagpur", "Central"), ("Visakhapatnam", "South"),
]
DEFAULT_CITIES = ["Hyderabad", "Mumbai", "Bangalore", "Delhi", "Chennai"]
SERVICES_CITY_SLUGS = {
    "Hyderabad": "hyderabad", "Mumbai": "mumbai", "Bangalore": "bangalore",
    "Delhi": "delhi-ncr", "Chennai": "chennai",
}

# id, label, coverage, best for
SOURCES = [
    ("justdial", "JustDial", "High", "All categories, phones, JSON-LD"),
    ("indiamart", "IndiaMart", "High", "Importers, exporters, manufacturers"),
    ("tradeindia", "TradeIndia", "High", "Freight, customs, trade"),
    ("sulekha", "Sulekha", "Medium", "CA, CFO, professional services"),
    ("yellowpages", "YellowPages India", "Medium", "Local business phone listings"),
]
# phases run in this order
SOURCE_PHASES = ["indiamart", "bing", "sulekha", "justdial"]

# segment id, plural label
SEGMENT_LABELS = [
    ("importer", "Importers"), ("exporter", "Exporters"), ("manufacturer", "Manufacturers"),
    ("trader", "Traders"), ("freight_forwarder", "Freight Forwarders"),
    ("customs_broker", "Customs Brokers"), ("insurer", "Insurers"),
    ("bank_trade_finance", "Banks / Trade Finance"), ("ca_firm", "CA Firms"),
    ("virtual_cfo", "Virtual CFOs"), ("accounting", "Accounting"), ("logistics", "Logistics"),
    ("fintech", "Fintech"), ("startup_sme", "Startups / SMEs"), ("ecommerce", "E-commerce"),
    ("marketing_sales", "Marketing & Sales"), ("operations", "Operations / Tech"),
]

CONTACT_PATHS = [
    "/contact", "/contact-us", "/contactus", "/about", "/about-us", "/reach-us", "/get-in-touch", "/",
]
SKIP_HOSTS = [
    "bing.com", "microsoft.com", "msn.com", "live.com", "youtube.com", "facebook.com",
    "wikipedia.org", "twitter.com", "x.com", "instagram.com",
]
KNOWN_META_KEYS = [
    "phone", "mobile", "email", "website", "address", "city", "description", "services",
    "employee_count", "founded_year", "source", "source_url", "source_platform", "company_name",
    "category",
]

# search URL templates
LISTING_URL = "https://dir.indiamart.com/search.mp?ss=%s&City=%s&catids=&bcat="
SERP_URL = "https://www.bing.com/search?q=%s&count=10&mkt=en-IN&setlang=en-IN&cc=IN"
SERVICES_URL = "https://www.sulekha.com/%s/%s-service-providers"
SITE_SEARCH_URL = "https://www.bing.com/search?q=%s&count=8&mkt=en-IN"
SITE_SEARCH_HOST = "justdial.com"

# ---- Fixed values: page selectors -----------------------------------------------------------------

# listing cards, tried in order
LISTING_CARDS = ["div.bx", "div.lst-bx", "div.card", "li.bx", "[class*='supplier']",
                 "[class*='company']", "article"]
LISTING_NAME = [".dspname", ".company-name", "h3.elname", "h3 a", "h2 a", ".sup-name",
                "[class*='compname']", "[class*='supplier-name']", "strong.bname"]
LISTING_PHONE = [".phn", "[class*='phone']", "[class*='contact']", "a[href^='tel:']"]
LISTING_ADDRESS = [".addrs", ".loc", "[class*='address']", "[class*='location']", ".city"]
SERVICE_CARDS = [".sp-card", ".provider-card", "[class*='provider']", "[class*='listing']", "article"]
SERVICE_NAME = ["h2", "h3", ".sp-name", "[class*='name']", "strong"]
SERVICE_ADDRESS = [".address", "[class*='addr']", "[class*='location']"]
SERP_ITEMS = ["li.b_algo", "div.b_algo", "#b_results > li:not(.b_ad)", "main article, main section"]
SERP_TITLE = ["h2 a", ".b_title a", "h3 a", "h2"]
SERP_SNIPPET = ".b_caption p, .b_snippet, p"
BUSINESS_NAME = ["h1", "[class*='comp-name']", "[class*='fn']", "[class*='biz']", "title"]
SITE_ADDRESS = ["address", "[class*='address']", "[class*='location']", "[itemprop='address']"]
HEADINGS = ["h2", "h3", "h4", "strong"]
HEADING_LIMIT = 80

AMAZON_SELECTORS = {
    "title": ["#productTitle", "#title span", "h1.a-size-large", ".product-title-word-break"],
    "price": [".a-price .a-offscreen", "#priceblock_ourprice", "#priceblock_dealprice",
              ".a-price-whole", "#apex_desktop .a-price .a-offscreen",
              "#corePrice_feature_div .a-price .a-offscreen", "#price_inside_buybox"],
    "original_price": [".a-text-price .a-offscreen", "#priceblock_saleprice",
                       ".a-text-strike .a-offscreen", "#booksHeaderSection .a-text-price"],
    "discount": [".savingsPercentage", ".reinventPriceSavingsPercentageMargin"],
    "rating": ["#acrPopover", ".a-icon-star span.a-icon-alt",
               "#averageCustomerReviews_feature_div .a-icon-star"],
    "reviews": ["#acrCustomerReviewText", "#acrCustomerReviewLink span",
                "#reviews-medley-cmps-expand-head span"],
    "availability": ["#availability span", "#outOfStock", "#add-to-cart-button"],
    "brand": ["#bylineInfo", "#brand", ".po-brand .po-break-word", "a#brandTextBinchmark_feature_div"],
    "category": ["#wayfinding-breadcrumbs_container"],
    "image": ["#imgBlkFront, #landingImage, #main-image"],
    "cart": ["#add-to-cart-button"],
}
FLIPKART_SELECTORS = {
    "title": [".B_NuCI", ".yhB1nd", "h1.Gq9Me", ".pdp-e-i-head", "h1"],
    "price": ["._30jeq3._16Jk6d", "._30jeq3", ".Nx9bqj", "._16Jk6d", "._25b18"],
    "original_price": ["._3I9_wc", "._3auQ3N", ".yRaY8j"],
    "discount": ["._3Ay6Sb span", "._11dKQP", ".UkUFwK span"],
    "rating": ["._3LWZlK", "div.XQDdHH", ".ipqd2A", "._1lRcqv ._3LWZlK"],
    "reviews": ["._2_R_DZ span", "span._13vcmD", "span.rowspan"],
    "brand": ["._2rQ-NK", ".G6XhRU", "._3N0uGr", "a.ui-pdp-seller__brand-name"],
    "category": ["._1MR4o5", "._3GIHBu a"],
    "image": ["._396cs4 img", "._2amPTt img", ".CXW8mj img"],
    "cart": ["._16FRp0, #addToCartButton, #buyNowButton"],
    "sold_out": ["[class*='out-of-stock'], [class*='OutOfStock']"],
}
RESTAURANT_TITLE = {"swiggy": "[class*='RestaurantNameAddress_name']", "zomato": "h1"}
RESTAURANT_CUISINE = "[class*='cuisine']"

# brand, title, price, rating, image
BRAND_SELECTORS = [
    ("nykaa", ".css-xrzmfa", ".css-1jczs19", ".css-1lmzrv3", "img[class*='product']"),
    ("meesho", "p[class*='ProductTitle']", "h5", "[class*='Rating']", "img[class*='Image']"),
    ("myntra", "h1.pdp-title", ".pdp-price strong", ".index-overallRating div", "img.img-responsive"),
    ("snapdeal", ".pdp-e-i-head", ".payBlkBig", ".filled-stars", "#product-image"),
    ("ajio", ".prod-name", ".prod-sp", "div.rating-block span", "img.rilrtl-products-image"),
    ("bigbasket", "h1.pd__title", "span.pd__price", "span.rating__value", "img.pd__image"),
    ("jiomart", ".product-name", ".final-price", ".rating-count", ".product-img img"),
    ("croma", ".pd-title", ".new-price", ".rating-value", ".product-img"),
    ("reliance_digital", "h1.pdp_title", ".real-price", ".rdrating", ".pdp-img img"),
]
PLATFORMS = ["amazon", "flipkart", "swiggy", "zomato", "manual"]
PRODUCT_STATE = r"(?s)window\.__PRELOADED_STATE__\s*=\s*(\{.+?\});"

# ---- Fixed values: invoices -----------------------------------------------------------------------

# brand, markers; first brand with a marker wins
INVOICE_BRANDS = [
    ("amazon", ["amazon"]),
    ("flipkart", ["flipkart"]),
    ("zepto", ["zepto", "geddit convenience"]),
    ("blinkit", ["blinkit", "grofers"]),
    ("swiggy", ["swiggy"]),
    ("zomato", ["zomato"]),
    ("meesho", ["meesho"]),
    ("myntra", ["myntra"]),
    ("nykaa", ["nykaa"]),
    ("bigbasket", ["bigbasket"]),
]
INVOICE_NUMBER = [
    r"(?iUd)Invoice\s+(?:Number|No\.?)\s*[:\s]+([A-Z0-9\-/]{3,40})",
    r"(?iUd)Invoice\s+No\.\s*:\s*([A-Z0-9\-/]{3,40})",
    r"(?iUd)(?:IN|INV|BILL|MKT)-([A-Z0-9\-]{3,30})",
    r"(?iUd)Tax\s+Invoice\s+No\.?\s*:?\s*([A-Z0-9\-/]{3,40})",
]
INVOICE_DATE = [
    r"(?iUd)Invoice\s+Date\s*[:\s]+(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})",
    r"(?iUd)Date\s*[:\s]+(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})",
    r"(?iUd)Date\s*[:\s]+(\d{1,2}\s*-\s*\d{1,2}\s*-\s*\d{4})",
    r"(?Ud)(\d{2}[-./]\d{2}[-./]\d{4})",
]
ORDER_NUMBER = [r"(?iUd)Order\s+(?:Number|ID|No\.?)\s*[:\s]+([A-Z0-9\-]{6,40})"]
INVOICE_TOTAL = [
    r"(?imUd)^TOTAL\s*:(.*)",
    r"(?iUd)Invoice\s+Value\s+([\d,.]+)",
    r"(?iUd)(?:Grand\s+Total|Total\s+Amount|Amount\s+(?:Due|Payable)|Net\s+Payable)\s*[:\s]*(?:₹|Rs\.?|INR)?\s*([\d,]+\.?\d*)",
    r"(?iUd)(?:₹|Rs\.?)\s*([\d,]+\.?\d*)\s*(?:only|/-)\b",
]
INVOICE_TAX = [
    r"(?iUd)(?:IGST|CGST\s*\+\s*SGST|Total\s+Tax|Tax\s+Amount)\s*[:\s]*(?:₹|Rs\.?)?\s*([\d,]+\.?\d*)",
    r"(?iUd)(?:GST|Tax|VAT)\s*(?:@[\d.]+%)?\s*[:\s]*(?:₹|Rs\.?)?\s*([\d,]+\.?\d*)",
]
INVOICE_TAX_RATE = [
    r"(?iUd)GST\s*@?\s*([\d.]+)\s*%",
    r"(?iUd)(?:IGST|CGST|SGST)\s+(\d+(?:\.\d+)?)\s*%",
    r"(?iUd)Tax\s+Rate\s+([\d.]+)\s*%",
]
INVOICE_SUBTOTAL = [
    r"(?iUd)(?:Sub\s*Total|Net\s+Amount|Taxable\s+(?:Amount|Value)|Item\s+Total)\s*[:\s]*([\d,.]+)",
    r"(?iUd)(?:Amount\s+Before\s+Tax|Basic\s+Value)\s*[:\s]*([\d,.]+)",
]
CGST_AMOUNT = r"(?iUd)CGST\s+(?:Amt\.?\s*)?([\d.]+)"
SGST_AMOUNT = r"(?iUd)(?:S/UT\s+GST|SGST)\s+(?:Amt\.?\s*)?([\d.]+)"
IGST_ENTRY = r"(?iUd)(\d+(?:\.\d+)?)\s*%\s*IGST\s+₹?([\d,.]+)"
INVOICE_VENDOR = [
    r"(?iUd)(?:Sold\s+By|Seller|From|Vendor|Supplier|Merchant)\s*:\s*\n\s*\*?\s*([A-Z][^\n]{2,80})",
    r"(?iUd)Seller\s+Name\s*:\s*([A-Z][^\n]{2,80})",
]
INVOICE_BUYER = [
    r"(?iUd)Bill(?:ing)?\s+(?:Address|To)\s*:\s*\n\s*([A-Z][A-Za-z\s]{2,60})\n",
    r"(?iUd)Ship(?:ping)?\s+(?:Address|To)\s*:\s*\n\s*([A-Z][A-Za-z\s]{2,60})\n",
    r"(?iUd)(?:Customer|Recipient)\s*:\s*([A-Z][A-Za-z\s]{2,60})\n",
]
INVOICE_BUYER_ANY = r"(?iUd)Bill\s+To.*?\n\s*([A-Z][A-Za-z\s]{2,60})\n"
AMOUNT = r"(?U)[\d,]+\.?\d*"

# brand overrides: field -> (pattern, confidence)
AMAZON_FIELDS = {
    "invoice_number": (r"(?iUd)Invoice\s+Number\s*:\s*([A-Z0-9\-]+)", 0.98),
    "order_number": (r"(?iUd)Order\s+Number\s*:\s*([0-9\-]{10,25})", 0.99),
    "invoice_date": (r"(?iUd)Invoice\s+Date\s*:\s*(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4})", 0.97),
    "buyer": (r"(?iUd)GST\s+Registration\s+No\s*:\s*[A-Z0-9]+\s+([A-Z][A-Za-z]{2,40}(?:\s[A-Za-z]+){0,5})", 0.95),
    "vendor": (r"(?iUd)For\s+([A-Z][A-Za-z0-9\s&.,]+?)\s*:\s*\n\s*Authorized", 0.96),
}
AMAZON_SOLD_BY = r"(?iUd)Sold\s+By\s*:.*\n\s*\*?\s*([A-Za-z][A-Za-z0-9\s&.,\-]+?)\s+"
AMAZON_SOLD_BY_CONFIDENCE = 0.93
AMAZON_TOTAL_CONFIDENCE = 0.95
AMAZON_TAX_RATES = r"(?iUd)(\d+(?:\.\d+)?)\s*%\s*(?:IGST|CGST|SGST)"
AMAZON_TAX_AMOUNTS = r"(?iUd)(?:IGST|CGST|SGST)\s+₹([\d,.]+)"
AMAZON_TAX_CONFIDENCE = 0.91
ZEPTO_FIELDS = {
    "vendor": (r"(?iUd)Seller\s+Name\s*:\s*([A-Z][^\n]{2,80})", 0.97),
    "invoice_number": (r"(?iUd)Invoice\s+No\.?\s*:\s*([A-Z0-9\-/]{4,40})", 0.97),
    "order_number": (r"(?iUd)Order\s+No\.?\s*:\s*([A-Z0-9\-/]{4,40})", 0.96),
    "invoice_date": (r"(?iUd)Date\s*:\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})", 0.95),
    "buyer": (r"(?iUd)Bill\s+To\s+Ship\s+To\s*\n\s*([A-Z][A-Za-z\s]{2,60})\n", 0.94),
    "total": (r"(?iUd)Invoice\s+Value\s+([\d,.]+)", 0.97),
    "subtotal": (r"(?iUd)Item\s+Total\s+([\d,.]+)", 0.95),
}
ZEPTO_TOTALS_ROW = r"(?mUd)^([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+[\d.]+\s+([\d.]+)\s*$"
ZEPTO_TAX_CONFIDENCE = 0.93
FLIPKART_FIELDS = {
    "invoice_number": (r"(?iUd)(?:Invoice|Inv)\s*(?:No\.?|#)\s*[:\-]?\s*([A-Z0-9\-/]{4,40})", 0.96),
    "order_number": (r"(?iUd)Order\s+ID\s*:\s*(OD\d+)", 0.99),
    "vendor": (r"(?iUd)(?:Seller|Sold\s+By)\s*[:\-]?\s*\n?\s*([A-Z][A-Za-z0-9\s&.,]{2,80})", 0.93),
}
AMAZON_ITEM = (
    r"(?mUd)^(?!\s*TOTAL)(.{4,80}?)\s+₹([\d,.]+)\s+[-₹]?[\d,.]+\s+(\d+)\s+₹([\d,.]+)\s+([\d.]+)%\s+\w+"
    r"\s+₹[\d,.]+\s+₹([\d,.]+)"
)
GENERIC_ITEM = r"(?mUd)^(.{5,60}?)\s+₹([\d,]+\.?\d*)\s+.*?₹([\d,]+\.?\d*)\s*$"
NOT_AN_ITEM = ["total", "subtotal", "amount in words", "shipping charges"]
MAX_LINE_ITEMS = 30
FOUND, NOT_FOUND = 0.92, 0.3

# ---- Fixed values: bank statements ----------------------------------------------------------------

# marker alternatives, bank; markers of up to four letters count as whole words only
BANKS = [
    (["hdfc"], "HDFC Bank"),
    (["state bank of india", "sbi"], "State Bank of India"),
    (["icici"], "ICICI Bank"),
    (["axis bank"], "Axis Bank"),
    (["kotak"], "Kotak Mahindra Bank"),
    (["punjab national", "pnb"], "Punjab National Bank"),
    (["canara"], "Canara Bank"),
    (["bank of baroda"], "Bank of Baroda"),
    (["union bank"], "Union Bank of India"),
    (["idbi"], "IDBI Bank"),
    (["yes bank"], "Yes Bank"),
    (["indusind"], "IndusInd Bank"),
    (["bankasia", "bank asia"], "Bank Asia"),
    (["standard chartered"], "Standard Chartered"),
    (["hsbc"], "HSBC"),
    (["bangladesh bank"], "Bangladesh Bank"),
]
BANK_WEB_HOST = r"(?iUd)www\.([a-z0-9]+(?:-[a-z0-9]+)*)\.(?:com|co\.in|org)"
CURRENCIES = [
    (["bdt", "bangladeshi taka", "taka"], "BDT"),
    (["usd", "us dollar"], "USD"),
    (["gbp", "pound"], "GBP"),
    (["eur", "euro"], "EUR"),
]
# template, marker alternatives, bank
STATEMENT_TEMPLATES = [
    ("hdfc", ["hdfc"], "HDFC Bank"),
    ("sbi", ["state bank", "sbi"], "State Bank of India"),
    ("icici", ["icici"], "ICICI Bank"),
    ("axis", ["axis bank"], "Axis Bank"),
    ("kotak", ["kotak"], "Kotak Mahindra Bank"),
]
ACCOUNT_NUMBER = [
    r"(?iUd)(?:A/c|Account)\s+(?:No\.?|Number)\s*[:\s]+(\d{6,20})",
    r"(?iUd)(?:Account|A/c)\s+No\.?\s*:\s*(\d{6,20})",
]
ACCOUNT_HOLDER = (
    r"(?iUd)(?:Account\s+Title|Account\s+Name|Account\s+Holder|Customer\s+Name|Name)\s*:\s*"
    r"([A-Za-z][A-Za-z\s.]{2,60}?)(?:\n|Currency|$)"
)
IFSC = r"([A-Z]{4}0[A-Z0-9]{6})"
PERIOD = (
    r"(?iUd)Period\s*:\s*(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})\s+to\s+(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})"
)
OPENING_BALANCE = r"(?iUd)(?:Opening|Open)\s+Balance\s*:?\s*([\d,]+\.?\d*)"
CLOSING_BALANCE = r"(?iUd)(?:Closing|Close)\s+Balance\s*:?\s*([\d,]+\.?\d*)"
TRANSACTION = (
    r"(?mUd)(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\s+([A-Za-z][A-Za-z0-9\s/\-.,#()]{2,100}?)\s+"
    r"([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})"
)
TABLE_ACCOUNT_NUMBER = r"(?iUd)Account\s+No\.?\s*:\s*(\d{6,20})"
TABLE_HOLDER = [
    r"(?iUd)(?:Account\s+Holder|Customer\s+Name|Name)\s*:\s*([A-Za-z][A-Za-z\s.]{2,60})",
    r"(?iUd)Account\s+Title\s*:\s*([^\n]+?)(?:\s{2,}|Currency|$)",
]
TABLE_IFSC = r"(?iUd)(?:IFSC|IFS\s+Code)\s*:?\s*([A-Z]{4}0[A-Z0-9]{6})"
TABLE_PERIOD = r"(?iUd)Period\s*:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s+to\s+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
TABLE_TOTALS = r"(?iUd)Total\s*:\s*([\d,]+\.?\d*)\s+([\d,]+\.?\d*)"
TABLE_HEADER_WORDS = [
    "narration", "description", "particulars", "balance", "trans date & code", "trans date", "date",
    "debit amount", "credit amount", "debit", "credit",
]

# ---- Fixed values: classification -----------------------------------------------------------------

CLASSES = ["invoice", "bank_statement", "receipt", "contract", "payslip"]
CLASS_KEYWORDS = {
    "invoice": ["invoice", "bill to", "ship to", "subtotal", "total amount", "gst", "tax", "line item",
                "qty", "unit price", "invoice number", "payment due", "vendor", "seller"],
    "bank_statement": ["account number", "ifsc", "opening balance", "closing balance", "debit", "credit",
                       "transaction", "bank", "upi", "neft", "rtgs", "statement period", "narration",
                       "withdrawal", "deposit"],
    "receipt": ["receipt", "thank you", "purchased", "cash", "change", "subtotal", "sales tax", "cashier",
                "store", "total paid", "payment received"],
    "contract": ["agreement", "party", "whereas", "hereinafter", "terms and conditions", "clause",
                 "obligations", "termination", "jurisdiction", "witness", "signature", "hereby",
                 "contract"],
    "payslip": ["salary", "payslip", "employee", "basic pay", "hra", "pf", "esic", "net pay",
                "gross salary", "deductions", "allowance", "designation", "employer", "pan", "epf"],
}
SAMPLES_PER_CLASS, WORDS_PER_SAMPLE, TRAINING_SEED = 20, 8, 42
SAMPLE_SUFFIX = " document sample %d"
MAX_FEATURES = 5000
MULTI_LABEL_SCORE = 0.6
ROUTE_BANK_WORDS = ["ifsc", "account no", "account title", "trans date", "narration", "debit amount",
                    "credit amount", "balance brought", "neft", "rtgs", "upi", "atm", "cheque"]
FALLBACK_BANK_WORDS = ["account no", "account title", "trans date", "narration", "debit amount",
                       "credit amount", "balance brought", "neft", "rtgs", "atm"]

# ---- Fixed values: OCR ----------------------------------------------------------------------------

OCR_ENGINES = ["paddle", "easyocr", "tesseract"]
OCR_RETRY_BELOW = 0.75
OCR_FALLBACK_BELOW = 0.80
LAYOUT_CLASSES = [
    ("text", "text"), ("title", "header"), ("list", "text"), ("table", "table"), ("figure", "figure"),
    ("caption", "text"), ("page-header", "header"), ("page-footer", "text"), ("footnote", "text"),
    ("formula", "text"), ("section-header", "header"),
]
OCR_NOISE_LINE = r"^[^\p{L}\p{N}_₹%@/():\-.]+$"

# ---- Fixed values: retrieval ----------------------------------------------------------------------

CHUNK_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN, MIN_CHUNK_CHARS = 512, 128, 4, 20
EMBED_CHARS = 8000
TOP_K, MIN_SIMILARITY, SOURCE_CHARS = 5, 0.5, 400
PROMPT_HEAD = (
    "You are an AI assistant specialised in analysing financial documents.\n"
    "Answer the user's question based ONLY on the provided document context.\n"
    "If the answer is not in the context, say so clearly. Cite which source you used.\n\n"
    "DOCUMENT CONTEXT:\n"
)
SIMPLE_PROMPT_HEAD = (
    "You are an AI assistant specialised in financial documents and data analysis.\n"
    "Answer the following question concisely and accurately.\n\nQUESTION: "
)

# ---- Fixed values: files and jobs -----------------------------------------------------------------

ACCEPTED_TYPES = ["application/pdf", "image/png", "image/jpeg", "image/jpg", "image/tiff", "image/bmp",
                  "image/webp"]
MAX_OCR_BYTES, MAX_EXTRACTION_BYTES = 50 * 1024 * 1024, 30 * 1024 * 1024
OCR_MODES, DEFAULT_MODE = ["fast", "full", "ci"], "full"
MIN_DIGITAL_TEXT = 80
TERMINAL_EVENTS = ["complete", "error"]
EVENTS_KEPT = 100
THROTTLE_SECONDS, JOB_TIMEOUT_SECONDS, CACHE_SECONDS = 2, 900, 3600

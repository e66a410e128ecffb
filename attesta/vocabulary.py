"""Fixed values the operators rely on: codes, word lists, patterns and the shipped rule seed.

Nothing here is logic.  Tables that are joined in Spark are built from these rows with
``inline_table`` so that Catalyst sees a LocalRelation with an exact size.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: declarations that may be printed on a label ------------------------------

FIELD_KEYS = (
    "manufacturer_name", "packer_name", "importer_name", "manufacturer_address",
    "common_or_generic_name", "net_quantity", "retail_sale_price", "unit_sale_price",
    "date_of_manufacture", "date_of_packing", "date_of_import", "best_before",
    "consumer_care_contact", "country_of_origin", "batch_number", "other",
)
UNSUPPORTED_KEYS = ("manufacturer_address", "common_or_generic_name")
SUPPORTED_KEYS = tuple(k for k in FIELD_KEYS if k not in UNSUPPORTED_KEYS)
DATE_KEYS = ("date_of_manufacture", "date_of_packing", "date_of_import", "best_before")
BOOKKEEPING_KEYS = ("uncertain", "uncertainty_reasons", "candidates", "matched_by", "declaration")

LOW_CONFIDENCE = 0.5
EXCERPT_LENGTH = 500
LINE_JOIN = " | "   # between the lines of one consumer-care declaration
MAX_PROCESSING_MS = 2_147_483_647
MAX_IMAGES_PER_INSPECTION = 6
MAX_IMAGE_BYTES = 10 * 1024 * 1024
MIN_IMAGE_SIDE = 32
MAX_IMAGE_PIXELS = 50_000_000
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
IMAGE_CONTENT_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp")
VIEW_TYPES = ("unspecified", "front", "back", "principal_display", "label", "other")

# --- fixed values: units ---------------------------------------------------------------------

MASS_UNITS = {
    "mcg": "0.000001", "ug": "0.000001", "mg": "0.001",
    "g": "1", "gm": "1", "gms": "1", "gram": "1", "grams": "1", "gr": "1",
    "kg": "1000", "kgs": "1000", "kilogram": "1000", "kilograms": "1000",
}
VOLUME_UNITS = {
    "ml": "1", "mls": "1", "millilitre": "1", "millilitres": "1", "milliliter": "1", "milliliters": "1",
    "cc": "1", "cl": "10", "dl": "100",
    "l": "1000", "ltr": "1000", "ltrs": "1000", "lt": "1000",
    "litre": "1000", "litres": "1000", "liter": "1000", "liters": "1000",
}
COUNT_UNITS = ("n", "u", "pc", "pcs", "piece", "pieces", "no", "nos", "unit", "units")
NON_SI_UNITS = {
    "oz": "ounce", "ozs": "ounce", "ounce": "ounce", "ounces": "ounce",
    "lb": "pound", "lbs": "pound", "pound": "pound", "pounds": "pound",
    "fl oz": "fluid ounce", "floz": "fluid ounce",
    "pt": "pint", "pint": "pint", "pints": "pint",
    "qt": "quart", "quart": "quart", "quarts": "quart",
    "gal": "gallon", "gallon": "gallon", "gallons": "gallon",
    "grain": "grain", "grains": "grain",
}
PROHIBITED_COUNTS = ("great gross", "dozen", "dozens", "score", "scores", "gross")
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}

# --- fixed values: label patterns (Java regex dialect) ---------------------------------------
# NUMBER tries grouped digits first and otherwise takes the whole run of digits, so an ungrouped
# "1500" is read as 1500.

NUMBER = r"\d{1,3}(?:,\d{2,3})+(?:\.\d{1,3})?|\d+(?:\.\d{1,3})?"
UNITS = (
    r"kgs?|kilograms?|gms?|grams?|gr|mg|mcg|ug|g"
    r"|millilitres?|milliliters?|mls?|litres?|liters?|ltrs?|lt|cc|cl|dl|l"
    r"|pieces?|pcs?|units?|nos?|n|u"
)
CURRENCY = r"₹|Rs\.?|INR|R\.?\s?s\.?"
MONTH_WORDS = (
    r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?"
    r"|aug(?:ust)?|sep(?:t)?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
NET_QUANTITY_ANCHOR = (
    r"\bnet\s*(?:qty|quantity|wt|weight|content|contents|vol|volume)\b|\bnet\s*(?:qty|wt|vol)\.?\s*[:\-]"
)
NET_QUANTITY_KEYWORD = NET_QUANTITY_ANCHOR + r"|\bquantity\b"
NON_DECLARATION_CONTEXT = (
    r"\bper\s*(?:\d|serve|serving|portion|pack\b)"
    r"|\bnutrition|\bnutritional\b|\bingredient|\bserving"
    r"|\benergy\b|\bprotein\b|\bcarbohydrate|\bsugars?\b|\bsodium\b"
    r"|\bcholesterol\b|\bkcal\b|\bkj\b|\bfat\b|\bfibre\b|\bfiber\b|\brda\b"
)
QUANTITY = rf"(?:(\d{{1,3}})\s*[x×]\s*)?({NUMBER})\s*({UNITS})\b\.?"
MRP_KEYWORD = (
    r"\bm\.?\s?r\.?\s?p\.?(?![a-z])|\bmaximum\s+retail\s+price\b"
    r"|\bretail\s+sale\s+price\b|\bmax\.?\s*retail\s*price\b"
)
PRICE_AFTER_CURRENCY = rf"(?:{CURRENCY})\s*({NUMBER})"
PRICE = rf"(?:{CURRENCY})\s*({NUMBER})|({NUMBER})\s*(?:{CURRENCY})(?![a-z])"
BARE_AMOUNT = rf"(?<![\d.,])({NUMBER})(?!\d)(?!\s*(?:{UNITS})\b)"
TAX_INCLUSIVE = r"incl(?:usive|\.)?\s*(?:of)?\s*all\s*tax"
TAX_EXCLUSIVE = r"excl(?:usive|\.)?\s*(?:of)?\s*all\s*tax"
NON_MRP_CONTEXT = r"\bunit\s*(?:sale\s*)?price\b|\bper\s*(?:kg|g|ml|l|litre|liter|piece|pc)\b"
PAISE_AMOUNT = r"\d{1,3}(?:,\d{2,3})*\.\d{2}|\d+\.\d{2}"
PRICE_PAIR = (
    rf"(?<!\d)(?<!\d[.,/])({PAISE_AMOUNT})\s*/\s*({PAISE_AMOUNT})(?!\d|[.,/]\d)(?!\s*(?:{UNITS})\b)"
)
PRICE_LEGEND_MISREAD = r"\b(?:[A-Z]RP|M[A-Z]P|[A-Z]SP|U[A-Z]P)\b"
UNIT_PRICE_ANCHOR = r"\bunit\s*sale\s*price\b|\bunit\s*price\b"
UNIT_PRICE_KEYWORD = UNIT_PRICE_ANCHOR + r"|\busp\b"
PER_UNIT_PRICE = (
    rf"(?<![\d,.])(?:({CURRENCY})\s*)?({NUMBER})\s*(?:{CURRENCY})?\s*(?:per|/)\s*({UNITS})\b\.?"
)
DATE_KEYWORDS = {
    "date_of_manufacture": (
        r"\bdate\s+of\s+(?:manufacture|mfg|mfr)\b|\bmanufactur(?:ed|ing)\s*(?:on|date)?\b"
        r"|\bmfg\.?\s*(?:date|dt|on)?\b|\bmfd\.?\s*(?:date|dt|on)?\b"
    ),
    "date_of_packing": (
        r"\bdate\s+of\s+pack(?:ing|ed)?\b|\bpacked\s*(?:on|date)?\b"
        r"|\bpkd\.?\s*(?:on|date|dt)?\b|\bpacking\s*date\b"
    ),
    "date_of_import": r"\bdate\s+of\s+import\b|\bimported\s+on\b",
    "best_before": (
        r"\bbest\s*(?:before|by)\b|\buse\s*(?:by|before)\b"
        r"|\bexp(?:iry|ires?|\.)?\s*(?:date|on|dt)?\b|\bexpiration\b|\bconsume\s*(?:by|before)\b"
    ),
}
DATE_ANCHORS = {
    "date_of_manufacture": (
        r"\bdate\s+of\s+(?:manufacture|mfg|mfr)\b|\bmanufactur(?:ed|ing)\s+date\b"
        r"|\bmfg\.?\s*(?:date|dt)\b|\bmfd\.?\s*(?:date|dt)\b"
    ),
    "date_of_packing": (
        r"\bdate\s+of\s+pack(?:ing|ed)?\b|\bpacking\s*date\b"
        r"|\bpacked\s+(?:on|date)\b|\bpkd\.?\s*(?:on|date|dt)\b"
    ),
}
NUMERIC_DATE = r"(?<!\d)(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{4}|\d{2})(?!\d)"
MONTH_YEAR_DATE = r"(?<!\d)(\d{1,2})\s*[/\-.]\s*(\d{4})(?!\d)"
NAMED_MONTH_DATE = rf"(?:(\d{{1,2}})\s*[-/ .]\s*)?({MONTH_WORDS})\.?\s*[-/ .,]?\s*(\d{{4}}|\d{{2}})(?!\d)"
ISO_DATE = r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)"
DURATION = r"(\d{1,3})\s*(days?|weeks?|months?|years?)\b"
BATCH_NUMBER = (
    r"\b(?:batch|lot|b\.?\s*no|l\.?\s*no|bn)\b\.?\s*(?:no\.?|number|code|#)?\s*[:.\-]?\s*"
    r"(?!(?:nos?|number|code)\b)([A-Za-z0-9][A-Za-z0-9\-/]{1,19})"
)
BATCH_ANCHOR = (
    r"\b(?:batch|lot)\b\.?\s*(?:nos?\.?|number|code)\b|\b(?:b|l)\.?\s*no\b\.?|\bbn\b\.?\s*(?:nos?\.?|number|code)\b"
)
CONTACT_KEYWORD = (
    r"\b(?:consumer|customer)\s*(?:care|complaints?|service|helpline)\b"
    r"|\bhelpline\b|\btoll[\s\-]?free\b"
    r"|\bfor\s+(?:any\s+)?(?:queries|complaints?|feedback|grievances?)\b"
    r"|\bcontact\s*(?:us|no|number)?\b|\be-?mail\b"
)
EMAIL = r"[A-Za-z0-9._%+\-]+[ ]?@[ ]?[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
TOLL_FREE_PHONE = r"\b1[\s\-]?800(?:[\s\-]?\d{2,4}){2,3}\b"
MOBILE_PHONE = r"(?:\+?91[\s\-]?)?\b[6-9]\d{4}[\s\-]?\d{5}\b"
COUNTRY_WORD = r"[A-Z][A-Za-z'\-]*"
COUNTRY_VALUE = rf"{COUNTRY_WORD}(?:\s+(?:(?:of|and|the|del|de|du|des)\s+)?{COUNTRY_WORD}){{0,3}}"
COUNTRY_DECLARED = rf"(?i:\bcountry\s+of\s+origin\b\s*[:\-]?\s*)({COUNTRY_VALUE})"
COUNTRY_IMPLIED = (
    rf"(?i:\b(?:made\s+in|product\s+of|produce\s+of|manufactured\s+in|origin)\b\s*[:\-]?\s*)({COUNTRY_VALUE})"
)
ALSO_DOES = r"(?:packed|marketed|distributed|imported)\s*"
NAME_DECLARATIONS = (
    ("manufacturer_name",
     rf"\b(?:manufactured|mfd|mfg|mfr)\.?\s*(?:&|and)?\s*(?:{ALSO_DOES})?by\b\s*[:\-]?\s*(.+)"),
    ("packer_name", rf"\b(?:packed|pkd|packer)\.?\s*(?:&|and)?\s*(?:{ALSO_DOES})?by\b\s*[:\-]?\s*(.+)"),
    ("importer_name", r"\bimport(?:ed|er)\.?\s*by\b\s*[:\-]?\s*(.+)"),
    ("other", r"\bmarketed\s*by\b\s*[:\-]?\s*(.+)"),
)
EDGE_PUNCTUATION = r" \t.,:;\-–—|/\\"

# --- fixed values: unread anchors, typographic forms, markers, placeholder ids, outcomes -----------
# anchors that are strong enough to report a declaration as named but unread
UNREAD_ANCHORS = (
    ("net_quantity", NET_QUANTITY_ANCHOR),
    ("retail_sale_price", MRP_KEYWORD),
    ("unit_sale_price", UNIT_PRICE_ANCHOR),
    ("batch_number", BATCH_ANCHOR),
    ("best_before", DATE_KEYWORDS["best_before"]),
    ("date_of_import", DATE_KEYWORDS["date_of_import"]),
    ("date_of_manufacture", DATE_ANCHORS["date_of_manufacture"]),
    ("date_of_packing", DATE_ANCHORS["date_of_packing"]),
)

# typographic characters and their plain form (the last two disappear)
TYPOGRAPHIC_FROM = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u2013\u2014\u2015\u2026\u200b\ufeff"
TYPOGRAPHIC_TO = "''''\"\"\"\"--- "
NUMBER_TOKEN = "<num>"

MACHINE_MARKERS = (
    "claude", "gpt", "llm", "opus", "sonnet", "haiku", "gemini", "tfidf", "logreg", "classifier",
    "-model", "model-", "automated", "auto-", "draft", "script", "bot",
)
PLACEHOLDER_PRODUCT_IDS = ("", "unknown", "none", "null", "tbd", "todo", "n/a", "x")
TEXT_SOURCES = ("ocr", "manual_transcription")
LEDGER_OUTCOMES = ("confirmed", "changed", "unresolved")
TRUTH_STATES = ("present_and_readable", "present_but_unreadable", "not_present", "unknown")
THRESHOLDS = (0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)

# --- fixed values: taxonomy --------------------------------------------------------------------

FOOD, NON_FOOD, ROOT_CATEGORY = "packaged-food", "packaged-non-food", "packaged-commodity"
UNKNOWN = "unknown"
CATEGORY_SEED = (
    (ROOT_CATEGORY, "Packaged commodity", None),
    (FOOD, "Packaged food", ROOT_CATEGORY),
    (NON_FOOD, "Packaged non-food", ROOT_CATEGORY),
)
# subcategory, category, applicability condition it corresponds to
TAXONOMY = (
    ("general-food", FOOD, None),
    ("health-supplement", FOOD, None),
    ("alcoholic-beverage", FOOD, "alcoholic-beverage"),
    ("cosmetics-and-toiletries", NON_FOOD, "cosmetics-and-toiletries"),
    ("cleaning-product", NON_FOOD, None),
    ("medical-device", NON_FOOD, "medical-device"),
    ("tobacco-product", NON_FOOD, "tobacco-product"),
    ("electronic-product", NON_FOOD, "electronic-product"),
    ("other-non-food", NON_FOOD, None),
)

# --- fixed values: label signals (phrase name, indicative of, pattern over cleaned text) -------

SIGNALS = (
    ("nutritional information", FOOD, r"\bnutrition(?:al)?\s+(?:information|info|facts?|value)\b"),
    ("ingredients", FOOD, r"\bingredients?\b"),
    ("serving size", FOOD, r"\bserving\s+size\b|\bper\s+serving\b|\bservings?\s+per\b"),
    ("energy / kcal", FOOD, r"\benergy\b|\bkcal\b|\bcalories\b"),
    ("protein", FOOD, r"\bprotein\b"),
    ("carbohydrate", FOOD, r"\bcarbohydrates?\b"),
    ("fssai", FOOD, r"\bfssai\b"),
    ("vegetarian mark", FOOD, r"\b(?:non[\s-]?)?vegetarian\b|\bveg\b"),
    ("allergen advice", FOOD, r"\ballergens?\b|\bcontains\s+(?:milk|nuts|soy|gluten|wheat)\b"),
    ("food additive code", FOOD, r"\bins\s+\d{3}\b"),
    ("dairy", FOOD, r"\bmilk\b|\bdairy\b|\bpasteuri[sz]ed\b|\bcurd\b|\bghee\b|\bpaneer\b"),
    ("staple / spice", FOOD,
     r"\bflour\b|\batta\b|\brice\b|\bdal\b|\bmasala\b|\bspices?\b|\bsugar\b|\bsalt\b"),
    ("use by / best before", FOOD, r"\buse\s+by\b|\bbest\s+before\b|\bexpiry\b|\bexp\.?\s*date\b"),
    ("supplement", "health-supplement",
     r"\b(?:dietary|health|nutritional|food|nutraceutical)\s+supplement\b|\bsupplements?\b"),
    ("consumption directions", "health-supplement",
     r"\bdirections?\s+(?:for|of)\s+use\b|\bdosage\b|\bhow\s+to\s+(?:use|consume)\b|\bconsume\b|\bdrop\s*,?\s*fizz\b"),
    ("effervescent / tablets / capsules", "health-supplement",
     r"\beffervescent\b|\btablets?\b|\bcapsules?\b|\bgummies\b"),
    ("not for medicinal use", "health-supplement",
     r"\bnot\s+(?:for|intended\s+for)\s+medicinal\s+use\b|\bnot\s+intended\s+to\s+(?:diagnose|treat|cure)\b"),
    ("vitamin / mineral", "health-supplement",
     r"\bvitamins?\b|\bzinc\b|\bcalcium\b|\biron\b|\bbiotin\b|\bcurcumin\b|\bcollagen\b"),
    ("soap / bathing bar", "cosmetics-and-toiletries",
     r"\bsoap\b|\bbathing\s+bar\b|\bbeauty\s+bar\b|\bbody\s+wash\b"),
    ("shampoo / conditioner", "cosmetics-and-toiletries", r"\bshampoo\b|\bconditioner\b"),
    ("toothpaste", "cosmetics-and-toiletries", r"\btooth\s*paste\b|\bfluoride\b"),
    ("cream / lotion / serum", "cosmetics-and-toiletries",
     r"\bcream\b|\blotion\b|\bmoisturi[sz](?:er|ing)\b|\bserum\b"),
    ("skin / hair care", "cosmetics-and-toiletries", r"\bskin\b|\bhair\b|\bdermatologic(?:al|ally)\b"),
    ("for external use only", "cosmetics-and-toiletries", r"\bfor\s+external\s+use\s+only\b"),
    ("detergent / cleaner", "cleaning-product",
     r"\bdetergents?\b|\bcleaners?\b|\bcleaning\b|\bdisinfectant\b|\bstain\b|\bfloor\b|\bdish\s*wash\b"),
    ("spray / aerosol", "cleaning-product", r"\bspray\b|\baerosol\b|\bpressuri[sz]ed\b"),
    ("flammable / chemical warning", "cleaning-product",
     r"\bflammable\b|\bkeep\s+away\s+from\s+heat\b|\bdo\s+not\s+pierce\b|\bcorrosive\b|\birritation\b"),
    ("antimicrobial / antibacterial", "cleaning-product",
     r"\banti[\s-]?microbial\b|\banti[\s-]?bacterial\b|\bbacteria\b"),
    ("medical device", "medical-device", r"\bmedical\s+device\b|\bdevice\b"),
    ("sterile / single use", "medical-device", r"\bsterile\b|\bsingle\s+use\b|\bdo\s+not\s+reuse\b"),
    ("cdsco / medical licence", "medical-device", r"\bcdsco\b|\bmd\s*-?\s*\d+\b"),
    ("tobacco", "tobacco-product", r"\btobacco\b|\bcigarettes?\b|\bbidi\b|\bkhaini\b|\bgutka\b"),
    ("statutory tobacco warning", "tobacco-product",
     r"\bsmoking\s+kills\b|\bcauses\s+cancer\b|\binjurious\s+to\s+health\b"),
    ("keep out of reach of children", NON_FOOD,
     r"\bkeep\s+(?:out\s+of\s+)?reach\s+of\s+children\b|\bout\s+of\s+reach\b"),
)

# --- fixed values: evidence strings that a classifier records (format_string patterns) ----------

EVIDENCE_TEXT = {
    "few_tokens": "insufficient text: %d word token(s), fewer than the %d required",
    "no_known_term": "insufficient evidence: none of the %d word token(s) is known to the model",
    "weak_category": "below confidence threshold %.2f: best candidate %s (%.2f)",
    "weak_subcategory": "subcategory below threshold %.2f: best candidate %s (%.2f)",
    "signal": "signal: %s (typical of %s)",
    "term": "term: '%s' weighed for %s",
}

# --- fixed values: applicability conditions (code, name, determination, category) --------------

CONDITIONS = (
    ("ordinary-packaged-commodity", "Ordinary packaged commodity intended for retail sale", "not_determinable", None),
    ("food-article", "Package containing food articles", "product_category", FOOD),
    ("imported-product", "Imported product or imported package", "user_declared", None),
    ("wholesale-package", "Wholesale package", "user_declared", None),
    ("export-package", "Export package", "user_declared", None),
    ("industrial-consumer", "Package meant for an industrial consumer", "user_declared", None),
    ("institutional-consumer", "Package meant for an institutional consumer", "user_declared", None),
    ("quantity-above-25kg-25l", "Net quantity of more than 25 kg or 25 litre", "user_declared", None),
    ("bags-above-50kg", "Cement, fertilizer or agricultural farm produce in bags above 50 kg", "user_declared", None),
    ("quantity-10g-10ml-or-less", "Net weight or measure of ten gram or ten millilitre or less", "user_declared", None),
    ("tobacco-product", "Tobacco or tobacco product", "user_declared", None),
    ("fast-food-restaurant-packed", "Fast food items packed by a restaurant or hotel", "user_declared", None),
    ("dpco-formulation", "Scheduled or non-scheduled formulation under the DPCO, 2013", "user_declared", None),
    ("medical-device", "Medical device", "user_declared", None),
    ("thread-coil-handloom", "Thread sold in coil to handloom weavers", "user_declared", None),
    ("alcoholic-beverage", "Alcoholic beverage or spirituous liquor", "user_declared", None),
    ("bidi", "Package containing bidi", "user_declared", None),
    ("incense-sticks", "Package containing incense sticks", "user_declared", None),
    ("domestic-lpg-cylinder", "Domestic liquefied petroleum gas cylinder", "user_declared", None),
    ("cosmetics-and-toiletries", "Soaps, shampoos, toothpastes and other cosmetics and toiletries", "user_declared", None),
    ("seeds-certified", "Seeds labelled and certified under the Seeds Act, 1966", "user_declared", None),
    ("genetically-modified-food", "Genetically modified food", "not_determinable", None),
    ("perishable-commodity", "Commodity that may become unfit for human consumption after a period", "user_declared", None),
    ("sizes-relevant", "Commodity whose sizes are relevant", "not_determinable", None),
    ("multi-component-package", "Commodity whose components are packed in two or more units", "not_determinable", None),
    ("promotional-group-package", "Packages grouped together for sale on a promotional offer", "not_determinable", None),
    ("multi-piece-package", "Multi-piece package", "not_determinable", None),
    ("group-package", "Group package", "not_determinable", None),
    ("combination-package", "Combination package", "not_determinable", None),
    ("outer-container-or-wrapper", "Package provided with an outside container or wrapper", "not_determinable", None),
    ("third-schedule-commodity", "Commodity listed in the Third Schedule", "not_determinable", None),
    ("solid-liquid-or-by-number", "Physical state of the commodity, or sale by number", "not_determinable", None),
    ("ecommerce-listing", "Offered for sale through an e-commerce platform", "user_declared", None),
    ("loose-commodity-via-ecommerce", "Loose commodity ordered through an e-commerce platform", "not_determinable", None),
    ("electronic-product", "Electronic product", "not_determinable", None),
    ("pan-masala", "Pan masala", "not_determinable", None),
    ("aeo-bonded-warehouse", "Goods in an AEO bonded warehouse", "not_determinable", None),
    ("rule-33-relaxation-granted", "A relaxation has been granted under rule 33", "not_determinable", None),
    ("registered-manufacturer-packer-importer", "Registration held under Chapter VI", "database", None),
)

# --- fixed values: scope clauses, links, check types, states and shapes of identifiers -------------
DETERMINATIONS = ("product_category", "user_declared", "database", "not_determinable")
RUN_STATUSES = ("completed", "partial", "failed")
SAMPLE_ID = r"^[A-Za-z0-9][A-Za-z0-9._\-]{0,127}$"
VERSION_NAME = r"^[A-Za-z0-9][A-Za-z0-9._\-]{0,63}$"
SHA256 = r"^[0-9a-f]{64}$"
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"

SCOPE_CLAUSES = ("3", "26")

#: Name of a product that a submission creates.
UNIDENTIFIED = "Unidentified submission"
# clause, mode, condition codes
LINKS = (
    ("3", "scope_gate", ("quantity-above-25kg-25l", "bags-above-50kg", "industrial-consumer", "institutional-consumer")),
    ("26", "scope_gate",
     ("quantity-10g-10ml-or-less", "fast-food-restaurant-packed", "dpco-formulation", "thread-coil-handloom")),
    ("26", "withholds_exemption", ("tobacco-product", "medical-device")),
    ("6(1)(a)", "exempts", ("food-article",)),
    ("6(1)(aa)", "requires", ("imported-product",)),
    ("6(1)(d)", "exempts",
     ("food-article", "seeds-certified", "cosmetics-and-toiletries", "bidi", "incense-sticks", "domestic-lpg-cylinder")),
    ("6(1)(e)", "exempts", ("bidi", "domestic-lpg-cylinder", "alcoholic-beverage")),
)

CHECK_TYPES = (
    "field_presence", "field_presence_any_of", "consumer_care_elements", "month_year_declaration",
    "si_unit", "prohibited_counting_unit", "retail_price_tax_declaration",
)
PLANNED_CHECK_TYPES = ("value_check", "format_check", "numeric_check", "conditional_check", "visual_check")
SEVERITIES = ("info", "minor", "major", "critical")
SOURCE_STATUSES = ("verified", "unverified")
DETECTION_METHODS = (
    "ocr", "cv", "ocr_cv", "database", "user_input", "digital_ecommerce", "physical_inspection",
    "administrative", "manual_review", "not_applicable",
)
IMAGE_EVALUABLE_METHODS = ("ocr", "cv", "ocr_cv")
INSTRUMENT_TYPES = ("principal", "amendment", "consolidated_publication")
VERIFICATION_STATUSES = ("verified", "unverified", "requires_review")
AUTOMATION_CLASSES = (
    "image_automatable", "partially_automatable", "digital_ecommerce", "physical_measurement", "administrative", "manual_review",
)
IMPLEMENTATION_STATUSES = (
    "implemented", "implementable_now", "implementable_with_new_check", "blocked_by_missing_applicability_data",
    "blocked_by_missing_extraction_field", "legal_review_required", "not_applicable_to_project_scope",
)
LINK_MODES = ("requires", "exempts", "scope_gate", "withholds_exemption")

# code, check_type, comma-separated keys, target category, clause, in force from, conditional, active, severity, title
RULES = (
    ("LM-PC-0001", "field_presence_any_of", "manufacturer_name,packer_name,importer_name", NON_FOOD, "6(1)(a)",
     "2018-01-01", False, True, "major", "Name and address of the manufacturer, packer or importer"),
    ("LM-PC-0002", "field_presence", "common_or_generic_name", ROOT_CATEGORY, "6(1)(b)",
     "2011-04-01", False, False, "major", "Common or generic name of the commodity"),
    ("LM-PC-0003", "field_presence", "net_quantity", ROOT_CATEGORY, "6(1)(c)",
     "2011-04-01", False, True, "major", "Net quantity of the commodity"),
    ("LM-PC-0004", "field_presence", "date_of_manufacture", NON_FOOD, "6(1)(d)",
     "2022-10-01", True, True, "major", "Month and year of manufacture"),
    ("LM-PC-0005", "field_presence", "retail_sale_price", ROOT_CATEGORY, "6(1)(e)",
     "2022-10-01", True, True, "major", "Retail sale price (maximum retail price)"),
    ("LM-PC-0006", "field_presence", "consumer_care_contact", ROOT_CATEGORY, "6(2)",
     "2016-01-01", False, True, "major", "Consumer care details"),
    ("LM-PC-0007", "field_presence", "country_of_origin", ROOT_CATEGORY, "6(1)(aa)",
     "2018-01-01", True, True, "major", "Country of origin for imported products"),
    ("LM-PC-0008", "si_unit", "", ROOT_CATEGORY, "13(5)",
     "2022-10-01", False, True, "major", "Net quantity in units of the International System of Units"),
    ("LM-PC-0009", "prohibited_counting_unit", "", ROOT_CATEGORY, "13(4)",
     "2011-04-01", False, True, "minor", "No dozen, score, gross or great gross on the package"),
    ("LM-PC-0010", "consumer_care_elements", "", ROOT_CATEGORY, "6(2)",
     "2016-01-01", False, True, "major", "Consumer care telephone number and e-mail address"),
    ("LM-PC-0011", "month_year_declaration", "date_of_manufacture", NON_FOOD, "6(1)(d)",
     "2022-10-01", True, True, "major", "Month and year of manufacture must be determinable"),
    ("LM-PC-0012", "retail_price_tax_declaration", "", ROOT_CATEGORY, "6(1)(e)",
     "2022-10-01", True, True, "major", "Retail sale price must not be declared exclusive of taxes"),
)


# --- small tables ------------------------------------------------------------------------------


def sql_literal(value) -> str:
    """Render a Python scalar as a literal both Spark SQL and ANSI SQL accept."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(columns: Sequence[str], rows: Iterable[Sequence]) -> str:
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def inline_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A literal dimension.  Its size is known to the planner, so joins to it stay map-side."""
    return spark.sql(values_sql(columns, rows))


CONDITION_COLUMNS = ("condition_code", "condition_name", "determination", "category_code")
LINK_COLUMNS = ("clause", "mode", "condition_code", "link_order")
RULE_COLUMNS = (
    "rule_code", "check_type", "keys", "target", "clause", "effective_from", "conditional", "is_active",
    "severity", "title", "source_status",
)


def condition_rows():
    return [row + (True,) for row in CONDITIONS]


def link_rows():
    rows, position = [], 0
    for clause, mode, codes in LINKS:
        for code in codes:
            rows.append((clause, mode, code, position))
            position += 1
    return rows


def rule_rows(unverified: Sequence[str] = ()):
    return [
        (code, kind, keys, target, clause, date.fromisoformat(start), cond, active, severity, title,
         "unverified" if code in unverified else "verified")
        for code, kind, keys, target, clause, start, cond, active, severity, title in RULES
    ]


def conditions_sql() -> str:
    return values_sql(CONDITION_COLUMNS + ("is_active",), condition_rows())


def links_sql() -> str:
    return values_sql(LINK_COLUMNS, link_rows())


def rules_sql(unverified: Sequence[str] = ()) -> str:
    return values_sql(RULE_COLUMNS, rule_rows(unverified))


def categories_sql() -> str:
    return values_sql(("category_code", "name", "parent_code"), CATEGORY_SEED)


def taxonomy_sql() -> str:
    return values_sql(("subcategory", "category", "condition_code"), TAXONOMY)

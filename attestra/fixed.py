"""Fixed values that results depend on: word lists, rules, identifiers, weights."""

from __future__ import annotations

#: Fixed: tokens are runs of letters and digits, with one decimal part and a per cent sign.
TOKEN = r"[a-zA-Z0-9]+(?:\.[0-9]+)?%?"

#: Fixed: stopwords of the index.
INDEX_STOPWORDS = """
a an the is are was were be been being have has had do does did will would could should may might shall can need dare
ought to of in for on with at by from as into through during before after above below between out off over under again
further then once here there when where why how all each every both few more most other some such no nor not only own
same so than too very just because but and or if while that this what which who whom these those it its i me my we our
you your he she him her they them their up about
""".split()
#: Fixed: stopwords of keywords.
KEYWORD_STOPWORDS = """
a an the is are was were be been being have has had do does did will would could should may might shall can need dare
ought used to of in for on with at by from as into through during before after above below between out off over under
again further then once here there when where why how all each every both few more most other some such no nor not only
own same so than too very just because but and or if while that this what which who whom these those it its
""".split()

#: Fixed: irregular stems, then suffixes with what replaces them; the first that fits wins.
IRREGULAR_STEMS = {
    "frozen": "freez", "freeze": "freez", "freezing": "freez", "warming": "warm", "warmed": "warm", "injecting": "inject",
    "injected": "inject", "injection": "inject", "expired": "expir", "expiring": "expir", "expiration": "expir",
    "discarding": "discard", "discarded": "discard", "washing": "wash", "washed": "wash", "unused": "unus",
}
SUFFIXES = [
    ("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("ement", ""), ("ment", ""), ("ness", ""), ("ating", "ate"), ("izing", "ize"), ("ible", ""), ("able", ""), ("tion", ""),
    ("sion", ""), ("ling", "l"), ("ying", "y"), ("ing", ""), ("ied", "y"), ("ies", "y"), ("ed", ""), ("er", ""), ("ly", ""),
    ("es", ""), ("s", ""),
]

#: Fixed: words that the all-keyword search, the any-keyword search and both leave out or put last.
REWRITER_NOISE = "evidence supports support supporting claim avoiding recommendation approach method according regarding concerning suggests".split()
ALL_KEYWORD_NOISE = """
evidence supports support supporting claim avoiding recommendation approach method according regarding concerning suggests
patients treated treatment study clinical
""".split()
COMMON_CLINICAL = """
patients treated treatment study clinical adverse reactions occurred placebo compared versus results data safety efficacy
dose mg administration recommended use risk events reported trials subjects
""".split()

#: Fixed: capitalised words that are no product names; the brand detector knows two more.
PRODUCT_STOPWORDS = """
do not the and for use with into that this from have been should store patients always prior after before injection
prefilled syringe temperature room days make sure check discard
""".split()
BRAND_STOPWORDS = """
do not the and for use with into that this from have been should store patients always prior after before injection
prefilled syringe temperature room days make sure check discard adhere stage
""".split()

#: Fixed: claim types whose first authority is a trial, not the label.
TRIAL_PRIMARY = """
CT-201 CT-202 CT-203 CT-204 CT-205 CT-206 CT-207 CT-208 CT-209 CT-301 CT-302 CT-303 CT-310 CT-401 CT-402 CT-403 CT-404
CT-801 CT-802 CT-803 CT-804
""".split()
#: Fixed: reference types of labels.
LABEL_TYPES = ["RT-101", "RT-102"]

#: Fixed: retired reference types.
RETIRED_TYPES = {"RT-602": "RT-601"}
#: Fixed: claim types that modify others, that await a mapping, and that are for one audience.
MODIFIERS = "CT-204 CT-A01 CT-A02 CT-A03 CT-A04 CT-A05 CT-A06 CT-A07 CT-A08".split()
PENDING = "CT-D01 CT-D02 CT-D03 CT-D04 CT-D05 CT-D06".split()
PAYER_ONLY = "CT-405 CT-901 CT-902 CT-903 CT-904 CT-905 CT-906 CT-907 CT-908 CT-909 CT-B02 CT-B03".split()
HCP_ONLY = "CT-B01 CT-B04".split()
#: Fixed: claim types of each group.
GROUPS = {
    "A1": "CT-101 CT-102 CT-103 CT-104 CT-105 CT-106 CT-107 CT-108 CT-109 CT-110".split(),
    "A2": "CT-201 CT-202 CT-203 CT-204 CT-205 CT-206 CT-207 CT-208 CT-209".split(),
    "A3": "CT-301 CT-302 CT-303 CT-304 CT-305 CT-306 CT-307 CT-308 CT-309 CT-310 CT-311".split(),
    "A4": "CT-401 CT-402 CT-403 CT-404 CT-405 CT-406 CT-407 CT-408 CT-409".split(),
    "A5": "CT-501 CT-502 CT-503 CT-504 CT-505 CT-506 CT-507".split(),
    "A6": "CT-601 CT-602 CT-603 CT-604 CT-605 CT-606 CT-607 CT-608".split(),
    "A7": "CT-701 CT-702 CT-703 CT-704 CT-705 CT-706".split(),
    "A8": "CT-801 CT-802 CT-803 CT-804 CT-805 CT-806 CT-807".split(),
    "A9": "CT-901 CT-902 CT-903 CT-904 CT-905 CT-906 CT-907 CT-908 CT-909".split(),
    "A10": "CT-B01 CT-B02 CT-B03 CT-B04 CT-A01 CT-A02 CT-A03 CT-A04 CT-A05 CT-A06 CT-A07 CT-A08".split(),
    "A11": "CT-D01 CT-D02 CT-D03 CT-D04 CT-D05 CT-D06".split(),
}

#: Fixed: efficacy types of the gate's statistics and fair-balance rules.
GATE_EFFICACY = ["CT-201", "CT-202", "CT-203", "CT-501", "CT-502"]

#: Fixed: constant of reciprocal rank fusion; weights with and without exact hits; tier boosts; other factors.
RRF_K = 60
WEIGHTS_EXACT, WEIGHTS = (0.50, 0.25, 0.25), (0.7, 0.3, 0.0)
TIER_BOOST = {"P": 2.0, "A": 1.0, "C": 0.5}
NO_TIER_BOOST, OFF_PRODUCT, ANCHOR_BOOST, PRODUCT_BOOST = 0.5, 0.3, 1.5, 1.5
PER_SOURCE = 5

#: Fixed: numeric expressions, in the order in which they are tried.
NUMERIC = [
    r"p\s*[<>=≤≥]\s*0?\.\d+",
    r"\d+\.?\d*\s*%",
    r"OR\s*[=:]\s*\d+\.?\d*",
    r"HR\s*[=:]\s*\d+\.?\d*",
    r"RR\s*[=:]\s*\d+\.?\d*",
    r"CI\s*[,:]\s*\d+\.?\d*\s*[-–]\s*\d+\.?\d*",
    r"n\s*=\s*\d+",
    r"\d+\.?\d*\s*(?:mg|g|kg|mL|L|mcg|µg|IU|U)\b",
    r"\d+\.?\d*-fold\b",
    r"\d+\.?\d*\s*x\b",
    r"\d+\.?\d*",
]
#: Fixed: words near a number that make it data, and that keep a year.
CLINICAL_CONTEXT = "% mg kg ml g/dl mmol mcg iu dose score rate mean median range ci hr or rr p= p< p> n= fold week month day year patient difference improvement reduction increase baseline endpoint efficacy response".split()
YEAR_CONTEXT = ["%", "n=", "mg", "dose", "score", "rate"]
DEGREES = "MD PhD BSc MSc FMedSci CSc FRCP FAAN DO RN MPH".split()
#: Fixed: characters of context on either side of a number.
CONTEXT = 40

#: Fixed: sizes of chunks in tokens of four characters, and of the section prefix.
CHARS_PER_TOKEN, TARGET_TOKENS, MAX_TOKENS, PREFIX = 4, 400, 500, 80
#: Fixed: abbreviations after which no sentence ends.
ABBREVIATIONS = "Dr Mr Mrs Ms Fig Figs vs al et eg ie cf approx incl excl no vol Suppl Ref Prof Jr Sr St dept".split()

#: Fixed: patterns of cleaning: page furniture, images, anchors, tags, emphasis, headings.
PAGE_FURNITURE = r"(?s)<page_(header|footer)>.*?</page_\1>"
IMAGE_END = r"\]\([^)]+\.(?:jpg|png|jpeg|gif|svg|webp)[^)]*\)"
BLANK_LINES = r"\n{3,}"
ANCHOR = r"(?i)<a id=['\"][^'\"]*['\"]></a>"
TAG = r"<[^>]+>"
FORMAT_TAG = r"</?(?:sup|sub|u|b|i|em|strong|br|p|div|span|a|img|mark)[^>]*>"
EMPHASIS = [r"\*{1,2}([^*]+)\*{1,2}", r"_{1,2}([^_]+)_{1,2}"]
EMPHASIS_PAIRS = [r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"__(.+?)__"]
HEADING_MARK = r"(?m)^#{1,6}\s*"
#: Fixed: patterns of metadata, product names, replies and claim lists.
DOI_TOLD, DOI_BARE, DOI_END = r"(?i)(?:doi\.org/|doi:?\s*)(10\.\d{4,9}/[^\s,]+)", r"(10\.\d{4,9}/[^\s,]+)", r"[.,;)]+$"
YEAR, TRIAL_ID, TITLE, TITLE_MARKS = r"\b(19[89]\d|20[012]\d)\b", r"NCT\d{7,8}", r"(?m)^#\s+(.+)$", r"[*_`]"
CAPITALISED = r"\b[A-Z][A-Za-z]{1,}\b"
JSON_OBJECT = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
PARENT_ROW = r"(?:Duplicate|Variation) of row (\d+)"
KEY_PASSAGE = r"[Pp]assage\s+(\d+)"
QUEUE_TYPE = r"^CT-[A-Z0-9]+$"
#: Fixed: patterns of sentences and of Markdown blocks.
SENTENCE_END, PLAIN_SENTENCE_END = r"(?<=[.?!])\s+(?=[A-Z])", r"(?<=[.!?])\s+"
HEADING, FIGURE, TABLE_CAPTION = r"(#{1,4})\s+(.+)", r"Figure\s+\d+", r"Table\s+\d+"
PIPE_ROW, PIPE_RULE = r"\s*\|.+\|\s*", r"\s*\|[-:| ]+\|\s*"
NUMBERED_ENTRY, AUTHOR_ENTRY = r"\d+\.\s", r"[A-Z][a-z]+\s+[A-Z]{1,3}"
ENTRY_BREAKS = [r"(?=\b\d{1,3}\.\s+[A-Z])", r"(?<=\d{4}[.;])\s+(?=[A-Z][a-z]+\s+[A-Z])"]
TABLE_HEAD, TABLE_FIRST_ROW = r"<table[^>]*>.*?<thead>.*?</thead>", r"<table[^>]*>.*?<tr>.*?</tr>"
TABLE_TITLE, TABLE_BODY, TABLE_ROW = r"<caption>.*?</caption>", r"<tbody>(.*?)</tbody>", r"<tr>.*?</tr>"
#: Fixed: patterns of citation marks.
LISTED_MARK, DOTS, AFTER_SECTION = r"[.,]\d{1,3}[.,]", r"\.[\s.]{4,}$", r"\s*[,).]"
#: Fixed: patterns of mapping files.
MATRIX_RULE, MATRIX_HEAD = r"^\|[-\s|]+\|$", r"^###\s+(CT-[A-Z0-9]+(?:-[A-Z0-9]+)?)\s*[—\-–]"
MATRIX_SHEET, ANY_SHEET = "Sheet: Mapping (Long)", "## Sheet:"
#: Fixed: patterns of quality checks.
NUMBER, CONTROL, TABLE_TAG = r"\d+\.?\d*", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", r"(?i)</?t[dhrab]"

#: Fixed: texts of the gate's flags and blockers.
BELOW_PASS, BELOW_SOFT = "% is below pass threshold (", "% is below minimum ("
SCORE, MISMATCH, SERIOUS = "Coverage score ", "PICOT mismatch on: ", "Critical PICOT dimension failed — downgraded to soft_flag"
NO_STATISTICS = "Claim implies statistical significance but no p-value/CI found in evidence"
NO_BALANCE = "Fair balance: no corresponding safety information found for efficacy claim"
TRANSFORMED = "Numerical transformations detected: "
SECONDARY = "Evidence relies on a secondary citation — primary source required"

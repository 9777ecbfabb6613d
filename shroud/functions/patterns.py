"""Entity types, detector patterns, label maps, blocklist, pools.

Everything in the "fixed values" blocks must stay exactly as written: detection
results, resolution order and surrogate values depend on them, and the DuckDB
oracle in ``shroud.plans.oracle`` renders the very same lists into SQL.
"""

from __future__ import annotations

# --- fixed values: entity types ------------------------------------------------
ENTITY_TYPES = [
    "PERSON",
    "EMAIL",
    "PHONE",
    "ORG",
    "ADDRESS",
    "SSN",
    "CREDIT_CARD",
    "DATE_OF_BIRTH",
    "IP_ADDRESS",
]

# --- fixed values: structured-PII patterns (order matters: it is the tie order) --
# Written in the portable (Python ``re``) dialect.  ``java_pattern`` adds the
# Unicode flag so that \d \s \b \w behave like Python's.
REGEX_PATTERNS = [
    ("EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", True),
    ("SSN", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", False),
    (
        "IP_ADDRESS",
        r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
        False,
    ),
    (
        "CREDIT_CARD",
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}"
        r"|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}"
        r"|(?:2131|1800|35\d{3})\d{11})\b",
        False,
    ),
    (
        "DATE_OF_BIRTH",
        r"\b(?:DOB|Date of Birth|Born|Birth Date)\s*[:\-]?\s*"
        r"(?:\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}"
        r"|\d{4}[\/\-\.]\d{1,2}[\/\-\.]\d{1,2}"
        r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b",
        True,
    ),
    (
        "PHONE",
        r"(?:\+?\d{1,3}[\s\-\.]?)?"
        r"(?:\(?\d{3}\)?[\s\-\.]?)"
        r"\d{3}[\s\-\.]\d{4}"
        r"(?:\s*(?:x|ext|extension)\.?\s*\d{1,5})?",
        False,
    ),
]

# SSN in an engine without look-ahead: the plain shape, then these exclusions
# (area, group, serial).  Two shapes can never overlap, so this is equivalent.
SSN_SHAPE = r"\b\d{3}-\d{2}-\d{4}\b"

# Cheap necessary conditions checked before the full pattern runs.
# Each is implied by a match of the pattern, so skipping on a miss is exact.
REGEX_GUARDS = {
    "EMAIL": ("contains", "@"),
    "SSN": ("contains", "-"),
    "IP_ADDRESS": ("contains", "."),
    "CREDIT_CARD": ("rlike", r"\d{13}"),  # one branch takes any decimal digit
    "DATE_OF_BIRTH": ("rlike", r"(?i)dob|born|birth"),
    "PHONE": ("rlike", r"\d{3}[\s\-\.]\d{4}"),
}

# --- fixed values: label maps --------------------------------------------------
NER_LABEL_MAP = [
    ("PERSON", "PERSON"),
    ("ORG", "ORG"),
    ("GPE", "ADDRESS"),
    ("LOC", "ADDRESS"),
    ("FAC", "ADDRESS"),
]

SCORED_LABEL_MAP = [
    ("PERSON", "PERSON"),
    ("EMAIL_ADDRESS", "EMAIL"),
    ("PHONE_NUMBER", "PHONE"),
    ("CREDIT_CARD", "CREDIT_CARD"),
    ("US_SSN", "SSN"),
    ("IP_ADDRESS", "IP_ADDRESS"),
    ("DATE_TIME", "DATE_OF_BIRTH"),
    ("LOCATION", "ADDRESS"),
]

CONFIDENCE_THRESHOLD = 0.4
GAZETTEER_SCORE = 0.85

# --- fixed values: blocklist (normalised text) ---------------------------------
IGNORED_ENTITIES = [
    "company",
    "the company",
    "equity shares",
    "equity share",
    "shares",
    "share",
    "offer",
    "the offer",
    "floor price",
    "cap price",
    "offer price",
    "issue",
    "the issue",
    "board",
    "the board",
    "board of directors",
    "promoter",
    "promoters",
    "red herring prospectus",
    "prospectus",
    "sebi",
    "sebi icdr regulations",
    "icdr regulations",
    "book building process",
    "book running lead managers",
    "anchor investors",
    "upi",
    "asba",
    "asba bidders",
    "qibs",
    "nii",
    "niis",
    "rii",
    "riis",
    "bids",
    "bid",
    "bidders",
    "bidder",
    "table",
    "order",
    "ticket",
    "section",
    "act",
    "companies act",
    "registrar of companies",
]

SHORT_NAME_TYPES = ["PERSON", "ORG", "ADDRESS"]

# --- scored recognisers (own design; the scored layer's rule table) ------------
# (label, pattern, base score, validator, context words, context window, boost)
# A span's score is base, plus boost when a context word occurs within
# ``window`` characters on either side.  Validator "luhn" drops a candidate
# whose digits fail the Luhn check and sets its score to 1.0 otherwise.
SCORED_RECOGNIZERS = [
    ("EMAIL_ADDRESS", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9\-]+(?:\.[a-zA-Z0-9\-]+)*\.[a-zA-Z]{2,}\b",
     1.0, "", [], 0, 0.0),
    ("CREDIT_CARD", r"\b[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,7}\b",
     0.3, "luhn", [], 0, 0.0),
    ("PHONE_NUMBER", r"\+[0-9]{1,3}[ \.\-][0-9]{2,4}[ \.\-][0-9]{3,4}[ \.\-][0-9]{3,4}\b",
     0.5, "", ["phone", "call", "tel", "mobile"], 30, 0.3),
    ("US_SSN", r"\b[0-9]{9}\b", 0.05, "", ["ssn", "social security"], 30, 0.6),
    ("IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", 0.6, "", [], 0, 0.0),
    ("DATE_TIME", r"\b(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\b", 0.6, "", [], 0, 0.0),
    ("DATE_TIME", r"\b(?:19|20)[0-9]{2}\b", 0.1, "", ["born", "birth", "year"], 20, 0.4),
    ("LOCATION", r"\b[0-9]{1,5} [A-Z][a-z]+ (?:Street|Avenue|Road)\b", 0.7, "", [], 0, 0.0),
    ("NRP", r"\b(?:French|German|Spanish|English)\b", 0.85, "", [], 0, 0.0),
]

# --- fixed values: surrogate pools (invented words) ----------------------------
FIRST_NAMES = [
    "Alder", "Brisa", "Corvin", "Dalia", "Evander", "Fenna", "Galen", "Hesper",
    "Ilka", "Jorah", "Kestrel", "Lunet", "Maelis", "Nerio", "Orla", "Perrin",
    "Quilla", "Rowan", "Sabine", "Teodor", "Ulla", "Varo", "Wren", "Yselle",
]
LAST_NAMES = [
    "Ashgrove", "Bramley", "Coldwater", "Dunmore", "Elsworth", "Fairholt",
    "Greymoor", "Hollins", "Ivesdale", "Kettering", "Larkspur", "Merrow",
    "Northam", "Oakhurst", "Pembrook", "Redfern", "Stanway", "Thornbury",
    "Underhill", "Westcott",
]
CITIES = [
    "Amberford", "Brookhaven", "Cinderwell", "Dovermere", "Eastmarsh", "Falkridge",
    "Glenhollow", "Harrowgate", "Ironvale", "Juniper Bay", "Kingsreach", "Lowmoor",
    "Millbrook", "Northwick", "Oldcastle", "Pinecrest", "Queensford", "Riverton",
]
COMPANY_WORDS = [
    "Arclight", "Bluefen", "Copperline", "Driftwood", "Emberly", "Foxglove",
    "Granite", "Harbor", "Islewise", "Juniper", "Kiteway", "Lanternfield",
    "Meridian", "Northgate", "Orchard", "Pinnacle",
]
COMPANY_SUFFIXES = ["Inc", "LLC", "Group", "Ltd", "and Sons", "Partners"]
EMAIL_DOMAINS = ["example.com", "example.org", "example.net"]

SURROGATE_SALT = "shroud"
SURROGATE_AS_OF = "2024-01-01"


# White space of Python's ``str`` that Unicode-aware Java classes lack: the four separators U+001C..U+001F.
EXTRA_SPACE = r"\x1c-\x1f"
SPACE_CLASS = r"[\s" + EXTRA_SPACE + "]"
NOT_SPACE_CLASS = r"[^\s" + EXTRA_SPACE + "]"


def spaced_pattern(pattern: str) -> str:
    """The pattern with the four separators wherever ``\\s`` stands (inside a class they join it)."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k:k + 2]
        if two[0] == "\\":
            out.append((r"\s" + EXTRA_SPACE if inside else SPACE_CLASS) if two == r"\s" else two)
            k += 2
            continue
        inside = two[0] == "[" or inside and two[0] != "]"
        out.append(two[0])
        k += 1
    return "".join(out)


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Spark (java.util.regex) with Python-like Unicode classes: flags, and the four separators."""
    return ("(?iU)" if ignore_case else "(?U)") + spaced_pattern(pattern)


def re2_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for an RE2 engine (DuckDB); no look-around allowed."""
    return ("(?i)" if ignore_case else "") + pattern

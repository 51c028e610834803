"""What to look for: entity types, tags, scored patterns and word lists.

Everything here is plain data. Execution lives in ``functions`` and
``operators``; a :class:`Catalogue` is immutable, so a caller can derive an own
one (``catalogue.with_detector(...)``) without touching the defaults.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# --------------------------------------------------------------------------
# Fixed values. Results depend on these being exactly as they are.
# --------------------------------------------------------------------------

ENTITY_OPTIONS = {
    "Names (PERSON)": "PERSON",
    "Phone numbers": "PHONE_NUMBER",
    "Email addresses": "EMAIL_ADDRESS",
    "National Insurance numbers (UK_NINO)": "UK_NINO",
    "UK postcodes": "UK_POSTCODE",
    "Housing / repair / tenancy references (HOUSING_REF)": "HOUSING_REF",
    "Key-safe / access codes (ACCESS_CODE)": "ACCESS_CODE",
    "Broader locations (LOCATION)": "LOCATION",
    "Dates / times (DATE_TIME)": "DATE_TIME",
    "Organisations (ORGANIZATION)": "ORGANIZATION",
}

DEFAULT_ENTITY_TYPES = (
    "PERSON",
    "PHONE_NUMBER",
    "EMAIL_ADDRESS",
    "UK_NINO",
    "UK_POSTCODE",
    "HOUSING_REF",
    "ACCESS_CODE",
)

GENERIC_TAG = "<REDACTED>"

ENTITY_TAGS = {
    "PERSON": "<PERSON>",
    "PHONE_NUMBER": "<PHONE_NUMBER>",
    "EMAIL_ADDRESS": "<EMAIL>",
    "UK_NINO": "<NINO>",
    "UK_POSTCODE": "<POSTCODE>",
    "HOUSING_REF": "<HOUSING_REF>",
    "ACCESS_CODE": "<ACCESS_CODE>",
    "LOCATION": "<LOCATION>",
    "DATE_TIME": "<DATE_TIME>",
    "ORGANIZATION": "<ORGANIZATION>",
}

STYLE_GENERIC = "Generic <REDACTED> (recommended)"
STYLE_ENTITY_TAGS = "Entity-specific tags"

LIBRARY_THRESHOLD = 0.4
INTERACTIVE_THRESHOLD = 0.45
MIN_THRESHOLD = 0.1
MAX_THRESHOLD = 0.9
THRESHOLD_STEP = 0.05

CONTEXT_BOOST = 0.35
CONTEXT_MIN_SCORE = 0.4
CONTEXT_WORDS_BEFORE = 5
MODEL_SCORE = 0.85

OUTPUT_SUFFIX = "_Anonymised"

TEXT_COLUMN_KEYWORDS = (
    "comment", "description", "note", "notes", "free", "text", "details", "message",
)

ALLOW_LIST = (
    "Landlord", "Landlords", "Landlady", "Landladies",
    "Tenant", "Tenants", "Workman", "Workmen",
    "Contractor", "Contractors", "Occupant", "Occupants",
    "Resident", "Residents", "Neighbour", "Neighbours",
    "Multiple", "Mutliple",
)

CSV_NA_TOKENS = (
    "", "NA", "N/A", "n/a", "NULL", "null", "None", "NaN", "nan", "-nan",
    "-NaN", "<NA>", "#N/A", "#NA", "#N/A N/A", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)

MODEL_LABELS = {
    "PERSON": "PERSON",
    "PER": "PERSON",
    "GPE": "LOCATION",
    "LOC": "LOCATION",
    "FAC": "LOCATION",
    "LOCATION": "LOCATION",
    "ORG": "ORGANIZATION",
    "ORGANIZATION": "ORGANIZATION",
    "DATE": "DATE_TIME",
    "TIME": "DATE_TIME",
    "DATE_TIME": "DATE_TIME",
}

UK_POSTCODE = (
    r"\b(?:GIR ?0AA|"
    r"(?:[A-PR-UWYZ][0-9][0-9A-HJKMNPR-Y]?|"
    r"[A-PR-UWYZ][A-HK-Y][0-9][0-9ABEHMNPRV-Y]?) ?"
    r"[0-9][ABD-HJLNP-UW-Z]{2})\b"
)
UK_NINO_STRICT = (
    r"\b(?!BG|GB|KN|NK|NT|TN|ZZ)"
    r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]"
    r"\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b"
)
UK_NINO_FLEXIBLE = r"\b(?!BG|GB|KN|NK|NT|TN|ZZ)[A-Z]{2}\s?\d{6}\s?[A-D]\b"
UK_MOBILE = (
    r"\b(?:"
    r"(?:\+44[\s\-]?7\d{3}[\s\-]?\d{6})|"
    r"(?:0?7\d{3}[\s\-]?\d{6})|"
    r"(?:\+44[\s\-]?7(?:[\s\-]?\d){9})|"
    r"(?:07(?:[\s\-]?\d){9})"
    r")\b"
)
UK_LANDLINE = r"\b(?:(?:\+44[\s\-]?|0)\d{2,4}[\s\-]?\d{3,4}[\s\-]?\d{3,4}|0\d{9,10})\b"
REF_BH = r"\bBH[- ]?\d{3,6}\b"
REF_REP = r"\bREP[- ]?(?:20)?\d{2}[- ]?\d{3,6}\b"
REF_TENANCY = r"\bTEN(?:ANCY)?[- ]?\d{4,8}\b"
REF_CUSTOMER = r"\b(?:CUS|CUSTOMER)[- ]?\d{4,8}\b"
REF_JOB = r"\b(?:JOB|REF|PROP|WO|WORK)[- ]?\d{4,8}\b"
CODE_LABELLED = (
    r"(?i)(?:key\s*safe|keysafe|access\s*code|pin\s*code|code|combination)[:\s#-]*(\d{4,6})\b"
)
CODE_BARE = r"\b\d{4,6}\b"
NAME_LABEL = r"(?<=Name: )[^\r\n]+"
TITLE_NAME = (
    r"\b(?:Mr|Mrs|Miss|Ms|Mx)\.?[ \t]+"
    r"(?:&[ \t]+(?:Mr|Mrs|Miss|Ms|Mx)\.?[ \t]+)?"
    r"[A-Z][a-zA-Z'’-]*(?:[ \t]+[A-Z][a-zA-Z'’-]*){0,2}"
)
LONG_DIGITS = r"\b\d{8,}\b"
REDACTION_TAG = r"^<[A-Z_]+>$"

POSTCODE_CONTEXT = (
    "postcode", "post code", "address", "flat", "house",
    "street", "road", "lane", "avenue", "borough", "district",
)
NINO_CONTEXT = (
    "national insurance", "nino", "ni number", "ni no",
    "insurance number", "national insurance number", "ni",
)
PHONE_CONTEXT = (
    "phone", "call", "mobile", "telephone", "tel", "contact",
    "ring", "number", "mobile number", "contact number",
)
HOUSING_CONTEXT = (
    "property", "ref", "reference", "job", "repair", "tenancy",
    "tenant", "customer", "order", "works order", "bh-", "rep-", "ten-",
)
CODE_CONTEXT = (
    "key safe", "keysafe", "access code", "access", "code",
    "pin", "combination", "leave key", "key with", "neighbour",
)
NAME_LABEL_CONTEXT = ("name:",)

MISSED_NAME_LABEL = "POSSIBLE_MISSED_NAME"

# --------------------------------------------------------------------------
# Own patterns and lists (no fixed counterpart).
# --------------------------------------------------------------------------

# An address in any script; the length of the local part is open. It starts at the
# first letter, mark or digit of a run of its characters (or of what the last match left
# of one), so a run is read once, possessively, and the search stays linear. Mostly no
# character of a run stands before it; only after a sign is it looked for further back.
_LOCAL_SIGNS = r".%+'!#$&*/=?^`{|}~-"
_LOCAL = rf"\p{{L}}\p{{M}}\p{{N}}_{_LOCAL_SIGNS}"
EMAIL_START = (
    rf"(?:(?<![{_LOCAL}])|"
    rf"(?<=[{_LOCAL_SIGNS}])(?<=(?:\G|(?<![{_LOCAL}])|[{_LOCAL_SIGNS}]{{64}})[{_LOCAL_SIGNS}]{{1,63}}))"
)
EMAIL = EMAIL_START + (
    rf"[\p{{L}}\p{{M}}\p{{N}}_][{_LOCAL}]*+"
    rf"@(?:[\p{{L}}\p{{M}}\p{{N}}-]{{1,63}}\.)+[\p{{L}}\p{{M}}]{{2,63}}\b"
)
EMAIL_CONTEXT = ("email",)

# International (+cc groups) and North-American shaped numbers.
PHONE_INTERNATIONAL = (
    r"(?:\+[1-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,4}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
    r"|\b\d{3}[ .-]\d{3}[ .-]\d{4})\b"
)

_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_MONTH = r"(?:0?[1-9]|1[0-2])"
_MONTH_NAME = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?"
    r"|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
)
DATE_ISO = rf"\b\d{{4}}[-/.]{_MONTH}[-/.]{_DAY}\b"
DATE_NUMERIC = rf"\b\d{{1,2}}[-/.]\d{{1,2}}[-/.](?:\d{{4}}|\d{{2}})\b"
DATE_MONTH_NAME = rf"\b{_DAY}(?:st|nd|rd|th)?[ -]{_MONTH_NAME}[ ,-]{{1,2}}(?:\d{{4}}|\d{{2}})\b"
DATE_MONTH_FIRST = rf"\b{_MONTH_NAME} {_DAY}(?:st|nd|rd|th)?,? \d{{4}}\b"
DATE_MONTH_YEAR = rf"\b{_MONTH_NAME},? \d{{4}}\b"
DATE_TIMESTAMP = (
    rf"\b\d{{4}}-{_MONTH}-{_DAY}[T ]\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?(?:Z|[+-]\d{{2}}:?\d{{2}})?\b"
)
DATE_CONTEXT = ("date", "birthday")

# Word tokens, equal in Java, Python (regex) and RE2.
WORD = r"[\p{L}\p{M}\p{N}_]+"

# English function words ignored when looking back for context words. No
# context word may appear here.
STOPWORDS = (
    "a", "about", "above", "after", "again", "all", "also", "am", "an", "and", "any", "are",
    "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but",
    "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no", "nor",
    "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "out", "over",
    "own", "s", "same", "she", "should", "so", "some", "such", "t", "than", "that", "the",
    "their", "theirs", "them", "then", "there", "these", "they", "this", "those", "through",
    "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where",
    "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours",
)


@dataclass(frozen=True)
class Detector:
    """One scored pattern.

    ``needs`` is a cheap regex that any match of ``pattern`` must contain; it is
    shared between detectors and tested once per cell, so most cells never meet
    the full pattern. ``needs_text`` is the same for a literal substring, ``needs_words``
    for lower-case ASCII words of which a match holds at least one, in any case.
    """

    name: str
    entity_type: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    ignore_case: bool = True
    needs: str | None = None
    needs_text: str | None = None
    needs_words: tuple[str, ...] = ()

    @property
    def java_pattern(self) -> str:
        """The pattern with flags that make Java agree with Unicode-aware matching."""
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern

    @property
    def boosted_score(self) -> float:
        return round(min(1.0, max(self.score + CONTEXT_BOOST, CONTEXT_MIN_SCORE)), 3)

    @property
    def context_words(self) -> tuple[str, ...]:
        """Context entries that can occur inside one word token; the rest never fire."""
        return tuple(w for w in self.context if not re.search(r"\s", w))

    @property
    def best_score(self) -> float:
        return self.boosted_score if self.context_words else self.score


DIGIT = r"\d"
_THREE_DIGITS = r"\d{3}"
_FOUR_DIGITS = r"\d{4}"
_NINO_END = r"\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d]"
_NINE_DIGITS = r"\d(?:[\s\-]?\d){8}"
_DIGIT_LETTERS = r"\d\p{L}{2}"
# Written out with the letters that fold to these, as plain classes scan fastest.
_TITLE_START = r"[Mm](?:[Rr][Ssſ]?|[Ssſ]|[Xx]|[Iiıİ][Ssſ]{2})\.?[ \t]"
_DATE_DIGITS = r"\d[-/.]\d{1,2}[-/.]\d"
_PHONE_DIGITS = r"\d{3}\)?[ .-]?\d{3}[ .-]\d{4}|\+[1-9]"
_TITLES = ("mr", "miss", "ms", "mx")
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

DETECTORS = (
    Detector("uk_postcode", "UK_POSTCODE", UK_POSTCODE, 0.92, POSTCODE_CONTEXT, needs=_DIGIT_LETTERS),
    Detector("nino_strict", "UK_NINO", UK_NINO_STRICT, 0.95, NINO_CONTEXT, needs=_NINO_END),
    Detector("nino_flexible", "UK_NINO", UK_NINO_FLEXIBLE, 0.78, NINO_CONTEXT, needs=_NINO_END),
    Detector("uk_mobile", "PHONE_NUMBER", UK_MOBILE, 0.94, PHONE_CONTEXT, needs=_NINE_DIGITS),
    Detector("uk_landline", "PHONE_NUMBER", UK_LANDLINE, 0.88, PHONE_CONTEXT, needs=_NINE_DIGITS),
    Detector("ref_bh", "HOUSING_REF", REF_BH, 0.70, HOUSING_CONTEXT, needs=_THREE_DIGITS, needs_words=("bh",)),
    Detector("ref_rep", "HOUSING_REF", REF_REP, 0.75, HOUSING_CONTEXT, needs=_THREE_DIGITS, needs_words=("rep",)),
    Detector("ref_tenancy", "HOUSING_REF", REF_TENANCY, 0.70, HOUSING_CONTEXT, needs=_FOUR_DIGITS, needs_words=("ten",)),
    Detector("ref_customer", "HOUSING_REF", REF_CUSTOMER, 0.65, HOUSING_CONTEXT, needs=_FOUR_DIGITS, needs_words=("cus",)),
    Detector("ref_job", "HOUSING_REF", REF_JOB, 0.55, HOUSING_CONTEXT, needs=_FOUR_DIGITS, needs_words=("job", "ref", "prop", "wo")),
    Detector("code_labelled", "ACCESS_CODE", CODE_LABELLED, 0.85, CODE_CONTEXT, needs=_FOUR_DIGITS, needs_words=("safe", "code", "combination")),
    Detector("code_bare", "ACCESS_CODE", CODE_BARE, 0.25, CODE_CONTEXT, needs=_FOUR_DIGITS),
    Detector("name_label", "PERSON", NAME_LABEL, 0.90, NAME_LABEL_CONTEXT, needs_words=("name: ",)),
    Detector("title_name", "PERSON", TITLE_NAME, 0.75, needs=_TITLE_START, needs_words=_TITLES),
    Detector("email", "EMAIL_ADDRESS", EMAIL, 1.0, EMAIL_CONTEXT, needs_text="@"),
    Detector("date_iso", "DATE_TIME", DATE_ISO, 0.6, DATE_CONTEXT, needs=_DATE_DIGITS),
    Detector("date_numeric", "DATE_TIME", DATE_NUMERIC, 0.6, DATE_CONTEXT, needs=_DATE_DIGITS),
    Detector("date_month_name", "DATE_TIME", DATE_MONTH_NAME, 0.6, DATE_CONTEXT, needs=DIGIT, needs_words=_MONTHS),
    Detector("date_month_first", "DATE_TIME", DATE_MONTH_FIRST, 0.6, DATE_CONTEXT, needs=DIGIT, needs_words=_MONTHS),
    Detector("date_month_year", "DATE_TIME", DATE_MONTH_YEAR, 0.6, DATE_CONTEXT, needs=DIGIT, needs_words=_MONTHS),
    Detector("date_timestamp", "DATE_TIME", DATE_TIMESTAMP, 0.6, DATE_CONTEXT, needs=_DATE_DIGITS),
    Detector("phone_international", "PHONE_NUMBER", PHONE_INTERNATIONAL, 0.4, PHONE_CONTEXT, needs=_PHONE_DIGITS),
)


@dataclass(frozen=True)
class ResidualPattern:
    """A leftover pattern for the scan of redacted text."""

    label: str
    pattern: str
    ignore_case: bool = True
    needs: str | None = None
    needs_text: str | None = None
    needs_words: tuple[str, ...] = ()

    @property
    def java_pattern(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern


RESIDUAL_PATTERNS = (
    ResidualPattern("POSSIBLE_UK_POSTCODE", UK_POSTCODE, needs=_DIGIT_LETTERS),
    ResidualPattern("POSSIBLE_UK_MOBILE", UK_MOBILE, needs=_NINE_DIGITS),
    ResidualPattern("POSSIBLE_UK_PHONE", UK_LANDLINE, needs=_NINE_DIGITS),
    ResidualPattern("POSSIBLE_NINO", UK_NINO_STRICT, needs=_NINO_END),
    ResidualPattern("LONG_DIGIT_SEQUENCE", LONG_DIGITS, needs=_FOUR_DIGITS),
    ResidualPattern(
        "POSSIBLE_PERSON_TITLE", TITLE_NAME, ignore_case=False, needs=_TITLE_START, needs_words=_TITLES
    ),
    ResidualPattern("POSSIBLE_NAME_LABEL", NAME_LABEL, ignore_case=False, needs_text="Name: "),
)


@dataclass(frozen=True)
class Catalogue:
    """An immutable set of detectors plus the lists that steer them."""

    detectors: tuple[Detector, ...] = DETECTORS
    residual_patterns: tuple[ResidualPattern, ...] = RESIDUAL_PATTERNS
    allow_list: tuple[str, ...] = ALLOW_LIST
    stopwords: tuple[str, ...] = STOPWORDS
    tags: tuple[tuple[str, str], ...] = tuple(ENTITY_TAGS.items())
    lemmas: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def with_lemmas(self, forms) -> "Catalogue":
        """Let word forms count as their lemmas in context; ``forms`` are pairs (form, lemma).

        Pairs whose lemma holds no context word can lift nothing and are left out.
        """
        words = self.all_context_words
        kept: dict[str, set[str]] = {}
        for form, lemma in forms:
            form, lemma = form.lower(), lemma.lower()
            if form != lemma and any(w in lemma for w in words):
                kept.setdefault(lemma, set()).add(form)
        return replace(self, lemmas=tuple((lemma, tuple(sorted(kept[lemma]))) for lemma in sorted(kept)))

    @property
    def all_context_words(self) -> tuple[str, ...]:
        return tuple(sorted({w for d in self.detectors for w in d.context_words}))

    def with_detector(
        self,
        name: str,
        entity_type: str,
        pattern: str,
        score: float,
        context: tuple[str, ...] = (),
        ignore_case: bool = True,
        tag: str | None = None,
    ) -> "Catalogue":
        """Register (or replace) a detector and return the new catalogue."""
        if not 0.0 <= score <= 1.0:
            raise ValueError(f"score must lie in [0, 1], not {score}")
        new = Detector(name, entity_type, pattern, score, tuple(context), ignore_case)
        kept = tuple(d for d in self.detectors if d.name != name)
        tags = dict(self.tags)
        if tag is not None:
            tags[entity_type] = tag
        return replace(self, detectors=kept + (new,), tags=tuple(tags.items()))

    def without_detector(self, name: str) -> "Catalogue":
        """Drop a detector by name."""
        return replace(self, detectors=tuple(d for d in self.detectors if d.name != name))

    def active(self, entity_types, threshold: float) -> tuple[Detector, ...]:
        """Detectors that can contribute a span: wanted type, and able to reach the threshold."""
        wanted = set(entity_types)
        return tuple(
            d for d in self.detectors if d.entity_type in wanted and d.best_score >= threshold
        )

    @property
    def tag_map(self) -> dict[str, str]:
        return dict(self.tags)


DEFAULT_CATALOGUE = Catalogue()


def types_for_labels(labels) -> list[str]:
    """Translate display labels into entity types, refusing unknown labels."""
    unknown = [label for label in labels if label not in ENTITY_OPTIONS]
    if unknown:
        raise ValueError(f"unknown entity options: {unknown}")
    return [ENTITY_OPTIONS[label] for label in labels]

"""Spark-native detection and redaction of personal data in free text."""

from quillmask.catalogue import (
    DEFAULT_CATALOGUE,
    DEFAULT_ENTITY_TYPES,
    ENTITY_OPTIONS,
    STYLE_ENTITY_TAGS,
    STYLE_GENERIC,
    Catalogue,
    Detector,
)
from quillmask.operators.anonymise import Anonymised, anonymise

__all__ = [
    "Anonymised",
    "Catalogue",
    "DEFAULT_CATALOGUE",
    "DEFAULT_ENTITY_TYPES",
    "Detector",
    "ENTITY_OPTIONS",
    "STYLE_ENTITY_TAGS",
    "STYLE_GENERIC",
    "anonymise",
]

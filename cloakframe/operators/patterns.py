"""Pattern packs: label -> Python pattern."""

from __future__ import annotations

# These patterns decide what is found, so they are given as they are.

GENERIC = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "URL": r"https?://[^\s<>\"']+",
    "IPV4": r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)",
    "CREDIT_CARD": r"\b(?:\d[ -]?){12,18}\d\b",
}

FRANCE = {
    "FR_PHONE": r"(?<!\d)(?:\+33|0)[1-9](?:[\s.-]?\d{2}){4}(?!\d)",
    "FR_IBAN": r"\bFR\d{2}(?:[\s-]?[A-Z0-9]){23}\b",
    "FR_NIR": r"\b[12][\s.-]?\d{2}[\s.-]?(?:0[1-9]|1[0-2])[\s.-]?(?:2A|2B|\d{2})[\s.-]?\d{3}[\s.-]?\d{3}[\s.-]?\d{2}\b",
    "FR_SIRET": r"\b\d{3}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{5}\b",
}

US = {
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "US_PHONE": r"\b(?:\+?1[\s.-]?)?\(?[2-9]\d{2}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "US_ZIP": r"\b\d{5}(?:-\d{4})?\b",
}

EUROPE = {
    "IBAN": r"\b[A-Z]{2}\d{2}(?:[\s-]?[A-Z0-9]){11,30}\b",
}

EXTRA_COMMON = {
    "EMAIL": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "IP_V4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "IP_V6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b",
    "URL": r"https?://[^\s<>\"']+[^\s<>\"'.,;:!?\)\]}]",
    "CREDIT_CARD": r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}\b",
    "PHONE_INTERNATIONAL": r"\+\d{1,3}[\s.\-]?\(?\d{1,4}\)?(?:[\s.\-]?\d{1,4}){1,4}",
    "OPENAI_API_KEY": r"sk-(?:proj-)?[A-Za-z0-9\-_]{20,}",
    "AWS_ACCESS_KEY": r"\bAKIA[0-9A-Z]{16}\b",
    "GITHUB_TOKEN": r"\bgh[ps]_[A-Za-z0-9_]{36,}\b",
    "STRIPE_KEY": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{24,}\b",
}

EXTRA_EUROPE = {
    "EU_IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}\b",
    "EU_VAT": r"\b[A-Z]{2}\d{8,12}\b",
    "FR_SSN": r"\b[12]\d{2}(?:0[1-9]|1[0-2])\d{2}\d{3}\d{3}\d{2}(?:\s?\d{2})?\b",
    "FR_PHONE": r"\b(?:\+33|0)[1-9](?:[\s.\-]?\d{2}){4}\b",
    "FR_ZIP": r"\b(?:0[1-9]|[1-8]\d|9[0-8])\d{3}\b",
    "DE_PHONE": r"\b(?:\+49|0)\d{2,5}[\s/\-]?\d{3,10}\b",
    "DE_ZIP": r"\b(?:0[1-9]|[1-9]\d)\d{3}\b",
    "UK_NINO": r"\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b",
    "UK_NHS": r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{4}\b",
    "UK_POSTCODE": r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b",
}

EXTRA_US = {
    "US_SSN": r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
    "US_PHONE": r"\b(?:\+1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b",
    "US_PASSPORT": r"\b[A-Z]\d{8}\b",
    "US_ZIP_CODE": r"\b\d{5}(?:-\d{4})?\b",
    "US_EIN": r"\b\d{2}-\d{7}\b",
    "US_BANK_ROUTING": r"\b\d{9}\b",
}

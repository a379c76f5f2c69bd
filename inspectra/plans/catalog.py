"""Identifiers and policy templates that come with the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Identifier:
    name: str
    patterns: tuple[str, ...]  # as RE2 has them
    validator: str | None = None
    confidence: float = 1.0
    needs: str = ""  # a short pattern that every text with a match holds


DIGIT = "[0-9]"

# Names, patterns, validators and confidences of the default identifiers.
IDENTIFIERS = (
    Identifier("Credit Card Number", (r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",), "luhn", 0.95, needs=DIGIT),
    Identifier("US SSN", (r"\b\d{3}-\d{2}-\d{4}\b",), "ssn_area", 0.9, needs=DIGIT),
    Identifier("US Phone Number", (r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",), "phone_format", 0.7, needs=DIGIT),
    Identifier("Email Address", (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}\b",), "email_domain", 0.85, needs="@"),
    Identifier("IBAN", (r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]){0,16}\b",), "iban_mod97", 0.9, needs=DIGIT),
    Identifier("IPv4 Address", (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",), "ipv4_range", 0.6, needs=DIGIT),
    Identifier("Date of Birth", (r"\b\d{2}/\d{2}/\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{2}-\d{2}-\d{4}\b"), "date_calendar", 0.5, needs=DIGIT),
    Identifier("ABA Routing Number", (r"\b\d{9}\b",), "aba_checksum", 0.8, needs=DIGIT),
)
MORE_IDENTIFIERS = (
    Identifier("US Passport", (r"\b[A-Z]?\d{8,9}\b",), "passport_format", needs=DIGIT),
    Identifier("US Driver's License", (r"\b[A-Z]\d{7}\b", r"\b[A-Z]\d{12}\b", r"\b\d{9}\b", r"\b[A-Z]{2}\d{6}\b"), "drivers_license_format", needs=DIGIT),
)
BY_NAME = {i.name: i for i in IDENTIFIERS + MORE_IDENTIFIERS}

# Words, patterns and types of the policy templates.
MEDICAL = ("patient", "diagnosis", "medical", "health", "treatment", "prescription", "hospital", "physician", "insurance")
PERSONAL = ("name", "address", "passport", "nationality", "citizen", "resident")
FINANCE = (
    "confidential financial", "earnings report", "quarterly results", "revenue forecast", "merger", "acquisition", "insider",
    "material non-public", "10-K", "10-Q", "SEC filing", "audit report", "balance sheet", "income statement",
)
SECRET_PATTERNS = (
    r"(?:api[_-]?key|apikey|secret[_-]?key|access[_-]?token|auth[_-]?token)\s*[:=]\s*['\"][A-Za-z0-9+/=_-]{20,}['\"]",
    r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----",
    r"(?:password|passwd|pwd)\s*[:=]\s*['\"][^'\"]{8,}['\"]",
)
SOURCE_TYPES = (".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".cs", ".go", ".rs", ".rb", ".php")
MARKERS = ("CONFIDENTIAL", "RESTRICTED", "TOP SECRET", "INTERNAL ONLY", "DO NOT DISTRIBUTE", "PROPRIETARY", "TRADE SECRET", "NOT FOR PUBLIC RELEASE")


def _identifier(name: str, least: int = 1) -> dict:
    return {"condition_type": "data_identifier", "component": "generic", "config": {"identifier_name": name, "min_matches": least}}


def _keywords(words: tuple[str, ...], least: int = 1, case_sensitive: bool = False) -> dict:
    return {"condition_type": "keyword", "component": "generic", "config": {"keywords": list(words), "case_sensitive": case_sensitive, "min_matches": least}}


#: Stored form of policies: rules are alternatives, a rule's conditions hold together.
TEMPLATES: dict[str, dict] = {
    "pci_dss": {"severity": "high", "rules": [{"name": "Card numbers", "conditions": [_identifier("Credit Card Number")]}]},
    "hipaa": {"severity": "high", "rules": [{"name": "SSN in medical context", "conditions": [_identifier("US SSN"), _keywords(MEDICAL)]}]},
    "gdpr": {
        "severity": "high",
        "rules": [{"name": "IBAN", "conditions": [_identifier("IBAN")]}, {"name": "Date of birth in personal context", "conditions": [_identifier("Date of Birth"), _keywords(PERSONAL)]}],
    },
    "sox": {"severity": "medium", "rules": [{"name": "Financial terms", "conditions": [_keywords(FINANCE, 2)]}]},
    "source_code": {
        "severity": "medium",
        "rules": [
            {"name": "Keys and secrets", "conditions": [{"condition_type": "regex", "component": "generic", "config": {"patterns": list(SECRET_PATTERNS)}}]},
            {"name": "Source files", "conditions": [{"condition_type": "file_type", "component": "attachment", "config": {"types": list(SOURCE_TYPES)}}]},
        ],
    },
    "confidential": {"severity": "critical", "rules": [{"name": "Markers", "conditions": [_keywords(MARKERS, 1, True)]}]},
}

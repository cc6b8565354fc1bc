"""Default dictionaries and scores. All are parameters of the operators that use them."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

#: Null markers of real exports, compared folded and without surrounding blanks and dots.
NULL_MARKERS = ("", "-", "--", "—", "–", "n/a", "n.a", "na", "none", "null", "nil", "tbd", "unknown", "?")

#: Trust of each kind of source.
SOURCE_TRUST = {"ats_json": 0.90, "recruiter_csv": 0.85, "linkedin_json": 0.80, "github_json": 0.75, "resume": 0.70, "notes_txt": 0.50, "derived": 1.00}
#: Reliability of each family of methods, the part of a method before the colon.
METHOD_RELIABILITY = {"direct_field": 1.00, "regex": 0.90, "phones_pass2": 0.90, "dict": 0.85, "derived": 0.60}
#: Weight of each field in the overall confidence.
FIELD_WEIGHTS = {
    "full_name": 3, "emails": 3, "phones": 2, "skills": 2, "experience": 2, "location": 1, "headline": 1, "years_experience": 1, "education": 1, "links": 1,
}
#: Kinds of sources that may speak of several people at once.
UNSTRUCTURED = ("notes_txt", "resume")
#: Version of the values above and below, kept in run reports.
VERSION = "2026.08.1"

#: Aliases that are everyday words and count only in a skills field, not in prose.
SCAN_EXCLUDED = ("go", "rest", "spring", "express", "swift", "js")
#: Aliases of two letters that are safe in free text.
SAFE_SHORT = ("us", "uk")

#: Skill aliases and their names.
SKILL_ALIASES = {
    "javascript": "javascript", "js": "javascript", "js es6": "javascript", "ecmascript": "javascript", "es6": "javascript", "typescript": "typescript",
    "ts": "typescript", "python": "python", "py": "python", "java": "java", "c++": "c++", "cpp": "c++", "c#": "c#", "csharp": "c#", "go": "go", "golang":
    "go", "rust": "rust", "ruby": "ruby", "rails": "rails", "ruby on rails": "rails", "php": "php", "sql": "sql", "postgresql": "postgresql", "postgres":
    "postgresql", "mysql": "mysql", "sqlite": "sqlite", "mongodb": "mongodb", "mongo": "mongodb", "redis": "redis", "react": "react", "reactjs": "react",
    "react.js": "react", "angular": "angular", "angularjs": "angular", "vue": "vue", "vuejs": "vue", "vue.js": "vue", "node.js": "node.js", "node":
    "node.js", "nodejs": "node.js", "express": "express", "django": "django", "flask": "flask", "fastapi": "fastapi", "spring": "spring", "spring boot":
    "spring", "aws": "aws", "amazon web services": "aws", "gcp": "gcp", "google cloud": "gcp", "google cloud platform": "gcp", "azure": "azure", "docker":
    "docker", "kubernetes": "kubernetes", "k8s": "kubernetes", "terraform": "terraform", "git": "git", "jenkins": "jenkins", "ci/cd": "ci/cd", "cicd":
    "ci/cd", "github actions": "ci/cd", "machine learning": "machine learning", "ml": "machine learning", "deep learning": "deep learning", "nlp": "nlp",
    "natural language processing": "nlp", "pytorch": "pytorch", "torch": "pytorch", "tensorflow": "tensorflow", "pandas": "pandas", "numpy": "numpy",
    "scikit-learn": "scikit-learn", "scikit learn": "scikit-learn", "sklearn": "scikit-learn", "spark": "spark", "apache spark": "spark", "hadoop":
    "hadoop", "kafka": "kafka", "apache kafka": "kafka", "graphql": "graphql", "rest": "rest", "rest apis": "rest", "restful apis": "rest", "html":
    "html", "css": "css", "sass": "sass", "linux": "linux", "bash": "bash", "shell scripting": "bash", "airflow": "airflow", "snowflake": "snowflake",
    "etl": "etl", ".net": ".net", "dotnet": ".net", "swift": "swift", "kotlin": "kotlin", "objective c": "objective-c",
}

#: Country aliases and their ISO 3166 codes.
COUNTRY_ALIASES = {
    "us": "US", "u.s": "US", "u.s.": "US", "usa": "US", "u.s.a": "US", "united states": "US", "united states of america": "US", "america": "US", "in":
    "IN", "india": "IN", "bharat": "IN", "gb": "GB", "uk": "GB", "u.k": "GB", "united kingdom": "GB", "great britain": "GB", "england": "GB", "ca": "CA",
    "canada": "CA", "de": "DE", "germany": "DE", "deutschland": "DE", "fr": "FR", "france": "FR", "nl": "NL", "netherlands": "NL", "holland": "NL", "sg":
    "SG", "singapore": "SG", "au": "AU", "australia": "AU", "jp": "JP", "japan": "JP", "cn": "CN", "china": "CN", "br": "BR", "brazil": "BR", "es": "ES",
    "spain": "ES", "it": "IT", "italy": "IT", "ie": "IE", "ireland": "IE", "ch": "CH", "switzerland": "CH", "se": "SE", "sweden": "SE", "pl": "PL",
    "poland": "PL", "il": "IL", "israel": "IL", "ae": "AE", "uae": "AE", "united arab emirates": "AE", "mx": "MX", "mexico": "MX", "kr": "KR", "korea":
    "KR", "south korea": "KR",
}


def checksum(table: dict) -> str:
    """sha256 of a dictionary, whatever the order of its entries."""
    return hashlib.sha256(json.dumps(table, sort_keys=True, ensure_ascii=False).encode("utf-8")).hexdigest()


def load_aliases(path: str | Path, expected: str | None = None) -> dict[str, str]:
    """Aliases from a JSON file, plain or under "aliases". expected: their checksum; other contents raise ValueError."""
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    aliases = doc.get("aliases", doc)
    if not all(isinstance(v, str) for v in aliases.values()):
        raise ValueError(f"{path}: aliases must be texts")
    if expected is not None and checksum(aliases) != expected:
        raise ValueError(f"{path}: contents have changed, checksum {checksum(aliases)}")
    return aliases

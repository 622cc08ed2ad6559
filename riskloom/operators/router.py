"""Rules that send a question to a case file, the catalogue, document search or a customer view; the rule is named in the answer."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.questions import Matcher


@dataclass(frozen=True)
class Route:
    kind: str
    target: str | None
    rule: str
    suggestions: tuple[str, ...] = ()


def name_spans(text: str) -> list[str]:
    """Runs of two to four words, upper case."""
    words = re.findall(r"[A-Za-z'-]+", text)
    return [" ".join(words[i : i + n]).upper() for n in (4, 3, 2) for i in range(len(words) - n + 1)]


def find_customers(party: DataFrame, text: str) -> list[dict]:
    """Parties whose display name is a span of the text; an equality filter, so it reaches the scan."""
    spans = name_spans(text)
    if not spans:
        return []
    hit = party.where(F.col("display_name").isin(spans)).orderBy(F.desc("cores"), "party_id").limit(20)
    return [r.asDict() for r in hit.collect()]


def route(text: str, party: DataFrame, matcher: Matcher) -> Route:
    low = text.lower()
    if re.search(r"\b(narrative|case file|write[- ]?up|draft)\b", low):
        who = find_customers(party, text)
        return Route("NARRATIVE", who[0]["party_id"] if who else None, "asks for a narrative")
    found, best = matcher.match(text)
    if found and re.search(r"\b(how many|how much|which|what|who|rate|list|top|total|count)\b", low):
        return Route("CATALOG", found, "data words and a clear question", tuple(best))
    for kind, words in (("KYC", r"\b(kyc|occupation|source of funds)\b"), ("NOTE", r"\b(note|investigator|wrote)\b"), ("POLICY", r"\b(policy|procedure|rule|section|must we)\b")):
        if re.search(words, low):
            return Route("SEARCH", kind, f"words of {kind.lower()} documents")
    if who := find_customers(party, text):
        return Route("CUSTOMER", who[0]["party_id"], "names a customer")
    if found:
        return Route("CATALOG", found, "a clear question", tuple(best))
    return Route("CLARIFY", None, "nothing clear", tuple(best))

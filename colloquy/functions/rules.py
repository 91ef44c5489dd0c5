"""Ordered keyword rules compiled to one column expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import UNICODE

# Patterns looked for, label by label; the first label that matches wins.
INTENT_PATTERNS: dict[str, tuple[str, ...]] = {
    "account_access": (
        r"\bsign[- ]?in\b", r"\blogin\b", r"\blog[- ]?in\b", r"\bpassword\b",
        r"\bgamertag\b", r"\bemail\b.*\baccount\b", r"\baccount\b.*\bemail\b",
        r"\bcannot\s+access\b", r"\blocked\s+out\b", r"\bcan'?t\s+sign\b",
    ),
    "billing_subscription": (
        r"\brefund\b", r"\bcharge[sd]?\b", r"\bgift\s+card\b", r"\bcode\b.*\bcard\b",
        r"\bxbox\s+live\s+gold\b", r"\bgold\s+membership\b", r"\bspending\s+limit\b",
        r"\bpurchase\b", r"\bbill(ing)?\b", r"\bpayment\b", r"\bsubscri",
        r"\b\$\d+\b", r"\bprice\b", r"\bcost\b", r"\bcredit\s+card\b",
    ),
    "hardware_device": (
        r"\bcontroller\b", r"\bconsole\b", r"\bwon'?t\s+turn\s+on\b",
        r"\bhdmi\b", r"\bdisplay\b", r"\belite\s+controller\b",
        r"\bpower\s+(supply|brick|cord)\b", r"\brusset\s+ring\b",
        r"\bbroken\b", r"\bhardware\b", r"\bdisconnects?\b.*\bcontroller\b",
        r"\bcontroller\b.*\bdisconnects?\b", r"\boverheating\b",
    ),
    "network_connectivity": (
        r"\bxbox\s+live\b", r"\bconnect(ion|ivity|ing)?\b", r"\bnat\b",
        r"\bserver[s]?\b", r"\berror\s+code\b", r"\boffline\b",
        r"\binternet\b", r"\bwifi\b", r"\bwi-fi\b", r"\bping\b",
        r"\blatency\b", r"\bnetwork\b", r"\boutage\b", r"\bdown\b.*\bserver\b",
    ),
    "game_content": (
        r"\bgame\b", r"\bachievement[s]?\b", r"\bclip[s]?\b",
        r"\bbackwards?\s+compat", r"\bdlc\b", r"\bdownload(ing)?\b",
        r"\binstall(ing)?\b", r"\bgame\s+pass\b", r"\bplay(ing)?\b.*\bgame\b",
        r"\bgame\b.*\bupdate\b", r"\bpatch\b", r"\bsave\b.*\bgame\b",
    ),
    "app_feature": (
        r"\bapp\b", r"\bnetflix\b", r"\bhulu\b", r"\bpandora\b",
        r"\byoutube\b", r"\bmixer\b", r"\bbroadcast\b", r"\bstream(ing)?\b",
        r"\bfeature\s+request\b", r"\bfeedback\b", r"\bsuggestion\b",
        r"\bui\b", r"\binterface\b", r"\bupdate\s+app\b",
    ),
    "enforcement_ban": (
        r"\bban(ned)?\b", r"\bsuspend(ed)?\b", r"\benforcement\b",
        r"\bappeal\b", r"\breport(ed)?\b.*\bme\b", r"\bunfair\b",
        r"\bfraud(ulent)?\b", r"\bstolen\b.*\baccount\b", r"\bhack(ed)?\b",
    ),
}

# A reply that matches one of these sent the customer to another channel.
HANDOFF_PATTERNS: tuple[str, ...] = (
    r"dm\b", r"direct\s+message", r"private\s+message",
    r"chat\s+(team|support|us)", r"contact\s+us",
    r"gamertag", r"support\.xbox\.com", r"xbox\.com/support",
    r"phone\s+support", r"call\s+us",
)

# Words in a customer message that call for a human, any case.
ESCALATION_WORDS: tuple[str, ...] = (
    r"ban(ned)?", r"suspend(ed)?", r"fraud", r"stolen", r"hack(ed)?", r"refund",
    r"charge[sd]?", r"hardware", r"warranty", r"broken", r"won'?t\s+turn\s+on", r"damaged",
)
ESCALATED_REASON = "Keyword rule triggered escalation."
NOT_ESCALATED_REASON = "No escalation keywords found."


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """True when a lower-cased text holds any of the patterns; null text counts as empty."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(UNICODE + any_of(patterns))


def first_match(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The first label one of whose patterns is found in the lower-cased text, else null."""
    hits = [F.when(matches_any(text, patterns), F.lit(label))
            for label, patterns in rules.items() if patterns]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def handed_off(reply: Column, patterns: Sequence[str] = HANDOFF_PATTERNS) -> Column:
    return matches_any(reply, patterns)


def escalation_by_keyword(
    text: Column, words: Sequence[str] = ESCALATION_WORDS
) -> tuple[Column, Column]:
    """``(decision, reason)`` columns from the words in a customer message."""
    found = F.coalesce(text, F.lit("")).rlike(f"(?iUd)\\b(?:{'|'.join(words)})\\b")
    return (
        F.when(found, "escalate").otherwise("auto"),
        F.when(found, ESCALATED_REASON).otherwise(NOT_ESCALATED_REASON),
    )


def labelled(column: Column) -> Column:
    """True for a label that is neither null nor blank."""
    return F.coalesce(F.trim(column) != "", F.lit(False))

"""Who, what, which version: signals read from a headline and its summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from nichelens.functions.normalize import blank_to_null

# Vendors by keyword, in matching order.
VENDOR_KEYWORDS = {
    "openai": ("openai", "chatgpt", "gpt-4", "gpt-5", "sora", "dall-e", "codex"),
    "anthropic": ("anthropic", "claude"),
    "google": ("google", "gemini", "deepmind", "workspace", "notebooklm"),
    "microsoft": ("microsoft", "copilot", "azure", "office 365", "microsoft 365"),
    "github": ("github",),
    "cursor": ("cursor",),
    "notion": ("notion",),
    "zapier": ("zapier",),
    "ollama": ("ollama",),
    "huggingface": ("hugging face", "huggingface"),
    "n8n": ("n8n",),
    "meta": ("meta ai", "llama"),
    "mistral": ("mistral",),
    "perplexity": ("perplexity",),
    "figma": ("figma",),
    "canva": ("canva",),
}
# Event kinds by keyword, in matching order.
EVENT_KEYWORDS = {
    "RELEASE": ("release", "released", "launch", "launches", "introducing",
                "релиз", "запуск", "представил", "выпустил"),
    "UPDATE": ("update", "updates", "changelog", "improvement", "now available",
               "обновление", "обновил"),
    "NEW_TOOL": ("new tool", "open source", "open-source", "инструмент"),
    "RESEARCH": ("research", "paper", "benchmark", "исследование"),
    "GUIDE": ("how to", "guide", "tutorial", "tips", "гайд", "инструкция", "как "),
    "INCIDENT": ("outage", "incident", "vulnerability", "breach", "сбой", "уязвимость"),
}
# After a vendor's name, these lead nowhere; a product name begins with another word.
PRODUCT_STOPWORDS = (
    "and", "the", "for", "with", "now", "new", "can", "you", "your", "our", "its", "все", "уже",
)
DISTINCT_EVENTS = ("GUIDE", "RESEARCH", "INCIDENT")
VERSION = r"(?U)\bv?(\d+(?:\.\d+){1,3})\b"


@dataclass(frozen=True)
class EntityRules:
    """Keyword tables; replace them to follow other vendors or another language."""

    vendors: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(VENDOR_KEYWORDS))
    events: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(EVENT_KEYWORDS))


def _mentions(text: Column, keywords: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for keyword in keywords:
        found = found | F.contains(text, F.lit(keyword))
    return found


def _first_group(text: Column, groups: dict[str, tuple[str, ...]], default: str | None) -> Column:
    choice = F
    for name, keywords in groups.items():
        choice = choice.when(_mentions(text, keywords), F.lit(name))
    return choice.otherwise(F.lit(default).cast("string"))


def detect_vendor(normalized: Column, rules: EntityRules) -> Column:
    """First vendor, in rule order, with a keyword inside the normalized text."""
    return _first_group(normalized, rules.vendors, None)


def detect_event_type(normalized: Column, rules: EntityRules) -> Column:
    return _first_group(normalized, rules.events, "OTHER")


def detect_version(raw: Column) -> Column:
    """First version-looking token of the raw text."""
    return blank_to_null(F.regexp_extract(raw, VERSION, 1))


def detect_product(
    normalized_title: Column, vendor: Column, rules: EntityRules, max_length: int | None = None
) -> Column:
    """First usable word after a keyword of the vendor, keywords in rule order; whole unless
    ``max_length`` is given."""

    def after(keyword: str) -> Column:
        at = F.instr(normalized_title, keyword)
        tail = F.when(
            at > 0, F.substring(normalized_title, at + len(keyword), F.length(normalized_title))
        )
        words = F.filter(
            F.split(tail, "[^0-9a-zа-яё.]+"),
            lambda w: (F.length(w) >= 3) & ~w.isin(*PRODUCT_STOPWORDS),
        )
        word = F.try_element_at(words, F.lit(1))
        return word if max_length is None else F.substring(word, 1, max_length)

    product = F.lit(None).cast("string")
    for name, keywords in reversed(rules.vendors.items()):
        guess = F.coalesce(*[after(keyword) for keyword in keywords])
        product = F.when(vendor == name, guess).otherwise(product)
    return product


def resolve_version(version_hint: Column, raw_title: Column) -> Column:
    """A stated version beats one read from the title."""
    hint = blank_to_null(version_hint)
    return F.coalesce(detect_version(hint), hint, detect_version(raw_title))


def year_week(ts: Column) -> Column:
    """``%Y-%W``: weeks start on the first Monday (not the ISO week)."""
    week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / F.lit(7))
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def entity_key(
    vendor: Column, explicit_product: Column, version: Column, event_type: Column, event_at: Column
) -> Column:
    """Key of "same thing, same week"; NULL when the item is too vague to have one."""
    kind = F.when(event_type.isin(*DISTINCT_EVENTS), F.lower(event_type)).otherwise(
        F.lit("announcement")
    )
    product = blank_to_null(explicit_product)
    stated = F.coalesce(version, product).isNotNull() & vendor.isNotNull()
    parts = [
        vendor,
        F.coalesce(product, F.lit("-")),
        F.coalesce(version, F.lit("-")),
        kind,
        year_week(event_at),
    ]
    return F.when(stated, F.lower(F.concat_ws(":", *parts)))


def fallback_key(url_hash: Column) -> Column:
    return F.concat(F.lit("item:"), F.substring(url_hash, 1, 32))


def contradicts(
    version_a: Column, version_b: Column, vendor_a: Column, vendor_b: Column
) -> Column:
    """Both sides name a version (or a vendor) and the names differ."""
    return F.coalesce(version_a != version_b, F.lit(False)) | F.coalesce(
        vendor_a != vendor_b, F.lit(False)
    )

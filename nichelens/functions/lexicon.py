"""Term-weight scoring of headlines: relevance and practical value without a model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from nichelens.functions.normalize import let

# Relevance terms and their weights.
RELEVANCE_POSITIVE = {
    "chatgpt": 14, "claude": 14, "gemini": 14, "copilot": 14, "perplexity": 10,
    "midjourney": 10, "нейросет": 12, "промпт": 14, "prompt": 10, "llm": 8,
    "ai agent": 10, "ai-агент": 10,
    "workflow": 12, "автоматизац": 14, "automation": 12, "интеграц": 8, "integration": 6,
    "shortcut": 10, "горячие клавиши": 12, "расширени": 6, "extension": 6, "плагин": 8,
    "надстройк": 8, "скрипт": 6,
    "excel": 14, "spreadsheet": 12, "таблиц": 8, "powerpoint": 12, "презентац": 10,
    "notion": 10, "obsidian": 8, "заметк": 6, "календар": 6, "документ": 5, "перевод": 5,
    "how to": 18, "how-to": 18, "как": 10, "guide": 10, "гайд": 12, "tutorial": 12,
    "инструкци": 12, "разбор": 10, "tips": 10, "советы": 10, "шпаргалк": 12,
    "чек-лист": 10, "checklist": 10, "пошагов": 12, "step-by-step": 12, "шаблон": 10,
    "template": 8,
}
RELEVANCE_NEGATIVE = {
    "раунд финансирован": 30, "инвестиц": 22, "funding": 25, "valuation": 25, "ipo": 25,
    "acquisition": 22, "приобрет": 12, "партнерств": 20, "partnership": 20, "earnings": 25,
    "выручк": 22, "revenue": 18, "share price": 25, "назначен": 15, "appoints": 20,
    "steps down": 20, "resigns": 20, "увольн": 18, "layoffs": 22, "lawsuit": 22,
    "иск против": 22, "антимонопол": 20, "regulation": 12, "регулятор": 12, "hiring": 15,
    "ваканси": 18,
}
# Practical patterns and bonuses.
PRACTICAL_PATTERNS = {
    "how to": 30, "how-to": 30, "как": 22, "guide": 20, "гайд": 24, "tutorial": 26,
    "инструкци": 24, "пошагов": 26, "step-by-step": 26, "tips": 20, "советы": 20,
    "шпаргалк": 26, "чек-лист": 22, "checklist": 22, "разбор": 18, "шаблон": 22,
    "template": 18, "промпт": 24, "workflow": 20, "автоматизац": 22, "shortcut": 22,
    "настро": 12, "setup": 12,
}
EVENT_BONUS = {
    "RELEASE": 12, "UPDATE": 10, "NEW_TOOL": 16, "GUIDE": 25, "RESEARCH": 0, "INCIDENT": 0,
    "OTHER": 0,
}


@dataclass(frozen=True)
class Lexicon:
    """Weighted terms. Terms are matched as substrings of normalised text."""

    positive: dict[str, float] = field(default_factory=lambda: dict(RELEVANCE_POSITIVE))
    negative: dict[str, float] = field(default_factory=lambda: dict(RELEVANCE_NEGATIVE))
    patterns: dict[str, float] = field(default_factory=lambda: dict(PRACTICAL_PATTERNS))
    event_bonus: dict[str, float] = field(default_factory=lambda: dict(EVENT_BONUS))
    relevance_base: float = 40.0
    max_positive: float = 60.0
    max_negative: float = 55.0
    practical_base: float = 35.0
    max_bonus: float = 65.0
    version_bonus: float = 8.0


def matched_terms(normalized: Column, terms: dict[str, float]) -> Column:
    """``array<struct<term, weight>>`` of the terms present, each once, in term order."""
    table = F.array(
        *[F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("weight")) for t, w in terms.items()]
    )
    return F.filter(table, lambda x: F.contains(normalized, x["term"]))


def total_weight(matched: Column) -> Column:
    return F.aggregate(matched, F.lit(0.0), lambda acc, x: acc + x["weight"])


def _clamp(value: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), 2)


def _sum_and_terms(matched: Column) -> Column:
    return F.struct(
        total_weight(matched).alias("total"), F.transform(matched, lambda x: x["term"]).alias("terms")
    )


def _scan(normalized: Column, terms: dict[str, float]) -> Column:
    """``struct(total, terms)``: the text is searched once."""
    return let(matched_terms(normalized, terms), _sum_and_terms)


def relevance(normalized: Column, lexicon: Lexicon) -> Column:
    """``struct(value, matched, penalised)``."""

    def judged(found: Column) -> Column:
        value = (
            F.lit(lexicon.relevance_base)
            + F.least(found["plus"]["total"], F.lit(lexicon.max_positive))
            - F.least(found["minus"]["total"], F.lit(lexicon.max_negative))
        )
        return F.struct(
            _clamp(value).alias("value"),
            found["plus"]["terms"].alias("matched"),
            found["minus"]["terms"].alias("penalised"),
        )

    plus, minus = _scan(normalized, lexicon.positive), _scan(normalized, lexicon.negative)
    return let(F.struct(plus.alias("plus"), minus.alias("minus")), judged)


def practical_value(
    normalized_title: Column,
    normalized_summary: Column,
    event_type: Column,
    has_version: Column,
    lexicon: Lexicon,
) -> Column:
    """``struct(value, matched)``: the title counts in full, the body at half weight."""
    bonus = F.lit(0.0)
    for event, points in lexicon.event_bonus.items():
        bonus = F.when(event_type == event, F.lit(float(points))).otherwise(bonus)
    extra = bonus + F.when(has_version, F.lit(lexicon.version_bonus)).otherwise(F.lit(0.0))

    def judged(found: Column) -> Column:
        total = found["title"]["total"] + found["body"]["total"] * 0.5 + extra
        value = F.lit(lexicon.practical_base) + F.least(total, F.lit(lexicon.max_bonus))
        return F.struct(
            _clamp(value).alias("value"),
            F.array_union(found["title"]["terms"], found["body"]["terms"]).alias("matched"),
        )

    title = _scan(normalized_title, lexicon.patterns)
    body = _scan(normalized_summary, lexicon.patterns)
    return let(F.struct(title.alias("title"), body.alias("body")), judged)

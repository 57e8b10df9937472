"""Dictionary-driven term, phrase and class extraction from source wording."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions.text import _col

# Material names, the wording that proves each, in order of specificity.
MATERIALS: tuple[tuple[str, str], ...] = (
    ("18 ct yellow gold", r"18\s*ct\s*yellow gold"), ("Yellow gold", r"yellow gold"), ("Rose gold", r"rose[- ]gold"),
    ("Grade 2 titanium", r"grade 2 titanium"), ("Titanium", r"titanium"), ("925 silver", r"925 silver"),
    ("Bronze", r"bronze"), ("Ceramic", r"ceramic"), ("Carbon composite", r"carbon composite"),
    ("Carbon fibre", r"carbon fibre"), ("Stainless steel", r"(?:stainless )?steel"), ("Aluminium", r"alumini?um"),
    ("Alligator leather", r"alligator"), ("Leather", r"leather"), ("Rubber", r"rubber"), ("Fabric", r"fabric"),
)
# General name -> more specific name that hides it.
MATERIAL_SUPPRESSION = {"Yellow gold": "18 ct yellow gold", "Titanium": "Grade 2 titanium",
                        "Leather": "Alligator leather"}
# Colour words of a strap clause and the metal words that void the clause.
STRAP_COLOURS = ("black", "white", "blue", "green", "red", "brown", "grey", "gray", "taupe", "beige", "purple",
                 "pink", "orange", "yellow")
METALS = ("gold", "steel", "platinum")
# Catalog segments in priority order, first matching wording wins.
SEGMENTS: tuple[tuple[str, str], ...] = (
    ("Complications", r"tourbillon|perpetual|minute repeat|repetition|moon ?phase|phase de lune|retrograde"),
    ("Chronograph", r"\bchrono(?:graph)?\b"),
    ("Diving", r"\bdiv(?:er|ing)\b|aquatimer|pelagos"),
    ("Travel", r"\bgmt\b|world ?time|dual time|second time zone"),
    ("Jewellery", r"jewell?ery|diamond"),
)
DEFAULT_SEGMENT = "Time & date"
# Function phrases recognised in a product description, longest alternatives first.
FUNCTION_PHRASES = (
    r"retrograde (?:seconds?|minutes?|hours?|date)", r"(?:perpetual|annual) calendar",
    r"moon[- ]phase(?: (?:display|indicator))?", r"power reserve (?:display|indicator)", r"second time zone",
    r"dual time", r"world time", r"alarm", r"minute repeat(?:er|ing)", r"grand strike", r"petite sonnerie",
    r"grande sonnerie", r"equation of time", r"chronograph", r"tourbillon",
    r"small seconds(?: on the tourbillon shaft)?", r"centre (?:hour|minute|seconds?) hand", r"date",
)


def whole_words(pattern: str) -> str:
    """Case-insensitive pattern bounded by non-letters in any script, whatever the Java version makes of \\b."""
    return rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"


def term_extract(text: Column | str, terms: Sequence[tuple[str, str]] = MATERIALS,
                 suppression: Mapping[str, str] = MATERIAL_SUPPRESSION) -> Column:
    """Array of the term names found, in table order; a general term is hidden by its specific form."""
    text = _col(text)
    hit = {name: text.rlike(f"(?i){pattern}") for name, pattern in terms}
    picked = []
    for name, _ in terms:
        specific = suppression.get(name)
        found = hit[name] if specific not in hit else hit[name] & ~hit[specific]
        picked.append(F.when(found, F.lit(name)))
    return F.array_compact(F.array(*picked))


def clause_colours(text: Column | str, colours: Sequence[str] = STRAP_COLOURS,
                   metals: Sequence[str] = METALS) -> Column:
    """Comma clauses after the first that name a colour and no metal ("white gold" is no colour)."""
    clauses = F.split(_col(text), ",")
    rest = F.when(F.size(clauses) > 1, F.slice(clauses, 2, F.size(clauses))).otherwise(F.array().cast("array<string>"))
    colour, metal = whole_words("|".join(colours)), whole_words("|".join(metals))
    return F.transform(F.filter(rest, lambda c: c.rlike(colour) & ~c.rlike(metal)), lambda c: F.trim(c))


def phrase_extract(text: Column | str, phrases: Sequence[str] = FUNCTION_PHRASES) -> Column:
    """Distinct phrases in text order; earlier alternatives win at the same position."""
    pattern = whole_words("|".join(phrases))
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)))


def classify_segment(text: Column | str, segments: Sequence[tuple[str, str]] = SEGMENTS,
                     default: str = DEFAULT_SEGMENT) -> Column:
    """First segment whose wording occurs in ``text``."""
    text = _col(text)
    result = F.lit(default)
    for name, pattern in reversed(segments):
        result = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(result)
    return result


def stated_terms(text: Column | str, terms: Sequence[tuple[str, str]]) -> Column:
    """Terms affirmed by the text: clauses such as 'No date', 'without flyback' or 'date: none' affirm nothing."""
    clauses = F.split(_col(text), r"[;,.]")
    tails = F.transform(clauses, lambda c: F.regexp_replace(c, r"(?i)\b(?:without|no|not)\b.*$", ""))
    affirmed = F.filter(tails, lambda c: ~c.rlike(r"(?i):\s*(?:none|no|n/a)\s*$"))
    def stated(pattern: str) -> Column:
        return F.exists(affirmed, lambda c: c.rlike(f"(?i){pattern}"))

    return F.array_compact(F.array(*[F.when(stated(pattern), F.lit(name)) for name, pattern in terms]))

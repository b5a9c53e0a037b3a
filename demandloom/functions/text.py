"""Text, key and label expressions. Everything here is a pure Column -> Column function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DATE_HINTS, MONTH_NUMBERS, NUMERIC_HINTS, AnchorPolicy


def blank(c) -> Column:
    """Text with nulls shown as '' and outer spaces removed."""
    return F.trim(F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit("")))


def normalize_name(c) -> Column:
    """Upper-case, single-spaced name; null becomes ''."""
    return F.upper(F.regexp_replace(blank(c), r"\s+", " "))


def entity_key(model, brand) -> Column:
    m, b = normalize_name(model), normalize_name(brand)
    return F.when(m != "", F.concat_ws("::", F.when(b == "", F.lit("UNKNOWN")).otherwise(b), m)).otherwise("")


def anchor_label(label, model, source, policy: AnchorPolicy = AnchorPolicy()) -> Column:
    """Governed anchor of a brand label; '' when no rule applies."""
    lab, mod, src = normalize_name(label), normalize_name(model), normalize_name(source)
    out = F.when(src.isin(*policy.anchors), src)
    for anchor, words, letter in policy.keyword_rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(lab, F.lit(w))
        if letter:
            hit = hit | (lab == letter) | (src == letter)
        out = out.when(hit, F.lit(anchor))
    out = out.when(starts_with_any(mod, policy.prefixes), F.lit(policy.prefix_anchor))
    for letter, anchor in policy.letter_rules:
        out = out.when(src == letter, F.lit(anchor))
    return out.otherwise("")


def starts_with_any(c: Column, prefixes) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | c.startswith(p)
    return hit


def model_aliases(model) -> Column:
    """Array of the name, its short power-train spelling, and the name without that suffix."""
    m = normalize_name(model)
    short = F.regexp_replace(F.regexp_replace(m, r"\bPLUG[\s-]*IN\s+HYBRID\b", "PHEV"), r"\bHYBRID\b", "HEV")
    base = F.trim(F.regexp_replace(short, r"\s+(?:EV|HEV|PHEV)$", ""))
    return F.filter(F.array_distinct(F.array(m, short, base)), lambda x: x != "")


def model_year(c) -> Column:
    """Model year as text: a number in 1900..2200, else the first 20dd in the text."""
    t = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    num = t.try_cast("double")
    year = F.floor(num).cast("int")
    found = F.regexp_extract(t, r"\b(20\d{2})\b", 1)
    return (F.when(num.isNotNull(), F.when(year.between(1900, 2200), year.cast("string")).otherwise(""))
            .otherwise(F.coalesce(found, F.lit(""))))


def token_string(c) -> Column:
    t = F.lower(c)
    t = F.regexp_replace(t, r"[|_\-]+", " ")
    t = F.regexp_replace(t, r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def has_date_hint(c) -> Column:
    return token_string(c).rlike("|".join(DATE_HINTS))


def has_numeric_hint(c) -> Column:
    return token_string(c).rlike("|".join(NUMERIC_HINTS))


def clean_cell(c) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def sentinel_to_zero(c) -> Column:
    return F.when(c == -1, F.lit(0.0)).otherwise(c)


def clip_zero(c) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def is_total(c) -> Column:
    return F.coalesce(c.rlike(r"(?i)\btotal\b"), F.lit(False))


def usable_text(c) -> Column:
    t = F.trim(c)
    return F.when((t != "") & (F.lower(t) != "nan"), t)


# --- aggregate expressions ------------------------------------------------------

def join_unique(c) -> Column:
    return F.array_join(F.array_sort(F.collect_set(usable_text(c))), " / ")


def mode_text(c) -> Column:
    return F.coalesce(F.mode(usable_text(c), True), F.lit(""))


def single_or_mixed(c) -> Column:
    """The one non-blank value of a group, else 'Mixed' (min = max avoids collecting)."""
    v = F.nullif(c, F.lit(""))
    return F.when(F.min(v) == F.max(v), F.min(v)).otherwise("Mixed")


# --- labels -----------------------------------------------------------------------

def composite_key(*cols: Column) -> Column:
    if not cols:
        return F.lit("Total")
    return F.concat_ws(" / ", *[F.when(F.coalesce(c, F.lit("")) == "", F.lit("—")).otherwise(c) for c in cols])




def month_number_of(label) -> Column:
    """Month number named by a header label such as 'Jan', 'March', 'Jan (2)'; else null."""
    word = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:\s*\((\d+)\))?$", 1))
    pairs = [x for k, v in MONTH_NUMBERS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), word)


def block_number_of(label) -> Column:
    n = F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:\s*\((\d+)\))?$", 2)
    return F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(1))


def lifecycle_code(label) -> Column:
    t = F.lower(blank(label))
    out = None
    for word in ("discontinued", "inactive", "new", "reintroduced", "active"):
        cond = t.startswith(word)
        out = F.when(cond, F.lit(word)) if out is None else out.when(cond, F.lit(word))
    return out.otherwise("unknown")


def wholesale_source_label(c) -> Column:
    """Where a wholesale figure came from (fixed codes and labels)."""
    t = F.coalesce(c, F.lit(""))
    sponsor, fallback = F.contains(t, F.lit("sponsor_plan_official")), F.contains(t, F.lit("internal_forecast_fallback"))
    return (F.when(sponsor & fallback, "Sponsor Plan + Internal fallback").when(sponsor, "Sponsor Plan only")
            .when(fallback, "Internal fallback only").otherwise("Unavailable"))


def pnvw_state(value, wholesale, component, fleet: str = "kia_fleet_cfm_adjustment") -> Column:
    """Why revenue per vehicle is or is not shown (fixed codes and labels)."""
    return (F.when(component == fleet, "Fleet component").when(first_finite(value).isNotNull(), "available")
            .when(first_finite(wholesale) == 0, "Selected Wholesale = 0").otherwise("Selected Wholesale unavailable"))


def first_finite(*cols: Column) -> Column:
    def ok(c):
        v = c.cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
    return F.coalesce(*[ok(c) for c in cols])


# --- words ---------------------------------------------------------------------------

# fixed values: words that say nothing about a text
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "in", "is", "it", "me",
              "month", "of", "on", "or", "part", "show", "that", "the", "this", "to", "what", "why", "with")
# end of fixed values


def tokens(c) -> Column:
    """Distinct lower-case words of two letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9_]+)"), 1)
    keep = F.filter(words, lambda w: F.length(w) > 1)
    return F.array_except(F.array_distinct(keep), F.array(*[F.lit(w) for w in STOP_WORDS]))


def paragraphs(c, least: int = 40) -> Column:
    """Paragraphs of a text, single-spaced and whole, of at least ``least`` characters."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: F.length(b) >= least)


def chunks(c) -> Column:
    """Paragraphs of a text as they are shown: single-spaced, cut at 360 characters, at least 40 long."""
    blocks = F.transform(F.split(c, r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")))
    cut = F.transform(blocks, lambda b: F.when(F.length(b) > 360, F.concat(F.rtrim(F.substring(b, 1, 357)), F.lit("..."))).otherwise(b))
    return F.filter(cut, lambda b: F.length(b) >= 40)

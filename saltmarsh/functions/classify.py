"""Classifiers of claims: relation to Korea, place in supply chains, risk. Each is one expression over a row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions import words
from saltmarsh.functions.text import HANGUL, country

#: Tiers with their scores, lowest first (fixed values).
KR_TIERS = {"none": 0, "review": 30, "likely": 60, "strong": 80, "confirmed": 100}
SUPPLY_TIERS = {"none": 0, "sector": 50, "korea_ops": 65, "critical": 80, "direct": 100}
NORTH = r"(?i)north\s+korea|korea\s*,\s*north|dprk|democratic people's republic|pyongyang"


def any_of(terms: list[str] | tuple[str, ...]) -> str:
    """A pattern for any of the terms in lower-case text: Latin ones between other characters, Hangul ones anywhere; longer ones first."""
    ordered = sorted({t.strip().lower() for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    latin = [re.escape(t) for t in ordered if not re.search("[가-힣]", t)]
    hangul = [re.escape(t) for t in ordered if re.search("[가-힣]", t)]
    parts = ([rf"(?<![a-z0-9])(?:{'|'.join(latin)})(?![a-z0-9])"] if latin else []) + hangul
    return "|".join(parts) or r"(?!)"


def first_term(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The first of terms, in their order, that text has."""
    found = F.regexp_extract_all(text, F.lit(any_of(terms)), 0)
    order = F.array(*[F.lit(t.strip().lower()) for t in terms])
    return F.get(order, F.array_min(F.filter(F.transform(found, lambda t: F.array_position(order, t)), lambda p: p > 0)).cast("int") - 1)


def korea_tier(victim: Column, website: Column, sector: Column, description: Column, nation: Column, without_north: bool = True, more: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> Column:
    """confirmed, strong, likely, review or none.

    By country; by the domain of the site or at the end of the name; by names of companies, then of other bodies, in name, site and sector;
    by Hangul in the name; and for review only by any of these in the description. Excluded terms drop all but confirmed.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    v, w, d = low(victim), low(website), low(description)
    names = F.concat_ws(" ", v, w, low(sector))
    everything = F.concat_ws(" ", names, d)
    code = country(nation)
    companies = (*words.KR_COMPANIES, *more)
    tails = "|".join(re.escape(t) for t in sorted(words.KR_DOMAINS, key=len, reverse=True))
    domain = w.rlike(rf"(?:{tails})$") | F.rtrim(v).rlike(rf"(?:{tails})$")
    inside = "|".join(re.escape(t.lstrip(".")) for t in sorted(words.KR_DOMAINS, key=len, reverse=True))
    anywhere = everything.rlike(rf"(?U)(?<![\w.-])[\w-]+(?:\.[\w-]+)*\.(?:{inside})(?![\w-])") | everything.rlike(any_of((*companies, *words.KR_ENTITIES, *words.KR_WEAK))) | d.rlike(HANGUL)
    likely = names.rlike(any_of((*companies, *words.KR_ENTITIES))) | v.rlike(HANGUL)
    tier = F.when(code == "KR", "confirmed").when(domain, "strong").when(likely, "likely").when(anywhere, "review").otherwise("none")
    dropped = [t for t in (*words.KR_EXCLUDED, *excluded) if without_north or not re.search(NORTH, t)]
    gone = (tier != "confirmed") & everything.rlike(any_of(dropped))
    return F.when(code == "KP", "none").when(gone, "none").otherwise(tier)


def supply_tier(victim: Column, website: Column, sector: Column, description: Column, nation: Column, vendors: dict[str, list[str]], direct: Column | None = None) -> Column:
    """direct, critical, korea_ops, sector or none; the name of the group that claims never counts.

    vendors: terms by category. direct: whether a vendor of one's own matches (see matching.vendor_matches).
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    v, w = low(victim), low(website)
    names = F.concat_ws(" ", v, w)
    wide = F.concat_ws(" ", names, low(sector), low(description))
    code = country(nation)
    abroad = (code != "") & (code != "KR")
    terms = [t for group in vendors.values() for t in group if len(t.strip()) >= 3]
    return (
        F.when(names.rlike(any_of(words.SUPPLY_EXCLUDED)), "none")
        .when(direct if direct is not None else F.lit(False), "direct")
        .when(names.rlike(any_of(terms)), "critical")
        .when(abroad & (v.rlike(r"(?<![a-z])korean?(?![a-z])") | wide.rlike(any_of(words.KOREA_HINTS))), "korea_ops")
        .when(wide.rlike(any_of([t for t in words.SUPPLY_INDICATORS if len(t) >= 3])), "sector")
        .otherwise("none")
    )


def tier_score(tier: Column, tiers: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in tiers.items() for x in pair]), tier)


def meets(tier: Column, least: str, tiers: dict[str, int]) -> Column:
    """Whether tier is least or above."""
    return F.coalesce(tier_score(tier, tiers), F.lit(-1)) >= tiers[least]


#: Leaked items that make a high risk by themselves (fixed values).
RISK_ITEMS = ("주민번호", "카드금융")


def risk(exploit: Column, items: Column) -> Column:
    return F.when((exploit == "가능") | F.arrays_overlap(items, F.array(*map(F.lit, RISK_ITEMS))), "high").when(exploit == "조건부", "medium").otherwise("low")


def kind_terms(text: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """The categories whose terms text has, in their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(any_of(t)), name) for name, t in terms.items()]))


def foreign(code: Column, tier: Column) -> Column:
    """Whether a claim is plainly foreign: its country is known and another one, and its tier is not direct."""
    known = F.coalesce(code, F.lit(""))
    return ~known.isin("", "KR", "UNKNOWN", "N/A", "-") & ~F.coalesce(tier, F.lit("none")).isin("confirmed", "strong", "likely")

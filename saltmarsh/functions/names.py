"""Names: those that look like a person's, and names of venues as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.text import empty

#: Words that only organisations have in their names, and the parts of a person's (fixed patterns).
ORGANISATION = (
    r"(?i)\b(inc|llc|llp|lp|ltd|ltda|limited|corp|corporation|co|company|companies|gmbh|kg|ohg|ag|se|sa|sas|sarl|srl|"
    r"spa|bv|nv|plc|pty|kk|oy|ab|as|aps|cv|group|holding|holdings|hospital|clinic|klinik|medical|medicine|health|"
    r"healthcare|dental|dentistry|pharmacy|pharma\w*|lab|labs|laboratory|laboratories|university|universidad|"
    r"universit\w+|college|school|schule|academy|institute|instituto|bank|banco|capital|finance|financial|insurance|"
    r"service|services|servicios|solutions|soluciones|systems|sistemas|tech|technology|technologies|technik|"
    r"software|data|digital|network|networks|industries|industry|industrial|manufacturing|foundation|stiftung|"
    r"association|verein|society|center|centre|centro|zentrum|partners|partner|law|legal|attorneys|lawyers|"
    r"rechtsanw\w+|logistics|logistik|transport\w*|shipping|freight|energy|power|electric|motors|automotive|auto|"
    r"international|global|worldwide|enterprises|enterprise|consulting|consultants|beratung|studio|agency|church|"
    r"city|county|state|department|ministry|government|council|municipality|gemeinde|club|hotel|hotels|restaurant|"
    r"store|stores|shop|market|supply|supplies|distribution|distributors|wholesale|retail|trading|construction|"
    r"builders|bau|engineering|architects|architekten|realty|properties|property|immobilien|estate|management|"
    r"media|press|publishing|verlag|marketing|design|security|science|sciences|research|biotech|bio|chemical|"
    r"chemicals|foods|food|farm|farms|agro|steel|metal|metals|plastics|textile|apparel|fashion|travel|tours|"
    r"airlines|air|marine|mining|oil|gas|water|telecom|communications|cpa|accounting|steuerberatung|praxis|pc|pa|"
    r"dds|md|psc)\b"
)
KOREAN_ORGANISATION = (
    r"(주식회사|\(주\)|㈜|유한|병원|의원|치과|한의원|약국|학교|대학|학원|회사|그룹|센터|협회|재단|은행|공사|공단|연구소|"
    r"연구원|법인|조합|상사|산업|전자|건설|무역|물산|교회|시청|구청|군청|보험|증권|카드|캐피탈|저축|신협|농협|수협|"
    r"몰|마트|스토어|쇼핑|미디어|방송|신문|엔터|테크|솔루션|시스템|네트웍스|소프트|코리아|월드|글로벌|인터내셔널)"
)
PERSON_PART = r"^(?:(?:Dr|Mr|Mrs|Ms|Prof)\.?|[A-Z][a-z]+(?:[-'][A-Z][a-z]+)*\.?|[A-Z]\.)$"
#: The brackets that end a venue's name, and an ending like a domain's (fixed patterns).
BRACKETS = r"\s*\(([^)]*)\)\s*$"
DOMAIN_END = r"(?i)\.(?!onion$)[A-Za-z]{2,24}$"


def like_a_person(value: Column) -> Column:
    """Whether a name looks like a person's: an address, two to four Hangul letters, or two to four capitalised parts; none of an organisation.

    Names that are masked already, with digits or with a domain are none. Null or blank: no.
    """
    s = F.trim(empty(value))
    parts = F.filter(F.split(F.replace(s, F.lit(","), F.lit(" ")), r"\s+"), lambda p: p != "")
    western = F.size(parts).between(2, 4) & ~s.rlike(ORGANISATION) & F.forall(parts, lambda p: p.rlike(PERSON_PART))
    korean = s.rlike("^[가-힣]{2,4}$")
    return (
        F.when((s == "") | F.contains(s, F.lit("*")), False)
        .when(F.contains(s, F.lit("@")), True)
        .when(s.rlike(r"\d") | s.rlike(r"[A-Za-z0-9-]\.[A-Za-z]{2,}\b"), False)
        .when(korean, ~s.rlike(KOREAN_ORGANISATION))
        .otherwise(western)
    )


def bare_name(raw: Column) -> Column:
    """A venue's name without the brackets that end it."""
    return F.trim(F.regexp_replace(empty(raw), BRACKETS, ""))


def domain_head(raw: Column) -> Column:
    """The first part of a domain in those brackets; null if there is none."""
    inner = F.trim(F.regexp_extract(empty(raw), BRACKETS, 1))
    head = F.trim(F.split(inner, r"\.")[0])
    return F.when(F.contains(inner, F.lit(".")) & head.rlike("^[A-Za-z0-9-]{1,24}$"), head)


def display_name(raw: Column) -> Column:
    """A venue's name as it is shown: without brackets, and without an ending like a domain's."""
    name = bare_name(raw)
    short = F.trim(F.regexp_replace(name, DOMAIN_END, ""))
    return F.when(short != "", short).otherwise(name)

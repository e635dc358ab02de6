"""What a venue's page says: its text, title and tags, what bars the way, contacts, boards, totals and sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions import states
from saltmarsh.functions.text import empty, once

#: Signs of what bars the way: pattern and whether it is a strong one (fixed values).
SIGNALS = {
    "캡차": (
        (r"""<script[^>]+src=["'][^"']*(recaptcha|hcaptcha|turnstile|challenges\.cloudflare)""", True), (r"\b(g-recaptcha|h-captcha|cf-turnstile)\b", True),
        (r"""<img[^>]+(src|alt)=["'][^"']*captcha""", True), (r"""<input[^>]+name=["']?captcha""", True),
        (r"\bcaptcha\b", False), (r"\bкапч", False), (r"验证码", False), (r"인증\s*코드", False),
    ),
    "로그인": (
        (r"""<input[^>]+type=["']?password""", True), (r"""<form[^>]*(action|id|class)=["'][^"']*(login|signin|auth)""", True),
        (r"\bsign\s?in\b|\blog\s?in\b", False), (r"\bвойти\b|\bавториз", False), (r"로그인", False),
    ),
    "회원가입": (
        (r"""<form[^>]*(action|id|class)=["'][^"']*(register|signup|registration)""", True), (r"""<a[^>]+href=["'][^"']*(register|sign-?up)""", True),
        (r"\bregister\b|\bsign\s?up\b|\bcreate\s+account\b", False), (r"\bрегистрац", False), (r"회원가입", False),
    ),
    "초대코드": ((r"invite\s*code|invitation\s*code|referral\s*code", True), (r"\bинвайт", False), (r"초대\s*코드", False)),
    "가입비": ((r"registration\s+fee|deposit\s+required|вступительн", True),),
    "PoW/DDoS 방어": ((r"ddos-guard|proof[\s-]?of[\s-]?work|\bpow\s+challenge\b|checking\s+your\s+browser|just\s+a\s+moment", True),),
}
GATES = ("로그인", "회원가입", "초대코드", "가입비")
#: Shapes of contacts and wallets, and paths of a messenger that are no handles (fixed values).
CONTACTS = {
    "tox": (r"(?i)\b[A-F0-9]{76}\b", 0),
    "session": (r"(?i)\b05[a-f0-9]{64}\b", 0),
    "telegram": (r"(?i)(?:t\.me/|telegram(?:\.me)?[:/@\s]{1,3})([A-Za-z0-9_]{5,32})", 1),
    "jabber": (r"(?i)\b[\w.\-]{2,32}@(?:jabber|xmpp|exploit|thesecure)[\w.\-]*\.[a-z]{2,}\b", 0),
    "email": (r"(?i)\b[\w.\-]{2,40}@(?:protonmail|proton|tutanota|onionmail|cock|mail2tor|dnmx|elude|riseup)\.[a-z.]{2,10}\b", 0),
}
WALLETS = {"btc": r"\b(?:bc1[a-z0-9]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", "xmr": r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b", "eth": r"\b0x[a-fA-F0-9]{40}\b"}
NO_HANDLES = (
    "contact", "messenger", "channel", "channels", "share", "joinchat", "addstickers", "addtheme", "proxy", "socks", "login", "about", "apps",
    "faq", "blog", "privacy", "terms", "support", "download", "premium", "setlanguage", "confirmphone", "iv", "img", "telegram", "durov",
)
#: Links to boards, names that are no boards, what boards' names say of distribution and of personal data (fixed values).
BOARD_LINK = r"""(?is)<a[^>]+href="([^"]*(?:forumdisplay|viewforum|/forums?/|/board/|/c/|\bfid=|\bf=)[^"]*)"[^>]*>(.{2,90}?)</a>"""
ANY_LINK = r"(?is)<a[^>]*>(.{2,90}?)</a>"
NO_BOARDS = (
    "home", "forum", "forums", "index", "search", "login", "log in", "register", "sign up", "sign in", "logout", "members", "help",
    "faq", "rules", "contact", "about", "portal", "calendar", "chat", "profile", "settings", "upgrade", "donate", "shop", "store",
    "mark all read", "today's posts", "new posts", "what's new", "홈", "로그인", "회원가입", "검색", "도움말", "공지",
)
DISTRIBUTION = {
    "최초 유출": ("leak", "leaks", "leaked", "breach", "breaches", "database", "databases", "db leak", "dumps", "data dump", "유출", "디비"),
    "재배포": ("combo", "combolist", "combolists", "reupload", "re-upload", "mirror", "request", "requests", "sharing", "share", "공유"),
    "되팔이": ("marketplace", "market place", "buy", "sell", "selling", "vendor", "vendors", "shop section", "for sale", "auction", "trade", "판매", "거래"),
    "수법 공유": ("tutorial", "tutorials", "guide", "guides", "cracking", "crack", "method", "methods", "how to", "howto", "course", "courses", "tool", "tools", "config", "configs", "강좌", "수법"),
}
PERSONAL_BOARDS = (
    "fullz", "ssn", "dox", "doxx", "doxbin", "combolist", "combo list", "database", "databases", "identity", "id card", "passport",
    "credit card", "cvv", "carding", "bank log", "banklogs", "personal info", "pii", "주민", "신상", "개인정보",
)
#: Banners of seizure and of a domain for sale (fixed patterns).
SEIZED = r"(?i)this (?:hidden )?site has been seized|domain has been seized|operation\s+\w+.{0,40}law enforcement|이 사이트는 압수|federal bureau of investigation"
PARKED = r"(?i)buy this domain|domain (?:is )?for sale|parkingcrew|sedoparking|이 도메인은 판매"
#: A number as forums write it, the totals of members and posts from the surest form on, and words before one that is no total (fixed patterns).
NUMBER = r"[\d,\. \x{a0}\x{202f}\x{2009}]{1,18}[KkMmBb]?"
MEMBERS = (rf"Total\s+members\s*[:•·∙]\s*({NUMBER})", rf"(?:We (?:currently )?have)\s+({NUMBER})\s+members", rf"\bMembers\s*:\s*({NUMBER})", rf"(?<![:：])\s*({NUMBER})\s*Total\s+Members", rf"\bMembers\s+({NUMBER})(?:\s|$)")
POSTS = (rf"Total\s+(?:posts|messages)\s*[:•·∙]\s*({NUMBER})", rf"total of\s+({NUMBER})\s+posts", rf"\b(?:Posts|Messages)\s*:\s*({NUMBER})", rf"(?<![:：])\s*({NUMBER})\s*Total\s+Posts", rf"\b(?:Posts|Messages)\s+({NUMBER})(?:\s|$)")
NO_TOTAL = r"(?i)(?:online|active|today|newest|most|record|staff|team|birthday|guest|visitor|접속|오늘|최고)\D{0,24}$"


def spaced(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" "))


def visible_text(page: Column) -> Column:
    """The text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(empty(page), r"(?is)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return spaced(bare)


def title(page: Column) -> Column:
    """The title, else the first heading; 200 letters of it."""
    at = lambda tag: F.regexp_extract(empty(page), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    found = F.when(empty(page).rlike(r"(?is)<title[^>]*>.*?</title>"), at("title")).otherwise(at("h1"))
    return F.substring(spaced(F.regexp_replace(found, "<[^>]+>", "")), 1, 200)


def meta(page: Column, attribute: str, value: str) -> Column:
    """The content of a meta tag, whichever of its attributes comes first; null if there is none."""
    before = F.regexp_extract(empty(page), rf"""(?i)<meta[^>]+{attribute}=["']{value}["'][^>]+content=["']([^"']{{1,300}})""", 1)
    after = F.regexp_extract(empty(page), rf"""(?i)<meta[^>]+content=["']([^"']{{1,300}})["'][^>]+{attribute}=["']{value}["']""", 1)
    return F.nullif(spaced(F.when(before != "", before).otherwise(after)), F.lit(""))


def _signals(blob: Column) -> Column:
    found = []
    for name, patterns in SIGNALS.items():
        any_of = lambda strong, patterns=patterns: reduce(lambda a, b: a | b, [blob.rlike("(?i)" + p) for p, s in patterns if s == strong], F.lit(False))
        found.append(F.when(any_of(True), F.struct(F.lit(name).alias("key"), F.lit("strong").alias("value"))).when(any_of(False), F.struct(F.lit(name).alias("key"), F.lit("weak").alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*found)))


def gate(page: Column) -> Column:
    """Struct of signals (map of signal to strong or weak), signup_required and how_to_enter.

    A signal is strong if one of its strong patterns is met; only strong ones of a log-in, a sign-up, an invitation or a fee bar the way.
    """
    blob = F.concat(empty(page), F.lit(" "), visible_text(page))
    signals = F.element_at(F.transform(F.array(blob), _signals), 1)  # so that the text is made once

    def told(s: Column) -> Column:
        is_ = lambda name, strength=None: (F.element_at(s, name) == strength) if strength else F.map_contains_key(s, name)
        yes = lambda c: F.coalesce(c, F.lit(False))
        entry = F.when(yes(is_("회원가입", "strong")), "회원가입 필요").when(yes(is_("로그인", "strong")), "로그인 필요").when(is_("회원가입") | is_("로그인"), "로그인·가입 링크 있음(약한 근거)")
        parts = F.array_compact(
            F.array(
                F.when(yes(is_("PoW/DDoS 방어", "strong")), "봇 차단 페이지"),
                F.when(yes(is_("캡차", "strong")), "캡차 있음").when(yes(is_("캡차", "weak")), "캡차 가능성(약한 근거)"),
                F.when(is_("초대코드"), "초대코드 필요"),
                F.when(yes(is_("가입비", "strong")), "가입비·보증금 언급"),
                entry,
            )
        )
        how = F.when(F.size(s) == 0, "공개 접근 (로그인·캡차 신호 없음)").when(F.size(parts) == 0, "신호 약함").otherwise(F.array_join(parts, ", "))
        needed = reduce(lambda a, b: a | b, [yes(is_(g, "strong")) for g in GATES])
        return F.struct(s.alias("signals"), needed.alias("signup_required"), how.alias("how_to_enter"))

    return F.element_at(F.transform(F.array(signals), told), 1)


def found(page: Column, pattern: str, group: int = 0, most: int = 3) -> Column:
    """The first most different matches, in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(empty(page), F.lit(pattern), F.lit(group)), lambda v: F.trim(v)), lambda v: v != "")), 1, most)


def contacts(page: Column) -> Column:
    """A map of kinds of contacts to up to three of each; kinds without any are left out."""
    kinds = []
    for kind, (pattern, group) in CONTACTS.items():
        values = found(page, pattern, group, 1 << 30)
        if kind == "telegram":
            values = F.filter(values, lambda v: ~F.lower(v).isin(*NO_HANDLES))
        kinds.append(F.struct(F.lit(kind).alias("key"), F.slice(values, 1, 3).alias("value")))
    return F.map_from_entries(F.filter(F.array(*kinds), lambda e: F.size(e["value"]) > 0))


def wallets(page: Column) -> Column:
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), found(page, p).alias("value")) for k, p in WALLETS.items()]), lambda e: F.size(e["value"]) > 0))


def links(page: Column, host: Column) -> Column:
    """Struct of n, onions and domains: how many links there are, and hosts of others, each once, in order."""
    hrefs = F.regexp_extract_all(empty(page), F.lit(r"""(?i)href=["']([^"'\s>]{1,300})"""), F.lit(1))
    onion = lambda h: F.lower(F.regexp_extract(h, r"(?i)([a-z2-7]{16,56}\.onion)", 1))
    outer = lambda h: F.ltrim(F.lower(F.regexp_extract(h, r"(?i)^https?://([^/:?#]+)", 1)))
    bare = lambda d: F.regexp_replace(d, "^[w.]+", "")
    onions = F.array_distinct(F.filter(F.transform(hrefs, onion), lambda o: (o != "") & (o != F.coalesce(host, F.lit("")))))
    domains = F.filter(F.transform(F.filter(hrefs, lambda h: onion(h) == ""), lambda h: bare(outer(h))), lambda d: (d != "") & (d != F.coalesce(host, F.lit(""))) & ~F.endswith(d, F.lit(".onion")))
    return F.struct(F.size(hrefs).cast("long").alias("n"), onions.alias("onions"), F.array_distinct(domains).alias("domains"))


def latest_date(text: Column, until: Column) -> Column:
    """The last day written in text, as 2024-01-31 or 31.01.2024, that is not after until; null if there is none."""
    day = lambda y, m, d: F.format_string("%s-%02d-%02d", y, m.cast("int"), d.cast("int"))
    year_first, day_first = (r"\b(20[12]\d)[-/.](\d{1,2})[-/.](\d{1,2})\b", (1, 2, 3)), (r"\b(\d{1,2})[-/.](\d{1,2})[-/.](20[12]\d)\b", (3, 2, 1))
    days = []
    for pattern, order in (year_first, day_first):
        y, m, d = (F.regexp_extract_all(empty(text), F.lit(pattern), F.lit(k)) for k in order)
        rows = F.filter(F.arrays_zip(y.alias("y"), m.alias("m"), d.alias("d")), lambda r: r["m"].cast("int").between(1, 12) & r["d"].cast("int").between(1, 31))
        days.append(F.transform(rows, lambda r: day(r["y"], r["m"], r["d"])))
    return F.array_max(F.filter(F.concat(*days), lambda x: x <= until))


def boards(page: Column, most: int = 40) -> Column:
    """Names of boards that a page links to, those of its menus after them, each once."""
    links_to = F.regexp_extract_all(empty(page), F.lit(BOARD_LINK), F.lit(2))
    menus = F.flatten(F.transform(F.regexp_extract_all(empty(page), F.lit(r"(?is)<nav\b.*?</nav>"), F.lit(0)), lambda n: F.regexp_extract_all(n, F.lit(ANY_LINK), F.lit(1))))
    names = F.transform(F.concat(links_to, menus), lambda n: spaced(F.regexp_replace(n, "<[^>]+>", " ")))
    good = F.filter(names, lambda n: F.length(n).between(2, 46) & ~F.lower(n).isin(*NO_BOARDS) & ~n.rlike(r"^\d+$"))
    return F.slice(F.array_distinct(good), 1, most)


def distribution(names: Column) -> Column:
    """What boards' names say of how data is passed on, in the order of DISTRIBUTION."""
    says = lambda parts: F.exists(names, lambda n: reduce(lambda a, b: a | b, [F.contains(F.lower(n), F.lit(p)) for p in parts]))
    return F.array_compact(F.array(*[F.when(says(parts), kind) for kind, parts in DISTRIBUTION.items()]))


def personal_boards(names: Column, most: int = 6) -> Column:
    """Boards' names that speak of personal data, as they are; empty if there are none."""
    hit = F.filter(names, lambda n: reduce(lambda a, b: a | b, [F.contains(F.lower(n), F.lit(p)) for p in PERSONAL_BOARDS]))
    return F.when(F.size(hit) > 0, F.concat(F.lit("게시판 이름: "), F.array_join(F.slice(hit, 1, most), " · "))).otherwise("")


def blocker(headers: Column, body: Column) -> Column:
    """What stands in the way, from the headers (a map, names in any case) and the body of a refusal."""
    lower = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.lower(e["value"]).alias("value")))
    at = lambda name: F.coalesce(F.get(F.filter(lower, lambda e: e["key"] == name), F.lit(0))["value"], F.lit(""))
    has = lambda name: F.exists(lower, lambda e: e["key"] == name)
    text, server = F.lower(empty(body)), at("server")
    says = lambda *parts: reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])
    code = lambda n: text.rlike(rf"(?<![0-9]){n}(?![0-9])")  # noqa: E731  # not within a longer number
    cloudflare = F.contains(server, F.lit("cloudflare")) | has("cf-ray") | has("cf-mitigated")
    return (
        F.when(cloudflare & code(1020), "클라우드플레어 규칙에 막힙니다")
        .when(cloudflare & code(1015), "클라우드플레어가 속도 제한을 겁니다")
        .when(cloudflare, "클라우드플레어에 막힙니다")
        .when(F.contains(server, F.lit("ddos-guard")) | says("ddos-guard"), "DDoS-Guard 에 막힙니다")
        .when(has("x-sucuri-id"), "Sucuri 에 막힙니다")
        .when(has("x-iinfo") | F.contains(at("x-cdn"), F.lit("incapsula")), "Imperva 에 막힙니다")
        .when(says("just a moment", "checking your browser"), "브라우저 검사 화면입니다")
        .when(says("access denied", "forbidden"), "원서버가 막습니다")
        .when(server != "", F.concat(F.split(server, "/")[0], F.lit(" 가 막습니다")))
        .otherwise("무엇이 막는지 못 알아냈습니다")
    )


def number(text: Column) -> Column:
    """Struct of n and about: a number as forums write it; K, M and B multiply and make it a rough one. Null if there is none."""
    bare = F.regexp_replace(text, r"[ \x{a0}\x{202f}\x{2009}]", "")
    unit = F.upper(F.regexp_extract(bare, r"([KkMmBb])$", 1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9)
    digits = F.regexp_replace(bare, r"\D", "")
    rough = F.floor(F.regexp_extract(F.replace(bare, F.lit(","), F.lit("")), r"^([\d.]+)[KkMmBb]$", 1).try_cast("double") * factor)
    exact = F.when((digits != "") & (F.length(digits) <= 12), digits.cast("long"))
    n = F.when(unit != "", rough).otherwise(exact).cast("long")
    return F.when(n.between(1, 9_999_999_999), F.struct(n.alias("n"), (unit != "").alias("about")))


def total(text: Column, patterns: tuple[str, ...]) -> Column:
    """Struct of n and about: the first total that patterns find in text, the surest pattern first; null if there is none.

    What has a word of NO_TOTAL in the 40 letters before it is no total, and a number that goes on behind the match was cut.
    """
    return F.coalesce(*[_first_total(empty(text), p) for p in patterns])


def _first_total(text: Column, pattern: str) -> Column:
    # Each match with the letters before it: the text is cut behind every match, and what ends a part is a match.
    mark = "\ue000"
    cut_up = F.split(F.regexp_replace(text, f"(?i)({pattern})", f"$1{mark}"), mark)
    cut = lambda following: F.coalesce(following.rlike("^[0-9.,]"), F.lit(False)) if pattern.endswith(f"({NUMBER})") else F.lit(False)

    def totals(parts: Column) -> Column:
        ending = F.transform(parts, lambda part, k: F.when((k < F.size(parts) - 1) & ~cut(F.get(parts, k + 1)), F.struct(F.regexp_extract(part, f"(?is)^(.*?)(?:{pattern})$", 1).alias("before"), F.regexp_extract(part, f"(?is)(?:{pattern})$", 1).alias("said"))))
        good = F.filter(ending, lambda e: e.isNotNull() & ~F.substring(e["before"], -40, 40).rlike(NO_TOTAL))
        return F.get(F.filter(F.transform(good, lambda e: number(e["said"])), lambda x: x.isNotNull()), F.lit(0))

    return once(cut_up, totals)


def availability(status: Column, page: Column, day: Column) -> Column:
    """The state of a venue: a banner of seizure or sale makes it a candidate for offline, a good answer online, anything else blocked."""
    said = F.when(empty(page).rlike(SEIZED), states.seen(F.lit("후보-OFFLINE(사람 확인 필요)"), "압수배너 키워드 매칭", day))
    said = said.when(empty(page).rlike(PARKED), states.seen(F.lit("후보-OFFLINE(도메인 파킹, 사람 확인 필요)"), "파킹 페이지 키워드 매칭", day))
    said = said.when(status.between(200, 299), states.seen(F.lit("online"), "직접 접속", day))
    return said.otherwise(states.blocked(F.when(status.isNull(), "타임아웃 또는 접속 실패").otherwise(F.concat(F.lit("응답 코드 "), status.cast("string")))))


def onion_address(header: Column, page: Column, day: Column) -> Column:
    in_page = F.regexp_extract(F.lower(empty(page)), r"\b[a-z2-7]{56}\.onion\b", 0)
    return F.when(empty(header) != "", states.seen(header, "Onion-Location 헤더", day)).when(in_page != "", states.seen(in_page, "본문 정규식 매칭 (후보)", day)).otherwise(states.absent("", ""))


def signup_needed(page: Column, day: Column) -> Column:
    """A password field means that one must sign up; none means that it was not seen, and not that one need not."""
    form = empty(page).rlike(r"""(?i)<input[^>]+type=["']?password""")
    return F.when(form, states.seen(F.lit("true"), "로그인 폼 존재 여부", day)).otherwise(states.blocked("로그인 폼이 안 보입니다. 가입이 필요 없다는 뜻은 아닙니다"))


def size_estimate(last_page: Column, per_page: Column, day: Column) -> Column:
    """Last page times rows a page, marked as an estimate; blocked where either is unknown or zero."""
    n = last_page.cast("long") * per_page.cast("long")
    text = F.format_string("추정 약 %d건 (마지막 페이지 %d × 페이지당 %d건)", n, last_page.cast("long"), per_page.cast("long"))
    return F.when(n > 0, states.seen(text, "페이지네이션 추정 — 정확한 통계 아님", day, states.ESTIMATED)).otherwise(states.blocked("페이지네이션 숫자 파싱 실패"))


def last_page(pager: Column) -> Column:
    """The number in a pager's last link, else that of its address; null if there is none."""
    text = F.regexp_extract(F.regexp_replace(empty(pager), "<[^>]+>", " "), r"\d+", 0)
    address = F.regexp_extract(empty(pager), r"(?:page|p)=(\d+)", 1)
    return F.nullif(F.when(text != "", text).otherwise(address), F.lit("")).cast("long")

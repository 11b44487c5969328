"""Template residue: unfilled fields, filler, error and maintenance pages, notices that scripts are needed.

Fields. One grammar per delimiter, tried where its opening character stands. Delimiters that ordinary
texts use as well (a single bracket, angle or guillemet) count only around the name of a slot (a date,
number, amount... of something) or an instruction to fill in. A field in a code block is discounted,
unless nearly all of the text is code without a sentence beside it (an unrendered template). A field whose
sentence speaks about notation is explained; the others of its delimiter count by density, that is,
if there are more of them in the text than explained ones, as a tutorial explains what it shows.

Pages and filler. A text is read sentence by sentence. Filler is taken out by form: repeated phrases,
rows of an alphabet or keyboard, mock Latin by the shape of its words, and statements that content is
missing. A sentence is a notice by composition: a subject of its kind (a script, a page, a server, a
session...) with a predicate of that kind (needed, not found, failed, expired...), in Korean, English
or Vietnamese, and nothing that tells a reader about it (when it is shown, what it means). Requests and
apologies around a notice may accompany it. The text is a case if there was a notice or filler and
nothing else but navigation and a title. The first ordinary sentence decides that it is none, so
most texts are left after one sentence, with no limit on how far a text is read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_B = r"(?:[^{}\n]|\n(?!\s*\n))*?"  # inside braces: anything but braces and empty lines
_KOREAN_SLOT = r"(?:[가-힣]+ )*[가-힣]*(?:이름|성명|[가-힣]명|[가-힣]일|일자|날짜|기간|기한|번호|금액|[가-힣]액|금리|이율|주소|연락처|전화|이메일|코드|부서|지점|영업점|담당자|상품|한도)"
_ENGLISH_SLOT = r"(?:[A-Za-z]+[ _])*(?:name|date|number|no|amount|address|phone|tel|email|e-mail|code|rate|company|branch|department|title|period|id|limit)"
_FILL = r"(?:입력|기재|기입|작성|채우기|채워|삽입|넣기|넣을)"
#: Grammars by opening character: (delimiter, pattern).
GRAMMARS = {
    "{": [
        ("mustache", rf"\{{\{{\{{?[#/^&!>]?(?=[^{{}}]*\w){_B}\}}\}}\}}?"),
        ("tag", r"\{%-?(?=[^%]*\w)(?:[^%]|%(?!\}))*?-?%\}"),
        ("brace", r"(?<![$#{%\w\])\\])\{\s*[\w.\-]+(?: [\w.\-]+)?\s*\}(?!\})"),
    ],
    "$": [("shell", rf"\$\{{(?=[^{{}}]*\w){_B}\}}"), ("dollar", r"(?<![\w$])\$[A-Za-z가-힣][\w]{2,}\$(?![\w$])")],
    "#": [("hash", rf"#\{{(?=[^{{}}]*\w){_B}\}}")],
    "<": [
        ("server", r"<%[=#@\-]?(?=[^%]*\w)(?:[^%]|%(?!>))*?%>"),
        ("angle", rf"<\s*(?:[^<>\n]+ {_FILL}|{_KOREAN_SLOT}|(?=[^<>]*[A-Z_ ]){_ENGLISH_SLOT})\s*>"),
    ],
    "«": [("guillemet", rf"«\s*(?:{_KOREAN_SLOT}|{_ENGLISH_SLOT})\s*»")],
    "[": [
        ("wiki", r"\[\[(?=[^\[\]]*\w)[^\[\]]*\]\]"),
        ("instruction", rf"\[\s*(?:(?:INSERT|ENTER|TYPE|ADD|YOUR)\b[^\[\]]*|[^\[\]\n]* {_FILL})\s*\]"),
        ("square", rf"(?<!\])(?:(?<![\n])(?<!^)\[\s*(?:{_KOREAN_SLOT}|{_ENGLISH_SLOT})\s*\](?!\()|\[\s*{_KOREAN_SLOT}\s*\](?=[님께]))"),
    ],
    "%": [("percent", r"%%\s*\w+\s*%%|(?<![\w%])%(?!\d)[^\W\d][\w.\-]+%(?![\w%])")],
    "@": [("at", r"@@\s*[\w.\-]+\s*@@")],
    "_": [("under", r"(?<!\w)__[^\W\d_]\w*?__(?!\w)")],
    "(": [("instruction", rf"\(\s*(?:여기에\s[^()]*{_FILL}\S*|(?:insert|enter|type)\s[^()]*\shere)\s*\)")],
    "T": [("todo", rf"\bTODO\s*:\s*(?:[^\W\d_]\w*[ \t]+)+{_FILL}|\bTODO\s*:\s*(?:fill|add|insert|enter|replace|update)\b")],
}
_TRY = {c: [(k, re.compile(p, re.I if k in ("instruction", "square", "angle", "guillemet") else 0)) for k, p in ps] for c, ps in GRAMMARS.items()}
_AT = re.compile(r"[{<«\[@$#%_]")
_SPOKEN = re.compile(r"\(|TODO")  # openings that need a word behind them
_SPOKEN_WORDS = ("여기에", "nsert", "INSERT", "nter ", "ENTER ", "ype ", "TYPE ", "TODO")
#: A sentence that speaks about notation.
_EXPLAINS = re.compile(r"중괄호|대괄호|꺾쇠|괄호[로를]|자리\s*표시|자리에[는 ]|치환|템플릿\s*(?:문법|구문|엔진)|표기법|문법|구문|예약어|변수[로를는]|placeholder|curly brac|square bracket|angle bracket|\bbrac(?:e|ket)s\b|notation|syntax|stands for|is replaced by", re.I)
_CODE = re.compile(r"```.*?```|<code>.*?</code>|<pre>.*?</pre>|`[^`\n]+`", re.S)
CODE_SHARE = 0.8  # of the letters, from which on a text in code is a template

_SPACE = re.compile(r"\s+")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\x00-\x08\x0e-\x1f\x7f]")
_WORD = re.compile(r"[^\W\d_]")
_SENTENCE_END = re.compile(r"[가-힣][.!?]|[^\W\d_]{2,}[)\"'”’]*[.!?。](?:\s|$)")


def _clean(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _INVISIBLE.sub("", text).replace("\xa0", " ")


def fields(text: str) -> Iterator[tuple[str, int, int]]:
    """(delimiter, start, stop) of each field in a text."""
    for openings in (_AT, _SPOKEN) if any(w in text for w in _SPOKEN_WORDS) else (_AT,):
        done = 0
        for m in openings.finditer(text):
            at = m.start()
            if at < done:
                continue
            for kind, pattern in _TRY[text[at]]:
                f = pattern.match(text, at)
                if f:
                    yield kind, at, f.end()
                    done = f.end()
                    break


def _all_template(text: str, outside: str) -> bool:
    """Is a text with fields in code nearly all code? An unrendered template has no sentence beside it
    and at least CODE_SHARE of its letters in code; a text that shows code to the reader has sentences."""
    return len(_WORD.findall(outside)) < (1 - CODE_SHARE) * len(_WORD.findall(text)) and not _SENTENCE_END.search(outside) and not _EXPLAINS.search(outside)


_STOPS = re.compile(r"다\.|[.!?]\s|\n\s*\n")


def _sentence(text: str, a: int, b: int) -> str:
    """The sentence around text[a:b]."""
    lo = 0
    for w in (300, 3000, len(text)):  # look near first; the whole text if need be
        last = None
        for last in _STOPS.finditer(text, max(0, a - w), a):
            pass
        if last or w >= a:
            lo = last.end() if last else 0
            break
    end = _STOPS.search(text, b)
    return text[lo : end.end() if end else len(text)]


def unfilled(text: str) -> str | None:
    """The delimiter of an unfilled field, discounting code blocks and explanations by density."""
    if "`" in text or "<code>" in text or "<pre>" in text:
        outside = _CODE.sub(" ", text)
        if outside != text:
            inside = next(fields(text), None)
            if inside and _all_template(text, outside):
                return inside[0]
            text = outside
    plain: dict[str, int] = {}
    explained: dict[str, int] = {}
    for kind, a, b in fields(text):
        to = explained if _EXPLAINS.search(_sentence(text, a, b)) else plain
        to[kind] = to.get(kind, 0) + 1
    return next((k for k, n in plain.items() if n > explained.get(k, 0)), None)


# Notices, by composition


def _re(*parts: str) -> re.Pattern:
    """For lower-case text."""
    return re.compile("|".join(parts))


#: (subject, predicate) of each kind of notice.
NOTICES = {
    "script": (
        _re(r"java ?script", r"\bjs\b", r"\bscripts?\b", "자바 ?스크립트", "스크립트"),
        _re(r"\b(?:en|dis)abled?\b", r"\b(?:turn|switch)(?:ed)? ", r"\b(?:block|allow|requir|need|activat|support)\w*", r"\bwithout\b", "켜", "꺼", "허용", "활성", "차단", "제한", "지원하지", "사용하도록", "사용할 수 없", "필요", "bật", "tắt", "kích hoạt", "yêu cầu", "cho phép"),
    ),
    "missing": (
        _re(r"\b(?:page|document|url|link|file|post|resource|content|article|product)s?\b", "페이지", "문서", "자료", "게시[물글]", "화면", "주소", "상품", "경로", "파일", r"\btrang\b", "tài liệu", "nội dung"),
        _re(r"not (?:be )?found", r"(?:can(?:'t|not| not)|could ?n(?:o|')t|unable to) (?:be )?(?:found|find|load)", r"(?:does ?n(?:o|')t|no longer) (?:exist|available)", r"no longer", r"(?:has|have|was|were) been? ?(?:removed|deleted|moved)", "찾을 수 없", "찾지 못", "존재하지 않", "(?:페이지|문서|게시[물글])[가이는은]? 없습니다", "삭제되었거나", "(?:삭제|이동)된", "열람 권한", "받지 못했", "không tìm thấy", "không tồn tại"),
    ),
    "failure": (
        _re(r"\b(?:error|exception|problem)\b", r"something went wrong", r"went wrong", "오류", "에러", "문제[가는]", "장애", r"\blỗi\b", "sự cố", "실패"),
        _re(r"occurr?ed", r"encounter", r"happened", r"went wrong", r"establishing", r"unexpected", r"internal", r"unknown", r"try again", "발생(?:하였|했|하여)", "생겼", "(?:시스템|서버|내부|일시적인?|알 수 없는) ?(?:오류|에러|장애)", "표시(?:하지|할 수)", "처리하는 중", "(?:가져오|불러오|처리하|내려받)지 못", "불러오는 중", "실패(?:하였|했)", "xảy ra"),
    ),
    "server": (
        _re(r"\b(?:server|service|gateway|connection|database|network|site|website|system)\b", "서버", "서비스", "홈페이지", "사이트", "연결", "네트워크", "통신", "접속", "응답", "hệ thống", "máy chủ"),
        _re(r"unavailable", r"not (?:respond|answer)", r"timed? ?-?out", r"refused", r"\blost\b", r"\bis down\b", r"bad gateway", "끊어졌", "끊겼", "응답이 없", "(?:늦어지|지연되)고 있", "중단(?:되었|됩|합|하고)", "불안정", "gián đoạn"),
    ),
    "maintenance": (_re(r"maintenance", r"upgrad", "점검", "개편", "bảo trì", "nâng cấp"), _re(r"currently", r"undergoing", r"\bdown\b", r"be back", r"check back", r"until", "중입니다", "중이", "동안", "중단", "이용하실 수 없", "제한됩", "đang", "quay lại")),
    "access": (
        _re(r"\b(?:access|permission|session|login|authori[sz]\w+)\b", "접근", "권한", "세션", "로그인", "로그아웃", r"\bphiên\b", "quyền"),
        _re(r"denied", r"forbidden", r"expired", r"timed? ?out", r"not (?:have |allowed|permitted|authori)", r"no permission", r"blocked", "만료", "허용되지", "거부", "차단", "권한이 없", "로그아웃되", "hết hạn", "từ chối"),
    ),
    "load": (_re(r"too many requests", r"temporarily blocked", "(?:접속|이용|사용)자가 많", "대기 순번", r"^[^.]{0,40}\bloading\b", r"please wait", "불러오는 중", "로딩 ?중", "đang tải"), _re("")),
    "trace": (
        _re(r"\bhttp\s?(?:error\s*)?[45]\d\d\b", r"\b[45]\d\d\b[\s:\-–]*(?:error|not found|page not|forbidden|bad |internal|service|unauthori|gateway)", r"traceback \(most", r"\b\w*(?:exception|error)\b\s*(?::|\(|at\b)", r"fatal error", r"uncaught", r"unhandled", r"stack ?trace", r"\bat [\w.$<>]+\([\w.]+:\d+\)", r'file "[^"]+", line \d+', r"\bon line \d+"),
        _re(""),
    ),
}
#: What may stand beside a notice: requests, apologies, hints.
_BESIDE = _re(
    r"try again", r"\b(?:re)?load\b", r"refresh", r"\bcheck (?:your|the|back)", r"contact (?:the |your |our )?(?:admin|support|us|help)", r"sorry|apolog|oops", r"(?:log|sign) ?in\b", r"\bback (?:soon|shortly|later)", r"be back", r"(?:has|have) been notified", r"turn (?:it|them) on", r"enable it", r"allow (?:it|them)", r"may be (?:broken|switched off|missing)", r"slow down",
    "다시 (?:시도|접속|로그인|이용|확인|열)", "재시도", "새로 ?고침", "확인(?:하여|해) ?(?:주|보)", "확인하(?:시|십)", "확인(?:한 후| 바랍)", "문의(?:하|바)", "불편을", "죄송", "양해", "이용(?:해|하여) 주", "기다려", "보이지 않을 수", "되었을 수 있", "바뀌었거나", "허용(?:해|하여|한)", "thử lại", "quay lại", "liên hệ", "kiểm tra",
)
#: What tells a reader about errors, scripts or outages instead of being one.
_TELLS = _re(
    r"(?:나오|나타나|표시되|보이|뜨|생기|발생하|되풀이되|못하|누르|하)면", "방법", "이란", "라는", "뜻", "의미", "설명(?!서)", "예를 들", "(?:매|격)(?:월|주|년|일|분기)", "분기마다", "때에?는?[ ,]", "경우", "까지", "것이 좋", "것으로 보",
    r"\bmeans?\b", r"refers? to", r"for example", r"\bevery\b", r"\bif (?:the|you|your|a|an|it)\b", r"\bwhen (?:the|you|your|a)\b", r"as described", r"stands for", r"how to", r"\bonly (?:during|if|when)\b", r"\bnếu\b", r"\bkhi\b",
)
NOTICE_LETTERS = 160  # a longer sentence tells something

# Filler, by form

_ROWS = ("가나다라마바사아자차카타파하", "abcdefghijklmnopqrstuvwxyz", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwer", "ㅁㄴㅇㄹ", "ㄱㄴㄷㄹㅁㅂㅅ", "ㅂㅈㄷㄱ")
_ROW_TOKENS = frozenset(r[i:j] for r in _ROWS for i in range(len(r)) for j in range(i + 3, len(r) + 1))
_TOKEN = re.compile(r"(?<!\w)\w{3,}(?!\w)")
_REPEATED = re.compile(r"(?<!\S)(\S+(?: \S+){0,3}?)(?: \1){2,}(?!\S)")
_MISSING_CONTENT = re.compile("|".join((
    r"(?:placeholder|dummy|sample|filler|mock|test) (?:text|copy|content|data|document|page|title)s?(?: goes)?(?: here)?(?: \d+)?[.]?",
    r"(?:this is |here is )?(?:a )?(?:placeholder|dummy|sample|filler)(?: text| copy| content)?[.]",
    r"(?:your |the |insert |more )?(?:text|content|title|body|copy) (?:goes|will go|to be added|will be added)? ?here[.!]?",
    r"(?:replace|edit|change) (?:it|this)(?: text| content)?(?: with your own)?(?: text| content)?[.!]?", r"click (?:here )?to (?:edit|add)(?: this)?(?: text| content| title)?[.!]?",
    r"(?:page |site |website )?under construction[.!]?", r"coming soon[.!]?", r"come back soon[.!]?", r"\b(?:tbd|tba)\b[.]?",
    r"(?:더미|샘플|테스트|임시|예시|가짜) ?(?:데이터|문구|텍스트|문서|내용|글|페이지|제목)?(?:입니다)?[.]?(?: \d+)?",
    rf"(?:여기|이곳|이 자리)에 (?:\S+ ){{0,3}}?{_FILL}\S*(?: 주\S+)?[.!]?",
    r"(?:본문|상세)? ?내용이 들어갈 자리\S*", r"(?:내용|자료|페이지|화면|상품|콘텐츠|문서|본문)(?:[은는이가] | )?준비 ?중\S*", r"(?:추후|나중에|차후) \S+ ?예정\S*", r"실제 \S+ (?:바꿔|바꾸|교체|대체)\S*(?: 주\S+)?[.]?",
    r"제목 없음(?: ?-)?", r"내용 없음", r"\b무제\b", r"\buntitled(?: document| page)?\b", r"(?:초안|draft) ?v?\d*(?: ?\((?:작성 전|미작성|빈 문서|empty)\))?",
)), re.I)
_LATIN_RUN = re.compile(r"(?<![\w가-힣])[A-Za-z]+(?:,? [A-Za-z]+){3,}[.,;]?(?!\w)")
#: Classic mock Latin (fixed values).
_LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat "
    "nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum dolorem neque".split()
)
#: Words that a run of English has and mock Latin has not.
_ENGLISH = frozenset("the of and to is are for with on by this that you your we be will from or as can may not if it was has have our their when which an at page back home".split())
_LATIN_WORD = re.compile(r"(?:qu|[b-df-hj-np-tvxz]|[aeiou])*?[aeiou](?:s|m|t|r|n|nt|ns|x|c|d|l)?", re.I)
_UNLATIN = re.compile(r"[kwyj]|th|sh|ck|gh|oo|ee|ou|ing$|ed$|([bhkvz])\1", re.I)
LATIN_SHARE = 0.8


def _mock_latin(m: re.Match) -> str:
    """A run of words is mock Latin if it has no word of English grammar, and either a third of it is of the
    classic text or nearly all of it has the shape of Latin words, as running text (not a name in capitals)."""
    words = re.findall(r"[A-Za-z]+", m[0])
    low = [w.lower() for w in words]
    if _ENGLISH.intersection(low) or sum(w.islower() for w in words[1:]) < LATIN_SHARE * (len(words) - 1):
        return m[0]
    known = sum(w in _LOREM for w in low)
    shaped = sum(bool(_LATIN_WORD.fullmatch(w)) and not _UNLATIN.search(w) for w in low)
    return " \x01 " if 3 * known >= len(low) or (len(low) > 5 and shaped >= LATIN_SHARE * len(low)) else m[0]


def _without_filler(s: str) -> str:
    """A sentence with its filler marked."""
    s = _MISSING_CONTENT.sub(" \x01 ", s)
    s = _LATIN_RUN.sub(_mock_latin, s)
    s = _REPEATED.sub(" \x01 ", s)
    if not _ROW_TOKENS.isdisjoint(_TOKEN.findall(s.lower())):
        s = _TOKEN.sub(lambda m: " \x01 " if m[0].lower() in _ROW_TOKENS else m[0], s)
    return s


def is_notice(s: str) -> bool:
    """Is a sentence a notice by its composition?"""
    low = s.lower()
    return any(b.search(low) and a.search(low) for a, b in NOTICES.values()) and len(_WORD.findall(s)) <= NOTICE_LETTERS and not _TELLS.search(low)


_PART = re.compile(r"\S.*?(?:[.!?。…]+[\"'”’)\]]*(?=\s|$)|$)", re.S)
_ENDS = re.compile(r"[^\W\d_][\"'”’)\]]*[.!?。…]+[\"'”’)\]]*\s*$")
#: Navigation: short labels between separators; identifiers of requests.
_NAVIGATION = re.compile(r"(?:[\w가-힣\[\]]+(?: [\w가-힣]+)? ?[>/|»·] ?)+[\w가-힣]+|(?:번호|reference|ref|code|id|코드)[ .:#]*[0-9a-f][\w,-]*", re.I)
TITLE = 45  # letters beside a notice that may be a title and links; Latin letters count half


def _weight(s: str) -> float:
    letters = _WORD.findall(_NAVIGATION.sub(" ", s))
    return sum(0.5 if c < "\u0250" or "\u1e00" <= c < "\u1f00" else 1 for c in letters)


def is_page(text: str) -> bool:
    """Is a text a notice or filler in place of content?"""
    found, rest = False, 0.0
    for m in _PART.finditer(text):
        s = _SPACE.sub(" ", m[0])
        if is_notice(s):
            found = True
            continue
        marked = _without_filler(s)
        left = marked.replace("\x01", " ").strip(" .,;:!-–()")
        found |= "\x01" in marked
        if not left:
            continue
        if _ENDS.search(marked):  # an ordinary sentence, or what stands beside a notice
            if _TELLS.search(s.lower()) or not _BESIDE.search(s.lower()) or len(_WORD.findall(s)) > NOTICE_LETTERS:
                return False
            continue
        rest += _weight(left)
        if rest > TITLE:
            return False
    return found


def residue_kind(text: str | None) -> str | None:
    """field, page (notice or filler instead of content), or None."""
    if not text or text.isspace():
        return None
    t = _clean(text)
    if unfilled(t):
        return "field"
    return "page" if is_page(t) else None


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = pa.array([residue_kind(t) for t in batch.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), kinds], ["id", "kind"]).filter(kinds.is_valid())


def residue(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, kind (field or page) of the rows that hold residue instead of, or amid, content; a row per
    distinct id and kind. Null, empty and blank texts are no cases. One pass; only hits are shuffled."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_kinds, f"id {kind}, kind string").distinct().withColumnRenamed("id", id_col)

"""Column functions over document and chunk texts. All but the few marked run in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"
#: Particles at the end of a word, stop words, document kinds, categories in match order.
PARTICLES = "으로|에서|에게|까지|부터|이나|라도|든지|에는|은|는|이|가|을|를|의|에|도|만|과|와|로"
CATEGORIES = ("digital_banking", "retirement_pension", "derivatives", "deposit", "trust", "loan", "fx", "others")
KIND_WORDS = ("상품설명서", "설명서", "약관", "약정서", "계약서", "동의서", "신청서", "확인서", "권유문서", "포트폴리오")
COMMON_TERMS = (
    "예금", "적금", "대출", "은행", "고객", "계좌", "통장", "이자", "이율", "금리", "신청", "가입", "해지", "거래", "서비스", "상품", "경우", "기간",
    "지급", "발급", "이용", "확인", "제공", "하나", "하나은행", "본인", "가능", "불가", "해당", "관련", "내용", "사항", "방법", "필요",
)
#: Words of a question that tell nothing about its subject.
QUESTION_WORDS = (
    "하나은행", "하나", "은행", "경우", "어떻게", "무엇", "어떤", "언제", "얼마", "있나요", "하나요", "되나요", "인가요", "합니까", "됩니까",
    "가능", "필요", "제가", "저는", "내가", "우리", "그거", "이거", "때문", "위해", "대해",
)
BLANK_PATTERN = r"\(\s*\)|\(\s*%\s*\)|（\s*）|_{3,}|\.{5,}|☐|□"
LABELS = r"^(?:(?:Q\.|A\.|질문|답변)\s*){1,2}"
SUBTITLE_MAX = 24


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: lambdas are not searched for common parts."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without any white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    return F.regexp_replace(c, WS, "")


def filled(c: Column) -> Column:
    """Null where blank."""
    return F.nullif(F.trim(c), F.lit(""))


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column | str) -> Column:
    """NFC has no built-in function, hence Python, and nothing but NFC."""
    return F.pandas_udf(_nfc, "string")(c)


#: A line end of any kind with the white space before it.
LINE_END = r"(?U)[^\S\n]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])"


def normalize_text(c: Column | str) -> Column:
    """NFC, plain spaces, no spaces at line ends, at most one empty line in a row."""
    t = F.regexp_replace(nfc(c), r"[ \t\x{a0}\x{3000}]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(t, LINE_END, "\n"), "\n{3,}", "\n\n"))


def plain_text(c: Column | str) -> Column:
    """NFC, plain spaces, runs of blanks as one; lines stay as they are."""
    return strip(F.regexp_replace(nfc(c), r"[ \t\x{a0}\x{3000}]+", " "))


_SPACED = re.compile(r"(?:[가-힣]\s){2,}[가-힣]")


def _collapsed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _SPACED.sub(lambda m: m[0].replace(" ", ""), t))


def collapse_letter_spacing(c: Column | str) -> Column:
    """'대 출 약 정 서' -> '대출약정서'; ordinary spaces between words stay."""
    return F.pandas_udf(_collapsed, "string")(c)


def content_hash(c: Column) -> Column:
    return F.sha2(squash(c), 256)


def filename_date(c: Column) -> Column:
    return F.try_to_date(F.regexp_extract(c, r"(?i)_(\d{8})\.pdf$", 1), "yyyyMMdd")


def filename_type(c: Column) -> Column:
    return F.when(c.contains("_terms_"), "약관").otherwise("설명서")


def filename_category(c: Column) -> Column:
    out = F.when(F.lit(False), "")
    for cat in CATEGORIES:
        out = out.when(c.contains(f"_{cat}_"), cat)
    return out.otherwise("unknown")


def n_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def structure(c: Column) -> Column:
    return (
        F.when(n_matches(c, r"(?U)제\s*\d+\s*조") >= 5, "article")
        .when(n_matches(c, "[①-⑯]") >= 10, "clause")
        .when(n_matches(c, r"(?mdU)^\s*\d+\.\s") >= 5, "numbered")
        .otherwise("flat")
    )


#: The printed number of an approval, and that of the triage, which knows terms only.
COMPLIANCE = r"(?U)제?\s*(\d{4})\s*-\s*(약관|상품|설명서)\s*-\s*(\d+)\s*호"


TERMS_COMPLIANCE = r"(?U)(\d{4})\s*-\s*약관\s*-\s*(\d+)\s*호"


def compliance_no(c: Column) -> Column:
    parts = [F.regexp_extract(c, COMPLIANCE, i) for i in (1, 2, 3)]
    return F.when(c.rlike(COMPLIANCE), F.concat_ws("-", *parts))


def compliance_date(c: Column, window: int = 40, number: str = COMPLIANCE) -> Column:
    """The date in brackets within `window` characters behind the number."""
    hit = F.regexp_extract(c, number, 0)
    tail = F.substr(c, F.instr(c, hit) + F.length(hit), F.lit(window))
    d = r"\((\d{4})[.\-](\d{1,2})[.\-](\d{1,2})\)"
    ymd = F.concat_ws("-", F.regexp_extract(tail, d, 1), F.lpad(F.regexp_extract(tail, d, 2), 2, "0"), F.lpad(F.regexp_extract(tail, d, 3), 2, "0"))
    return F.when(c.rlike(number) & tail.rlike(d), F.try_to_date(ymd, "yyyy-MM-dd"))


def is_scan(chars: Column, pages: Column, threshold: int = 100) -> Column:
    return F.floor(F.coalesce(chars, F.lit(0)) / F.greatest(F.coalesce(pages, F.lit(0)), F.lit(1))) < threshold


def display_name(title: Column, subtitle: Column, filename: Column) -> Column:
    t, s = F.nullif(title, F.lit("")), F.nullif(subtitle, F.lit(""))
    return F.when(s.isNotNull() & ~s.eqNullSafe(t), F.concat(F.coalesce(t, F.lit("")), F.lit(" - "), s)).otherwise(F.coalesce(t, filename))


def document_citation(name: Column, doc_type: Column, effective: Column) -> Column:
    label = F.when(doc_type == "FAQ", "수집").otherwise("시행")
    return F.concat_ws(" ", name, F.when(effective.isNotNull(), F.concat(F.lit("("), effective.cast("string"), F.lit(" "), label, F.lit(")"))))


def chunk_citation(name: Column, section: Column, doc_type: Column, effective: Column) -> Column:
    label = F.when(doc_type == "FAQ", "수집").otherwise("시행")
    sec = F.when(F.nullif(section, F.lit("")) != "FAQ", section)
    e = F.nullif(effective, F.lit(""))
    return F.concat_ws(" ", F.nullif(name, F.lit("")), sec, F.when(e.isNotNull(), F.concat(F.lit("("), e, F.lit(" "), label, F.lit(")"))))


def indexable_text(name: Column, section: Column, text: Column, keep_faq: bool = False) -> Column:
    """Name and section before the text. The index leaves out the section FAQ; token counts keep it."""
    sec = F.nullif(section, F.lit(""))
    prefix = F.concat_ws(" ", F.nullif(name, F.lit("")), sec if keep_faq else F.when(sec != "FAQ", sec))
    return F.when(prefix != "", F.concat(prefix, F.lit("\n"), F.coalesce(text, F.lit("")))).otherwise(text)


def clean_doc_name(name: Column) -> Column:
    """The head of 'head - tail', unless the tail is a short subtitle."""
    n = F.trim(name)
    at = F.instr(n, F.lit(" - "))
    tail = F.trim(F.substr(n, at + 3, F.length(n)))
    return F.when((at == 0) | ((F.length(tail) <= SUBTITLE_MAX) & ~tail.contains(":")), n).otherwise(F.trim(F.substr(n, F.lit(1), at - 1)))


def catalog_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z가-힣]", "")


def name_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(clean_doc_name(c)), F.lit("([0-9a-z가-힣]+)"), F.lit(1)), lambda t: F.length(t) >= 2)


def word_tokens(c: Column) -> Column:
    """The default index tokenizer: runs of letters and digits, lower case, two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([0-9a-z가-힣]+)"), F.lit(1)), lambda t: F.length(t) >= 2)


def gram_set(c: Column, n: int = 3) -> Column:
    """Distinct n-character sequences of letters and digits; a shorter text is its own."""
    every = lambda t: F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))  # noqa: E731  one pass over the text
    grams = lambda t: F.when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(every(t)))
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "[^가-힣A-Za-z0-9]", "")
    return let(plain, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(grams(t)))


def overlap(a: Column, b: Column) -> Column:
    """Common members over the smaller set; 0 if one is empty."""
    small = lambda x: F.least(F.size(x["a"]), F.size(x["b"]))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when(small(x) > 0, F.size(F.array_intersect(x["a"], x["b"])) / small(x)).otherwise(F.lit(0.0)))


def terms(c: Column) -> Column:
    """Words of two letters or more without a particle at the end and without words of questions; repeats stay."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([가-힣A-Za-z]{2,})"), F.lit(1))
    bare = F.transform(words, lambda w: F.regexp_replace(w, f"(?:{PARTICLES})$", ""))
    return F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.isin(*QUESTION_WORDS))


def lexical_overlap(words: Column, text: Column) -> Column:
    """Share of the words that occur in the text as substrings."""
    return let(words, lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: F.contains(text, w))) / F.size(ws)).otherwise(F.lit(0.0)))


def stem_overlap(question: Column, text: Column) -> Column:
    """Share of the words of three letters or more whose first three occur in the text; 0 for under three such words."""
    words = F.regexp_extract_all(question, F.lit("([가-힣]{3,})"), F.lit(1))
    words = F.filter(words, lambda w: ~w.isin(*COMMON_TERMS) & ~F.substring(w, 1, 2).isin(*COMMON_TERMS))
    return let(words, lambda ws: F.when(F.size(ws) >= 3, F.size(F.filter(ws, lambda w: F.contains(text, F.substring(w, 1, 3)))) / F.size(ws)).otherwise(F.lit(0.0)))


def first_shared_term(source: Column, target: Column, pattern: str, strip_particles: bool, least: int) -> Column:
    """The first term of the source that occurs in the target, or null."""
    words = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    if strip_particles:
        words = F.transform(words, lambda w: F.regexp_replace(w, f"(?:{PARTICLES})$", ""))
        keep = lambda w: (F.length(w) >= least) & ~w.isin(*COMMON_TERMS)
    else:
        keep = lambda w: ~w.isin(*COMMON_TERMS) & ~F.substring(w, 1, 2).isin(*COMMON_TERMS)
    return F.try_element_at(F.filter(words, lambda w: keep(w) & F.contains(target, w)), F.lit(1))


def has_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(BLANK_PATTERN), F.lit(False))


def space_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / F.length(c)).otherwise(F.lit(0.0))


def longest_hangul_run(c: Column, least: int = 12) -> Column:
    runs = F.regexp_extract_all(c, F.lit(f"([가-힣]{{{least},}})"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def guarded_restore(original: Column, restored: Column, healthy: float = 0.10) -> Column:
    """The restored text if the original lacks spaces and nothing but white space differs."""
    return F.when((space_ratio(original) < healthy) & (squash(original) == squash(restored)), restored).otherwise(original)


def chunk_to_doc(c: Column) -> Column:
    return F.regexp_replace(c, "_c[^_]*$", "")


def citation_key(c: Column) -> Column:
    """A citation up to its article, clause or bracket."""
    return F.trim(F.split(c, r"\s*(?:제\d+조|제\d+항|\()")[0])


def sentences(c: Column, least: int = 5) -> Column:
    """Sentences of an answer longer than `least` characters."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+|\n+"), strip)
    return F.filter(parts, lambda s: F.length(s) > least)


def filename_hint(c: Column) -> Column:
    """The romanised middle of a file name: its parts from the fourth to the one before the date."""
    parts = F.split(F.regexp_replace(c, r"(?i)\.pdf$", ""), "_")
    return F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 4, F.lit(0))), " ")


def faq_label_free(c: Column) -> Column:
    """White space squashed, labels in front removed twice."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS, " ")), LABELS, ""))


def cache_key(*parts: Column, separator: str = "|") -> Column:
    return F.substring(F.sha2(F.concat_ws(separator, *parts), 256), 1, 24)

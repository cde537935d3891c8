"""Text functions as Column expressions: extraction, classification, repair, snippets, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month and day names, patterns and keyword lists that decide what is extracted.
MONTHS_ID = "Januari|Februari|Maret|April|Mei|Juni|Juli|Agustus|September|Oktober|November|Desember"
DAYS_ID = "Senin|Selasa|Rabu|Kamis|Jumat|Sabtu|Minggu"
MONTHS_EN = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_PATTERNS = [
    (rf"(?i)\b(\d{{1,2}})\s+({MONTHS_ID})\s+(\d{{4}})\b", "$1 $2 $3"),
    (rf"(?i)\b({DAYS_ID}),?\s+(\d{{1,2}})\s+({MONTHS_ID})\s+(\d{{4}})\b", "$1 $2 $3 $4"),
    (rf"(?i)\b({MONTHS_EN})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", "$1 $2 $3"),
    (r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b", "$1 $2 $3"),
    (r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{4})\b", "$1 $2 $3"),
]
TEMPORAL_PATTERNS = [r"(?i)\b(Q[1-4]\s+\d{4})\b", r"(?i)\b(FY\s*\d{4})\b", r"(?i)\b(tahun\s+\d{4})\b", r"(?i)\b(year\s+\d{4})\b"]
PERCENT = r"\b(\d+[,.]\d+)%"
NUMBER = r"\b(\d{1,3}(?:[,.]\d{3})*(?:[,.]\d+)?)\b"
URL = r"(?i)https?://[^\s<>\"]+|www\.[^\s<>\"]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CAPS = {"dates": 20, "temporal": 10, "numbers": 30, "urls": 10, "emails": 10}
DOCUMENT_TYPES = {
    "financial_report": ["laporan keuangan", "financial report", "balance sheet", "income statement", "neraca", "laba rugi"],
    "market_insight": ["market insight", "market analysis", "analisis pasar", "daily market"],
    "product_info": ["product", "produk", "product focus", "product information"],
    "legal_document": ["kontrak", "contract", "perjanjian", "agreement", "legal", "hukum"],
    "research_paper": ["abstract", "abstrak", "methodology", "metodologi", "research", "penelitian"],
    "proposal": ["proposal", "usulan", "penawaran"],
    "report": ["report", "laporan"],
    "presentation": ["presentation", "presentasi", "slide"],
}
WORDS_ID = ["dan", "yang", "untuk", "dengan", "pada", "adalah", "dari", "ini", "dalam"]
WORDS_EN = ["and", "the", "for", "with", "this", "that", "from", "are", "was", "were"]
OCR_FIXES = {"daan": "dan", "yano": "yang", "unluk": "untuk"}
CURRENCY = [
    (r"(?i)(?:Rp|IDR)\s?([\d,.]+)(?:\s*(?:ribu|juta|miliar|triliun))?", "idr"),
    (r"(?i)(?:USD|\$)\s?([\d,.]+)(?:\s*(?:thousand|million|billion))?", "usd"),
]
PERCENTAGE = r"(\d+(?:[.,]\d+)?)\s*%"
PERIOD = r"(?i)(\d+)\s*(tahun|bulan|hari|minggu|kuartal|semester)"
TABLE_SIGNS = ["%", "$", "|", "USD", "IDR", "Feb", "Jan"]


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def distinct_capped(values: Column, most: int) -> Column:
    """Sorted, distinct, at most so many: the cap is the property's own limit."""
    return F.slice(F.array_sort(F.array_distinct(values)), 1, most)


def dates(text: Column) -> Column:
    def parts(p: str, to: str) -> Column:
        return F.transform(matches(text, p), lambda m: F.regexp_replace(m, p, to))

    found = [parts(p, to) for p, to in DATE_PATTERNS]
    return distinct_capped(F.concat(*found), CAPS["dates"])


def temporal_references(text: Column) -> Column:
    return distinct_capped(F.concat(*[matches(text, p, 1) for p in TEMPORAL_PATTERNS]), CAPS["temporal"])


def percents(text: Column) -> Column:
    return matches(text, PERCENT, 1)


def numbers(text: Column) -> Column:
    return distinct_capped(F.concat(percents(text), matches(text, NUMBER, 1)), CAPS["numbers"])


def urls(text: Column) -> Column:
    return distinct_capped(matches(text, URL), CAPS["urls"])


def emails(text: Column) -> Column:
    return distinct_capped(matches(text, EMAIL), CAPS["emails"])


def document_type(text: Column) -> Column:
    """First class of which a keyword occurs; the order of classes matters."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for kind, words in DOCUMENT_TYPES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def language(text: Column) -> Column:
    """indonesian, english or mixed, by how many distinct stop words of each occur between blanks."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    count = lambda words: sum((padded.contains(f" {w} ").cast("int") for w in words), F.lit(0))
    a, b = count(WORDS_ID), count(WORDS_EN)
    return F.when(a > b, "indonesian").when(b > a, "english").otherwise("mixed")


def numeric_pattern_counts(text: Column) -> Column:
    """Struct of the numbers of currency, percentage, period and plain-number patterns."""
    return F.struct(
        sum((F.size(matches(text, p)) for p, _ in CURRENCY), F.lit(0)).alias("currency"), F.size(matches(text, PERCENTAGE)).alias("percentage"), F.size(matches(text, PERIOD)).alias("period"), F.size(matches(text, NUMBER)).alias("number")
    )


def content_type(text: Column, tables: Column, patterns: Column) -> Column:
    low = F.lower(text)
    return (
        F.when((tables >= 2) | (patterns >= 10), "financial").when(low.contains("pasal") | low.contains("ayat"), "legal").when(low.contains("langkah") | low.contains("prosedur"), "procedural").otherwise("general")
    )


def fix_ocr_words(text: Column) -> Column:
    for wrong, right in OCR_FIXES.items():
        text = F.regexp_replace(text, rf"(?i)\b{wrong}\b", right)
    return text


def clean_white_space(text: Column) -> Column:
    """Blank-line runs to one, blanks and tabs to one blank, lines trimmed of blanks."""
    text = F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?m)^ +| +$", "")


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_heading(line: Column) -> Column:
    return is_upper(line) & (F.length(line) < 80)


def is_title(text: Column) -> Column:
    """Every word begins with a capital and goes on in small letters (white space separates words)."""
    return (F.initcap(text) == text) & (F.lower(text) != text)


def likely_table_text(line: Column) -> Column:
    """Short, mostly signs and digits, or with a sign of tables."""
    t = F.trim(line)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    signs = F.lit(False)
    for s in TABLE_SIGNS:
        signs = signs | t.contains(s)
    return (F.length(t) < 10) | ((F.length(t) - letters) / F.greatest(F.length(t), F.lit(1)) > 0.7) | signs


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def important_header(text: Column, height: Column, width: Column, page_width: Column) -> Column:
    """Whether text at a page's edge is content: ordered rules, the first that applies decides."""
    n, words = F.length(text), word_count(text)
    return (
        F.when((n < 5) & text.rlike(r"^\d+$"), False)
        .when(n > 100, True)
        .when(height > 15, True)
        .when((page_width > 0) & (width / page_width > 0.5), True)
        .when((words >= 3) & text.rlike(r"[.,;:!?]"), True)
        .when(text.rlike(r"\p{Ll}") & text.rlike(r"\p{Lu}") & (words >= 2), True)
        .when(text.rlike(r"\d") & text.rlike(r"\p{L}") & (words >= 2), True)
        .otherwise(n > 20)
    )


def snippet_300(text: Column) -> Column:
    """Up to 300 characters, cut back to the last blank, with an ellipsis."""
    t = F.trim(text)
    return F.when(F.length(t) <= 300, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, 300), " [^ ]*$", ""), F.lit("…")))


def snippet_400(text: Column) -> Column:
    """Up to 400 characters, cut back to the last blank if that keeps over four fifths, with three dots."""
    head = F.substring(text, 1, 400)
    last = F.when(F.locate(" ", F.reverse(head)) > 0, F.lit(400) - F.locate(" ", F.reverse(head))).otherwise(F.lit(-1))
    return F.when(F.length(text) <= 400, text).otherwise(F.concat(F.when(last > 320, F.substr(head, F.lit(1), last)).otherwise(head), F.lit("...")))


def content_id(text: Column, n: int = 12) -> Column:
    return F.substring(F.md5(text), 1, n)


def safe_name(name: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|]+', "_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("document"))


def fingerprint(text: Column) -> Column:
    """What near-duplicate removal compares: the first 200 characters, lower case, white space collapsed."""
    return F.regexp_replace(F.trim(F.lower(F.substring(text, 1, 200))), r"\s+", " ")


def token_estimate(text: Column) -> Column:
    """One token for four characters; one at least, none for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags to blanks, common entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))

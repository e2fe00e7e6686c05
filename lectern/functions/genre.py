"""The genre of a book by counted terms, with what follows from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X


@dataclass(frozen=True)
class Terms:
    business: tuple[str, ...]
    fiction: tuple[str, ...]


# The Vietnamese terms; where dialogue is marked; what makes a number technical.
VIETNAMESE = Terms(
    business=("kinh doanh", "doanh nghiệp", "quản trị", "chiến lược", "khách hàng", "thị trường", "lợi nhuận", "doanh thu", "marketing", "đầu tư"),
    fiction=("cô ấy", "anh ấy", "nhân vật", "căn phòng", "mỉm cười", "thì thầm", "hét lên", "nước mắt", "trái tim", "bóng tối"),
)
DIALOGUE = "(^|\n)[ \t]*[–—-][ \t]+|[“\"]"
TECHNICAL = r"\b[0-9]+([.,][0-9]+)?[ \t]*(%|(kg|km|usd|vnd|triệu|tỷ)\b)"
# What the three genres are called and want.
GENRES = [("BUSINESS", "GENERAL_BUSINESS", "BUSINESS_CLEAR", "clear,authoritative,practical"), ("FICTION", "GENERAL_FICTION", "STORY_NARRATIVE", "narrative,expressive,warm"), ("GENERAL", "UNCLASSIFIED", "GENERAL_CLEAR", "clear,neutral")]
#: Our own, for the languages of the driver's tables and their invented prose.
EUROPEAN = Terms(
    business=("license", "version", "rights reserved", "terms of use", "privacy", "copyright", "policy", "software", "conditions", "public license"),
    fiction=(" she ", " he ", " was ", " sie ", " war ", " elle ", " il ", " ella ", " él ", " era "),
)


def classify(df: DataFrame, text: str, terms: Terms) -> DataFrame:
    """`df` with genre, subgenre, profile, tone, confidence, dialogue_density, technical_density and evidence (the four counts)."""
    low = F.lower(text)
    count = lambda words: sum((X.occurrences(F.col("_low"), w) for w in words[1:]), X.occurrences(F.col("_low"), words[0]))
    d = df.withColumn("_low", low).withColumns({"_b": count(terms.business), "_f": count(terms.fiction), "_q": F.regexp_count(text, F.lit(DIALOGUE)), "_t": F.regexp_count("_low", F.lit(TECHNICAL))})
    business = F.col("_b") >= F.greatest(F.lit(2), F.col("_f") + 1)
    fiction = (F.col("_f") >= 2) | (F.col("_q") >= 4)
    of = lambda k: F.when(business, GENRES[0][k]).when(fiction, GENRES[1][k]).otherwise(GENRES[2][k])
    capped = lambda per, n: F.least(F.lit(0.9), 0.62 + per * n)
    dense = lambda n: F.when(n >= 8, "high").when(n >= 3, "medium").otherwise("low")
    out = d.withColumns({
        "genre": of(0), "subgenre": of(1), "profile": of(2), "tone": F.split(of(3), ","),
        "confidence": F.round(F.when(business, capped(0.04, F.col("_b"))).when(fiction, capped(0.03, F.greatest("_f", "_q"))).otherwise(0.55), 4),
        "dialogue_density": dense(F.col("_q")), "technical_density": dense(F.col("_t")),
        "evidence": F.array(*(F.concat(F.lit(name + "="), F.col(c).cast("string")) for name, c in (("business_hits", "_b"), ("fiction_hits", "_f"), ("dialogue_marks", "_q"), ("technical_hits", "_t")))),
    })
    return out.drop("_low", "_b", "_f", "_q", "_t")


def classify_sql(source: str, key: str, terms: Terms) -> str:
    """The same for SQL over `source` (key, text)."""
    count = lambda words: " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in words)
    business, fiction = "b >= greatest(2, f + 1)", "(f >= 2 OR q >= 4)"
    of = lambda k: f"CASE WHEN {business} THEN '{GENRES[0][k]}' WHEN {fiction} THEN '{GENRES[1][k]}' ELSE '{GENRES[2][k]}' END"
    dense = lambda c: f"CASE WHEN {c} >= 8 THEN 'high' WHEN {c} >= 3 THEN 'medium' ELSE 'low' END"
    return f"""WITH l AS (SELECT {key}, text, lower(text) AS low FROM {source}),
    h AS (SELECT {key}, {count(terms.business)} AS b, {count(terms.fiction)} AS f, len(regexp_extract_all(text, '{DIALOGUE}')) AS q, len(regexp_extract_all(low, '{TECHNICAL}')) AS t FROM l)
    SELECT {key}, {of(0)} AS genre, {of(1)} AS subgenre, {of(2)} AS profile, {of(3)} AS tone, round(CASE WHEN {business} THEN least(0.9, 0.62 + 0.04 * b) WHEN {fiction} THEN least(0.9, 0.62 + 0.03 * greatest(f, q)) ELSE 0.55 END, 4) AS confidence,
      {dense('q')} AS dialogue_density, {dense('t')} AS technical_density, 'business_hits=' || b || ',fiction_hits=' || f || ',dialogue_marks=' || q || ',technical_hits=' || t AS evidence FROM h"""


# What a page's element is by its name, and the formats that a tab can stand for.
ELEMENT_KEYS = {
    "vi": "language_selector", "tự động": "voice_selector", "tạo giọng nói": "generate_button", "tạo giọng": "generate_button", "generate": "generate_button", "cài đặt": "settings_tab", "lịch sử": "history_tab",
    "đang tắt": "pause_selector", "thêm người nói": "add_speaker", "nhập kịch bản": "import_script", "phụ đề thành giọng nói": "subtitle_to_voice", "chat với trợ lý": "assistant_chat",
}
FORMATS = ("wav", "mp3", "flac", "ogg")


def element_key(name: Column, role: Column, editable: Column, value_now: Column) -> Column:
    """What an element is, by what it says of itself, the most telling first; null if nothing is known."""
    n = X.casefold(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))
    known = F.create_map(*(F.lit(x) for pair in ELEMENT_KEYS.items() for x in pair))
    return (
        F.when(F.coalesce(editable, F.lit(False)) | F.coalesce(role == "textbox", F.lit(False)), "script_editor")
        .when((role == "tab") & n.isin(*FORMATS), F.concat(F.lit("format_"), n))
        .when((role == "slider") | value_now.isNotNull(), "slider_unresolved")
        .when(n.startswith("đăng nhập") | n.isin("login", "sign in"), "login")
        .otherwise(F.try_element_at(known, n))
    )

"""Delivery of a reading unit: its class by cues, the class's policy, and the pause behind it. Columns for Spark, and the same for SQL.

Classes are tried in a fixed order: resolution, transition, dialogue (tense, else tender), tension, reflection, warmth, narrative. What
counts as a cue is a table of data. Text and cues are compared case-folded and in NFC (a text in another form goes through
`text.nfc` first), either as whole words or, as the Vietnamese table wants it, anywhere in the text."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

# Delivery policy by class: pause before and after in ms, emphasis, energy. The tempo factor is 1 in all.
POLICIES = [
    ("NARRATIVE", 120, 650, "natural", "medium"),
    ("REFLECTIVE_SAD", 220, 1050, "soft", "low"),
    ("TENSION", 100, 500, "focused", "medium_high"),
    ("DIALOGUE_TENDER", 220, 950, "intimate", "low_medium"),
    ("DIALOGUE_TENSION", 140, 650, "firm", "medium_high"),
    ("WARM_RELIEF", 160, 850, "warm", "medium"),
    ("SCENE_TRANSITION", 450, 1350, "reset", "low_medium"),
    ("RESOLUTION", 350, 1500, "warm_reflective", "low_medium"),
]
# Confidence of each class; of tender dialogue without a further cue; of a class that was given.
CONFIDENCE = {"RESOLUTION": 0.92, "SCENE_TRANSITION": 0.90, "DIALOGUE_TENSION": 0.90, "DIALOGUE_TENDER": 0.90, "TENSION": 0.88, "REFLECTIVE_SAD": 0.84, "WARM_RELIEF": 0.84, "NARRATIVE": 0.60}
PLAIN_DIALOGUE, GIVEN = 0.72, 1.0
# Pause behind a unit in ms by its last mark, then what its class adds; TENSION takes TENSION_LESS off, down to LEAST.
MARK_PAUSES = [(("…", "..."), 800), (("?",), 650), (("!",), 550), ((".", "”", '"'), 450), ((",", ";", ":"), 300)]
OTHER_PAUSE, LEAST_PAUSE, MOST_PAUSE, TENSION_LESS = 380, 280, 1500, 80
CLASS_PAUSES = {"REFLECTIVE_SAD": 180, "DIALOGUE_TENDER": 180, "SCENE_TRANSITION": 350, "RESOLUTION": 450}


@dataclass(frozen=True)
class Cues:
    """Cues by kind, in lower case. `firm` and `tender` decide dialogues only and aren't told."""

    resolution: tuple[str, ...]
    transition: tuple[str, ...]
    tension: tuple[str, ...]
    reflective: tuple[str, ...]
    warm: tuple[str, ...]
    firm: tuple[str, ...] = ()
    tender: tuple[str, ...] = ()
    whole_words: bool = True

    def kinds(self) -> dict[str, tuple[str, ...]]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "whole_words"}


# The Vietnamese cues, which may stand inside a word.
VIETNAMESE = Cues(
    resolution=("giao thừa", "ở lại thêm", "vẫn chờ mình trở về", "đủ để người đi xa"),
    transition=("đêm đó", "sáng hôm sau", "chiều ba mươi", "khi đồng hồ", "gần nửa đêm"),
    tension=("bất ngờ", "dồn dập", "giật mình", "mất điện", "đập vào", "thở hổn hển", "sợ", "run", "siết chặt", "cao hơn bình thường"),
    reflective=("nhớ", "cha mất", "nghẹn", "giận", "xa cách", "yếu", "mắt đỏ", "không khóc", "cúi mặt", "ký ức", "nỗi sợ"),
    warm=("bật cười", "mỉm cười", "ánh nắng", "nhẹ dần", "vui", "ở lại", "trở về", "sáng", "nhớ nhà"),
    firm=("sao mẹ", "thương hại", "không nói"),
    tender=("mẹ ơi", "con về", "nhớ nhà"),
    whole_words=False,
)
#: Our own, in the languages of the driver's tables.
EUROPEAN = Cues(
    resolution=("in the end", "finally", "at last", "am ende", "schließlich", "enfin", "finalement", "al fin", "por fin"),
    transition=("the next day", "years later", "meanwhile", "am nächsten tag", "inzwischen", "le lendemain", "pendant ce temps", "al día siguiente", "mientras tanto"),
    tension=("suddenly", "scream", "danger", "blood", "plötzlich", "gefahr", "soudain", "peur", "de repente", "peligro"),
    reflective=("alone", "tears", "remember", "grief", "allein", "tränen", "ernst", "seule", "larmes", "lágrimas", "recuerdo"),
    warm=("smile", "love", "together", "warm", "lächeln", "liebe", "sourire", "amour", "sonrisa", "juntos"),
    firm=("never", "nie", "jamais", "nunca"),
    tender=("dear", "lieber", "chère", "querida"),
)
#: Short words of the tables' invented prose, so that queries over it meet every class.
COMMON = Cues(
    resolution=("with it", "mit dem", "avec le", "con el"), transition=("for the", "von der", "pour la", "por el"), tension=("that", "nicht", "pas", "no"),
    reflective=("was", "ich", "est", "es"), warm=("you", "sie", "vous", "se"), firm=("not",), tender=("is",),
)


def searched(folded: Column, cues: Cues) -> Column:
    """A case-folded text as its cues are looked for; keep it as a column of its own, as every cue reads it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " ")), F.lit(" ")) if cues.whole_words else folded


def _sought(cue: str, cues: Cues) -> str:
    return f" {cue.casefold()} " if cues.whole_words else cue.casefold()


def has_any(searched: Column, kind: tuple[str, ...], cues: Cues) -> Column:
    out = F.lit(False)
    for c in kind:
        out = out | F.contains(searched, F.lit(_sought(c, cues)))
    return out


_DIALOGUE = ("“", "”", '"')


def is_calm(text: Column, searched: Column, cues: Cues) -> Column:
    """Neither dialogue nor any cue: the class NARRATIVE."""
    spoken = F.lit(False)
    for mark in _DIALOGUE:
        spoken = spoken | F.contains(text, F.lit(mark))
    return ~(spoken | has_any(searched, tuple(c for k, v in cues.kinds().items() if k not in ("firm", "tender") for c in v), cues))


def with_beat(df: DataFrame, text: str, cues: Cues, given: str | None = None) -> DataFrame:
    """`df` with beat, cues (kind:cue, in order) and confidence. `given`: a column with a class that is taken as it is, in any case; one
    that doesn't exist fails the query."""
    out = df.withColumn("_searched", searched(X.casefold(F.col(text)), cues))
    hits = {k: F.array_compact(F.array(*(F.when(F.contains("_searched", F.lit(_sought(c, cues))), F.lit(c)) for c in v))) for k, v in cues.kinds().items()}
    out = out.withColumns({f"_{k}": h for k, h in hits.items()})
    has = lambda *kinds: sum((F.size(f"_{k}") for k in kinds), F.lit(0)) > 0
    named = lambda *kinds: F.concat(*map(_prefixed, kinds))
    dialogue = F.col(text).rlike("[“”\"]")
    talk = F.array(F.lit("dialogue"))
    cascade = [
        (has("resolution"), "RESOLUTION", named("resolution"), CONFIDENCE["RESOLUTION"]),
        (has("transition"), "SCENE_TRANSITION", named("transition", "tension"), CONFIDENCE["SCENE_TRANSITION"]),
        (dialogue & has("tension", "firm"), "DIALOGUE_TENSION", F.concat(talk, named("tension")), CONFIDENCE["DIALOGUE_TENSION"]),
        (dialogue & has("reflective", "warm", "tender"), "DIALOGUE_TENDER", F.concat(talk, named("reflective", "warm")), CONFIDENCE["DIALOGUE_TENDER"]),
        (dialogue, "DIALOGUE_TENDER", talk, PLAIN_DIALOGUE),
        (has("tension"), "TENSION", named("tension"), CONFIDENCE["TENSION"]),
        (has("reflective"), "REFLECTIVE_SAD", named("reflective"), CONFIDENCE["REFLECTIVE_SAD"]),
        (has("warm"), "WARM_RELIEF", named("warm"), CONFIDENCE["WARM_RELIEF"]),
    ]
    beat, found, sure = F.lit("NARRATIVE"), F.array(F.lit("default_narrative")), F.lit(CONFIDENCE["NARRATIVE"])
    for when, name, names, confidence in reversed(cascade):
        beat, found, sure = F.when(when, name).otherwise(beat), F.when(when, names).otherwise(found), F.when(when, confidence).otherwise(sure)
    if given is not None:
        asked, known = F.upper(F.trim(given)), [p[0] for p in POLICIES]
        checked = F.when(asked.isin(known), asked).otherwise(F.raise_error(F.concat(F.lit("unsupported beat: "), asked)))
        is_given = F.col(given).isNotNull()
        beat, found, sure = F.when(is_given, checked).otherwise(beat), F.when(is_given, F.array(F.lit("explicit_beat"))).otherwise(found), F.when(is_given, GIVEN).otherwise(sure)
    return out.withColumns({"beat": beat, "cues": found, "confidence": sure}).drop("_searched", *(f"_{k}" for k in hits))


def _prefixed(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda x: F.concat(F.lit(f"{kind}:"), x))


def pause_after(text: Column, beat: Column) -> Column:
    """Pause behind a unit in ms."""
    end = F.rtrim(F.regexp_replace(text, r"\s+$", ""))
    base = F.lit(OTHER_PAUSE)
    for marks, ms in reversed(MARK_PAUSES):
        closes = F.lit(False)
        for m in marks:
            closes = closes | end.endswith(m)
        base = F.when(closes, ms).otherwise(base)
    pause = F.when(beat == "TENSION", F.greatest(F.lit(LEAST_PAUSE), base - TENSION_LESS))
    for name, more in CLASS_PAUSES.items():
        pause = pause.when(beat == name, base + more)
    return F.least(F.lit(MOST_PAUSE), pause.otherwise(base))


def shaped(text: Column, beat: Column) -> Column:
    """The unit as it is said: marks alone change, and only as the class wants it."""
    t = F.btrim(text, F.lit(" \t\r\n"))
    soft = F.when(t.endswith("."), F.concat(F.rtrim(F.substring(t, F.lit(1), F.length(t) - 1)), F.lit("…"))).otherwise(t)
    comma = F.instr(t, ",")
    reset = F.when(comma > 1, F.concat(F.substring(t, F.lit(1), comma - 1), F.lit("…"), F.substring(t, comma + 1, F.length(t)))).otherwise(t)
    return F.when(beat.isin("REFLECTIVE_SAD", "DIALOGUE_TENDER", "RESOLUTION"), soft).when(beat == "SCENE_TRANSITION", reset).when(beat == "TENSION", F.regexp_replace(t, r"\.{3,}", "…")).otherwise(t)


def phrase_hits(folded: Column, phrases: list[str]) -> Column:
    """The phrases that stand in a case-folded text, in NFC, each once, in order. `folded` should be a column of its own."""
    own = list(dict.fromkeys(p for p in (X.in_nfc(x).strip() for x in phrases) if p))
    found = [F.when(F.contains(folded, F.lit(p.casefold())), F.lit(p)) for p in own]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


# The same for SQL. `t` is the text's name, `s` that of the searched text.


def searched_sql(t: str, cues: Cues) -> str:
    return f"' ' || trim(regexp_replace(replace(lower({t}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' '" if cues.whole_words else f"replace(lower({t}), 'ß', 'ss')"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def hits_sql(s: str, kind: str, cues: Cues, prefix: bool = True) -> str:
    own = cues.kinds()[kind]
    pairs = ", ".join(f"CASE WHEN contains({s}, '{_sought(c, cues)}') THEN '{kind + ':' if prefix else ''}{c}' END" for c in own)
    return f"list_filter([{pairs}], lambda x: x IS NOT NULL)"


def any_sql(s: str, kinds: list[str], cues: Cues) -> str:
    return "(" + " OR ".join(f"contains({s}, '{_sought(c, cues)}')" for k in kinds for c in cues.kinds()[k]) + ")"


def beat_sql(t: str, s: str, cues: Cues) -> str:
    """A struct of beat, cues and confidence."""
    has = lambda *kinds: any_sql(s, list(kinds), cues)
    told = lambda *kinds: " || ".join(hits_sql(s, k, cues) for k in kinds)
    talk = f"regexp_matches({t}, '[“”\"]')"
    of = lambda beat, names, confidence: f"struct_pack(beat := '{beat}', cues := {names}, confidence := CAST({confidence} AS DOUBLE))"
    return f"""CASE WHEN {has('resolution')} THEN {of('RESOLUTION', told('resolution'), 0.92)} WHEN {has('transition')} THEN {of('SCENE_TRANSITION', told('transition', 'tension'), 0.90)}
      WHEN {talk} AND {has('tension', 'firm')} THEN {of('DIALOGUE_TENSION', "['dialogue'] || " + told('tension'), 0.90)} WHEN {talk} AND {has('reflective', 'warm', 'tender')} THEN {of('DIALOGUE_TENDER', "['dialogue'] || " + told('reflective', 'warm'), 0.90)}
      WHEN {talk} THEN {of('DIALOGUE_TENDER', "['dialogue']", 0.72)} WHEN {has('tension')} THEN {of('TENSION', told('tension'), 0.88)} WHEN {has('reflective')} THEN {of('REFLECTIVE_SAD', told('reflective'), 0.84)}
      WHEN {has('warm')} THEN {of('WARM_RELIEF', told('warm'), 0.84)} ELSE {of('NARRATIVE', "['default_narrative']", 0.60)} END"""


def pause_sql(t: str, beat: str) -> str:
    base = f"CASE WHEN {t} LIKE '%…' OR {t} LIKE '%...' THEN 800 WHEN {t} LIKE '%?' THEN 650 WHEN {t} LIKE '%!' THEN 550 WHEN right({t}, 1) IN ('.', '”', '\"') THEN 450 WHEN right({t}, 1) IN (',', ';', ':') THEN 300 ELSE 380 END"
    return f"CAST(least(1500, CASE {beat} WHEN 'TENSION' THEN greatest(280, {base} - 80) WHEN 'RESOLUTION' THEN {base} + 450 WHEN 'REFLECTIVE_SAD' THEN {base} + 180 WHEN 'DIALOGUE_TENDER' THEN {base} + 180 WHEN 'SCENE_TRANSITION' THEN {base} + 350 ELSE {base} END) AS INT)"

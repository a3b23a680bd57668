"""Scripts and languages of a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters looked at, and the share of Hangul that makes a text Korean.
SAMPLE_CHARS = 4000
KOREAN_SHARE = 0.30

# The character ranges of each script.
SCRIPTS = {
    "hangul": "가-힣",
    "kana": "ぁ-んァ-ヶー",
    "han": "一-鿿㐀-䶿",
    "cyrillic": "Ѐ-ӿ",
    "greek": "Ͱ-Ͽἀ-῿",
    "hebrew": "֐-׿",
    "arabic": "؀-ۿ",
    "latin": "A-Za-zÀ-ÿĀ-ž",
}
#: Languages with one script of their own, in the order in which they are tried.
ONE_SCRIPT = [("cyrillic", "ru"), ("greek", "el"), ("hebrew", "he"), ("arabic", "ar")]
OWN_SCRIPTS = {"ko": ["hangul"], "ja": ["kana", "han"], "zh": ["han"], "ru": ["cyrillic"], "el": ["greek"], "he": ["hebrew"], "ar": ["arabic"]}

# Common function words of each language in Latin script, from general knowledge; earlier languages win ties.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with as by on are this be from at which have or an not but",
    "de": "der die das und ist nicht von zu den mit sich des auf für als im auch ein eine dem wird aus nach bei",
    "nl": "de het een en van ik te dat die niet zijn met voor op aan er maar om ook als bij nog naar uit",
    "fr": "le la les de des et est un une que qui dans pour sur pas par au aux avec ne se son ce plus",
    "es": "el la los las de del que y en un una es se por con para no su al lo como más pero sus",
    "it": "il la di che e un una è per non con si da del della le dei i come più sono ma gli nel",
    "pt": "o a de que e do da em um para é com não uma os no se na por mais as dos como mas",
    "la": "et in est non ad ut cum qui quod quae sed si per esse sunt ex hoc enim autem atque nec etiam quam ab",
}
# Letters that belong to one of these languages far more than to the others.
LETTER_HINTS = {"de": "ßäöü", "es": "ñ¿¡", "pt": "ãõ", "fr": "çœèùêâ", "it": "àòùì", "nl": "ĳ"}
MOST_BONUS = 0.05
LEAST_WORDS = 12


def count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` in the class ``chars``."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def script_counts(text: Column) -> dict[str, Column]:
    return {name: count_of(text, chars) for name, chars in SCRIPTS.items()}


def _among(listed: list[str]):
    return lambda w: w.isin(listed)


def latin_scores(low: Column, words: Column) -> Column:
    """array<struct<score, rank, code>> for lower-case text and its words; a lower rank is the earlier language."""
    n = F.size(words)
    scored = []
    for at, (code, listed) in enumerate(FUNCTION_WORDS.items()):
        hits = F.size(F.filter(words, _among(listed.split())))
        bonus = count_of(low, LETTER_HINTS[code]) / n if code in LETTER_HINTS else F.lit(0.0)
        scored.append(F.struct((hits / n + F.least(bonus, F.lit(MOST_BONUS))).alias("score"), F.lit(-at).alias("rank"), F.lit(code).alias("code")))
    return F.array(*scored)


def detected(counts: dict[str, Column], latin: Column) -> Column:
    """The language by scripts, or ``latin`` where Latin letters prevail; '' without evidence."""
    letters = sum(counts.values(), F.lit(0))
    cjk = counts["kana"] + counts["han"]
    out = F.when(letters == 0, "").when(counts["hangul"] / letters >= KOREAN_SHARE, "ko")
    japanese = counts["kana"] >= F.greatest(F.lit(8.0), cjk * 0.05)
    out = out.when((cjk / letters >= 0.30) & japanese, "ja").when(cjk / letters >= 0.30, "zh")
    for script, code in ONE_SCRIPT:
        out = out.when(counts[script] / letters >= 0.50, code)
    return out.when(counts["latin"] / letters >= 0.50, latin).otherwise("")


def own_share(counts: dict[str, Column], code: str) -> Column:
    """Share of the letters that a language writes."""
    letters = sum(counts.values(), F.lit(0))
    mine = sum((counts[s] for s in OWN_SCRIPTS.get(code, ["latin"])), F.lit(0))
    return F.when(letters > 0, mine / letters).otherwise(0.0)

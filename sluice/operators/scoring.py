"""Scores of raw postings: closed lists of places, bands of roles and pay, named skills, language, vetoes.

All is one projection of built-in functions over the posting's own columns: no join, no shuffle,
no Python. Lists are small literals; each text is brought into plain form once.

What the rules leave open is fixed here, and is a parameter where it is a matter of taste: a role scores the
middle of its band, other roles 4; skills score the held share of those that the text names, 5 if it names none;
a place on no list is C, or VETO if ``commute_minutes`` says over 60; a remote posting is at least B+ whatever
its place; of several places the best counts. No cut-off between the two verdicts above DESCARTAR is stated
anywhere, so the verdict is DESCARTAR on a veto and else the posting's own ``verdict``, if it has one.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls
from .ranking import pay_score, weighted_score

#: Latin letters with a mark, and the plain ones.
_MARKED, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçý", "aaaaaaeeeeiiiiooooouuuuncy"
#: Names that the listed places have in their own country.
OWN_NAMES = {
    "A": ("Napoli", "Genova", "Venezia", "Messina", "Taranto", "Ravenna"),
    "B": ("Alacant", "A Coruña", "Palma de Mallorca", "Santa Cruz de Tenerife", "Jerez de la Frontera", "Donostia", "Castelló"),
    "VETO": ("Milano", "Milan", "Torino", "Turin", "Rome"),
}
REMOTE = ("remote", "remoto", "da remoto", "en remoto", "teletrabajo", "telelavoro", "smart working")
OBLIGED = ("required", "requires", "mandatory", "must", "obbligatorio", "obbligatoria", "richiesto", "richiesta", "obligatorio", "obligatoria", "imprescindible", "requerido", "requerida", "excluyente")
ENGLISH = ("english", "ingles", "inglese")
INTERNATIONAL = ("emea", "eu wide", "english is our working language")
LOW_ROLES = ("junior", "developer", "sviluppatore", "desarrollador", "sales", "commerciale", "comercial")


@dataclass(frozen=True)
class Profile:
    """Who the postings are scored for: skills (name, whether held), words of sectors, worth of languages."""

    skills: dict[str, bool]
    sectors: dict[str, tuple[str, ...]]
    sector_scores: dict[str, float] = field(default_factory=lambda: {"marine": 10.0, "industry": 8.0})
    languages: dict[str, float] = field(default_factory=lambda: {"it": 10.0, "es": 10.0, "en": 8.0})
    exclusive_years: int = 5


def plain(text: Column) -> Column:
    """Words in lower case without marks, one blank around each, a bar where a sentence or line ends; null is empty.

    Both composed and combining marks go. Words hold letters, digits, ``+`` and ``#``.
    """
    bare = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}", ""), _MARKED, _PLAIN)
    ends = F.regexp_replace(bare, r"[.!?;|\n]+", " | ")
    return F.concat(F.lit(" "), F.regexp_replace(ends, r"[^\p{L}\p{N}+#|]+", " "), F.lit(" "))


def _phrase(text: str) -> str:
    """A list's phrase in the plain form of texts."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[.!?;|\n]+", " | ", re.sub(r"[^\w.!?;|\n+#]+|_", " ", bare)).split())


def names(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a plain text holds one of the phrases as whole words.

    A few are searched for one by one, which is fastest on long texts; for more one pattern keeps the code small.
    """
    if len(phrases) > 6:
        return text.rlike(f" (?:{'|'.join(re.escape(_phrase(p)) for p in phrases)}) ")
    return reduce(lambda a, b: a | b, [text.contains(f" {_phrase(p)} ") for p in phrases], F.lit(False))


def in_a_sentence(text: Column, *phrases: tuple[str, ...]) -> Column:
    """Whether one sentence of a plain text names a phrase of each list; texts without one of the first aren't cut up."""
    return names(text, phrases[0]) & F.exists(F.split(text, r"\|"), lambda s: reduce(lambda a, b: a & b, [names(s, p) for p in phrases]))


def place_tier(place: Column, remote: Column, commute: Column | None = None) -> Column:
    """The tier of a plain place: the best that applies, null if it names none and the posting isn't remote."""
    listed = {t: (*fixed.PLACES[t], *OWN_NAMES.get(t, ())) for t in fixed.PLACES}
    away = F.coalesce(remote, F.lit(False)) | names(place, REMOTE)
    tier = F.when(names(place, listed["A+"]), "A+").when(names(place, listed["A"]), "A").when(away, "B+").when(names(place, listed["B"]), "B")
    far = F.lit(False) if commute is None else F.coalesce(commute > 60, F.lit(False))
    nearby = F.when(names(place, listed["C"]), F.when(far, "VETO").otherwise("C"))
    return F.coalesce(tier, nearby, F.when(names(place, listed["VETO"]) | far, "VETO"), F.when(F.trim(F.regexp_replace(place, r"\|", "")) != "", "C"))


def role_score(title: Column) -> Column:
    """The middle of the first band that names the role; junior and other low roles 4, and so are those of no band."""
    out = F.when(names(title, LOW_ROLES), 4.0)
    for low, high, roles in fixed.ROLE_BANDS:
        out = out.when(names(title, roles), (low + high) / 2)
    return out.otherwise(4.0)


def yearly_pay(salary: Column) -> Column:
    """The lowest amount that a pay text states, in thousands a year; null if it states none.

    Amounts are whole numbers, with blanks, points or commas between thousands, or followed by k. Those below five
    thousand (rates of an hour, a day or a month, years) and of ten million and more are no yearly pay.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(salary, F.lit(""))), F.lit(r"([0-9]{1,3}(?:[., ][0-9]{3})+|[0-9]+)(?:[.,][0-9]{1,2})?( ?k)?"), F.lit(0))

    def amount(s: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(s, "( ?k)$|[.,][0-9]{1,2}( ?k)?$", ""), "[^0-9]", "")
        whole = F.when(F.length(digits) <= 7, digits.cast("double"))
        return F.when(s.endswith("k"), whole).otherwise(whole / 1000)

    fit = F.filter(F.transform(found, amount), lambda x: (x >= 5) & (x < 10_000))
    return F.array_min(fit)


def scored(postings: DataFrame, profile: Profile) -> DataFrame:
    """``postings`` (title, company, location, remote, salary, description, language, portal, email_contacto, url) with their scores.

    Added: tier, the six sub-scores (null tier: location 5), sector, sector_bonus, penalty, score (0 to 10, one decimal),
    gaps (skills that the text names and the profile lacks), vetoes (codes), notes, verdict. Optional columns:
    ``commute_minutes``, ``verdict``. Nulls are empty texts and false flags. Columns that begin with ``_score_`` are taken.
    """
    col = lambda n, kind="string": F.col(n) if n in postings.columns else F.lit(None).cast(kind)
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    out = postings.withColumns({"_score_text": plain(F.col("description")), "_score_title": plain(F.col("title")), "_score_place": plain(F.col("location")), "_score_by": plain(F.col("company")), "_score_pay": yearly_pay(F.col("salary"))})
    text, title, place, by = (F.col(f"_score_{c}") for c in ("text", "title", "place", "by"))
    tier = place_tier(place, F.col("remote"), col("commute_minutes", "int") if "commute_minutes" in postings.columns else None)
    named = F.array_compact(F.array(*[F.when(names(text, (s,)), s) for s in profile.skills]))
    sector = F.coalesce(*[F.when(names(by, w) | names(text, w), s) for s, w in profile.sectors.items()], F.lit(None).cast("string"))
    language = F.lower(F.col("language"))
    asks = in_a_sentence(text, ENGLISH, (*OBLIGED, "c1", "c2"))
    exempt = asks | names(text, INTERNATIONAL) | F.coalesce(F.lower(F.col("portal")).isin(*fixed.ENGLISH_PORTALS), F.lit(False))
    out = out.withColumns({"tier": tier, "_score_named": named, "sector": sector, "penalty": F.coalesce(language == "en", F.lit(False)) & ~exempt})
    known = F.array(*[F.lit(s) for s, held in profile.skills.items() if held]).cast("array<string>")
    out = out.withColumn("gaps", F.array_except("_score_named", known))
    worth = lambda c, table, other: reduce(lambda a, kv: a.when(c == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(other)
    n = F.size("_score_named")
    out = out.withColumns({
        "location_score": worth(F.col("tier"), fixed.PLACE_SCORES, 5.0), "role_score": role_score(title),
        "skills_score": F.when(n > 0, 10.0 * (n - F.size("gaps")) / n).otherwise(5.0), "sector_score": worth(F.col("sector"), profile.sector_scores, 5.0),
        "pay_score": pay_score(F.col("_score_pay")), "language_score": worth(language, profile.languages, 5.0), "sector_bonus": worth(F.col("sector"), fixed.SECTOR_BONUS, 0.0),
    })
    parts = {k: F.col(f"{k}_score") for k in fixed.WEIGHTS}
    lacked = tuple(s for s, held in profile.skills.items() if not held)
    years = lambda s: F.coalesce(F.regexp_extract(s, r" ([0-9]{1,2})\+? (?:years|anni|anos) ", 1).try_cast("int"), F.lit(0))
    rules = {
        "place": F.col("tier") == "VETO",
        "degree": in_a_sentence(text, ("laurea", "degree", "titulo"), ("ingegneria", "engineering", "ingenieria"), OBLIGED),
        "grade": names(text, ("110/110", "con lode", "votazione minima")),
        "certificate": in_a_sentence(text, fixed.CERTIFICATES, OBLIGED),
        "years": names(text, ("years", "anni", "anos")) & names(text, lacked) & F.exists(F.split(text, r"\|"), lambda s: (years(s) > profile.exclusive_years) & names(s, lacked)),
        "native_language": names(text, ("madrelingua",)) & F.coalesce(language != "it", F.lit(True)),
    }
    email, hostile = has(col("email_contacto")), F.coalesce(urls.hostile_host(F.col("url")), F.lit(False))
    notes = {"language": F.col("penalty"), "pay": F.col("_score_pay").isNull(), "email": email, "hostile": hostile}
    out = out.withColumns({
        "score": weighted_score(parts, F.col("sector_bonus"), F.col("penalty"), email),
        "vetoes": F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()])),
        "notes": F.array_compact(F.array(*[F.when(v, fixed.SCORE_NOTES[k]) for k, v in notes.items()])),
    })
    verdict = F.when(F.size("vetoes") > 0, fixed.VERDICTS[2]).otherwise(col("verdict"))
    return out.withColumn("verdict", verdict).drop(*[c for c in out.columns if c.startswith("_score_")])

"""Rule columns: bands, years, eligibility, gates, mail status, sandbox boards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from .text import any_of, around, cap, classify, evidence, first_start, has, let, matches, or_empty, strip


def posting_id(url: Column) -> Column:
    """The first 16 hex digits of the url's SHA-1."""
    return F.substring(F.sha1(F.encode(url, "UTF-8")), 1, 16)


def dedupe_key(company: Column, title: Column) -> Column:
    return F.struct(F.lower(strip(or_empty(company))).alias("company"), F.lower(strip(or_empty(title))).alias("title"))


def title_band(title: Column, rules=K.TITLE_BANDS) -> Column:
    """Band from the title's first marker in order of the rules; ``unknown`` without one."""
    return classify(title, rules, "unknown")


#: Upper-case strings of which every match of a pattern holds one (or all of a group): plain searches that spare most texts the pattern.
NEEDED = {
    "years": ("YEAR",),
    "clearance": ("CLEARANCE", ("/", "SCI"), "SECRET", "POLYGRAPH", "TRUST"),
    "citizenship": ("CITIZEN", "ITAR", ("EXPORT", "CONTROL"), ("PERSON", "MUST")),
    "no_sponsorship": ("SPONSOR", "VISA"),
    "sponsorship": ("SPONSOR", "H1B", "H-1B"),
}


#: The patterns with what each of their alternatives begins with said before: most places of a text then cost one look at a letter.
CLEARANCE = r"(?=[scatpqld])\b" + K.CLEARANCE
CITIZENSHIP = r"(?=[murcei])\b" + K.CITIZENSHIP
NO_SPONSORSHIP = r"(?=[nucdws])" + K.NO_SPONSORSHIP
YES_SPONSORSHIP = r"(?=[wdchaovs])" + K.YES_SPONSORSHIP
EDUCATION_NOISE = r"(?=[\dgcf])" + K.EDUCATION_NOISE


def may_hold(upper: Column, gate: str) -> Column:
    """Whether an upper-cased text holds what a match of the gate's pattern needs."""
    groups = (g if isinstance(g, tuple) else (g,) for g in NEEDED[gate])
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (upper.contains(x) for x in g)) for g in groups))


def min_years(description: Column) -> Column:
    """The smallest plausible number of years a description asks for, null without one."""

    def least(text: Column) -> Column:
        found = F.concat(*(F.regexp_extract_all(text, F.lit(K.FLAGS + p), F.lit(1)) for p in K.YEARS_PATTERNS))
        return F.array_min(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.between(0, K.MAX_YEARS)))

    text = F.regexp_replace(description, K.FLAGS + EDUCATION_NOISE, " ")
    return F.when(may_hold(F.upper(description), "years"), let(text, least))


def band_of_years(years: Column) -> Column:
    return F.when(years.isNull(), "unknown").when(years <= K.ENTRY_MAX_YEARS, "entry").when(years <= K.MID_MAX_YEARS, "mid").otherwise("senior")


def level(title: Column, description: Column, available: Column) -> Column:
    """``struct(level, source, evidence)``: a title marker wins, else the years of a description that exists."""
    nothing = F.struct(F.lit("unknown").alias("level"), F.lit("none").alias("source"), F.lit("").alias("evidence"))

    def by_years(years: Column) -> Column:
        asks = F.concat(years.cast("string"), F.when(years == 1, "+ year").otherwise("+ years"))
        return F.when(years.isNotNull(), F.struct(band_of_years(years).alias("level"), F.lit("years").alias("source"), asks.alias("evidence"))).otherwise(nothing)

    def decide(marked: Column) -> Column:
        by_title = F.struct(marked.alias("level"), F.lit("title").alias("source"), title.alias("evidence"))
        return F.when(marked != "unknown", by_title).otherwise(let(F.when(available, min_years(description)), by_years))

    return let(title_band(title), decide)


def explain_level(verdict: Column) -> Column:
    article = F.when(F.substring(verdict["level"], 1, 1).isin(*"aeiou"), "an").otherwise("a")
    return (
        F.when(verdict["source"] == "title", F.concat(F.lit("the title carries "), article, F.lit(" "), verdict["level"], F.lit(" marker")))
        .when(verdict["source"] == "years", F.concat(F.lit("the description asks for "), verdict["evidence"]))
        .otherwise("neither the title nor the description states a level")
    )


def level_confirmed(verdict: Column) -> Column:
    return verdict["source"] != "none"


def citizenship_evidence(description: Column, window: int = K.VETO_WINDOW) -> Column:
    """The first citizenship requirement without a phrase nearby that takes it back; empty without one.

    Mostly the first match decides; only where it is taken back are all matches listed.
    """
    vetoed = lambda start, text: has(around(description, start, F.length(text), window), K.CITIZENSHIP_VETO)
    binding = F.filter(matches(description, CITIZENSHIP), lambda m: ~vetoed(m["start"], m["text"]))
    later = or_empty(strip(F.get(binding, 0)["text"]))

    def decide(first: Column) -> Column:
        back = let(first_start(description, CITIZENSHIP), lambda start: vetoed(start, first))
        return F.when(first == "", "").when(back, later).otherwise(strip(first))

    return or_empty(let(F.regexp_extract(description, K.FLAGS + CITIZENSHIP, 0), decide))


def eligibility(description: Column, available: Column) -> Column:
    """``struct(clearance, citizenship, sponsorship, checked, evidence)``.

    Without a description nothing is checked, which is not the same as eligible. evidence is an array of
    ``struct(gate, quote)``; the citizenship quote is the bare match, the others carry their surroundings.
    """
    checked = available & (or_empty(description) != "")
    text = F.when(checked, description)

    def quotes(upper: Column) -> Column:
        look = lambda gate, c: F.when(may_hold(upper, gate), c).otherwise("").alias(gate)
        return F.struct(
            look("clearance", evidence(text, CLEARANCE)), look("citizenship", citizenship_evidence(text)),
            look("no_sponsorship", evidence(text, NO_SPONSORSHIP)), look("sponsorship", evidence(text, YES_SPONSORSHIP)),
        )

    def decide(q: Column) -> Column:
        refused, offered = q["no_sponsorship"] != "", q["sponsorship"] != ""
        stated = {"clearance": q["clearance"] != "", "citizenship": q["citizenship"] != "", "no_sponsorship": refused, "sponsorship": ~refused & offered}
        entries = [F.when(there, F.struct(F.lit(g).alias("gate"), q[g].alias("quote"))) for g, there in stated.items()]
        return F.struct(
            stated["clearance"].alias("clearance"),
            stated["citizenship"].alias("citizenship"),
            F.when(refused, "will_not_sponsor").when(offered, "will_sponsor").otherwise("unstated").alias("sponsorship"),
            checked.alias("checked"),
            F.array_compact(F.array(*entries)).alias("evidence"),
        )

    return let(let(F.upper(text), quotes), decide)


def quote_of(eligible: Column, gate: str) -> Column:
    return or_empty(F.get(F.filter(eligible["evidence"], lambda e: e["gate"] == gate), 0)["quote"])


def ineligible(eligible: Column) -> Column:
    return eligible["clearance"] | eligible["citizenship"] | (eligible["sponsorship"] == "will_not_sponsor")


def ineligible_reasons(eligible: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(eligible["clearance"], "security clearance required"),
            F.when(eligible["citizenship"], "US citizenship / ITAR restricted"),
            F.when(eligible["sponsorship"] == "will_not_sponsor", "employer states it will not sponsor"),
        )
    )


def in_role_family(title: Column, allow: str = K.ROLE_ALLOW, deny: str = K.ROLE_DENY) -> Column:
    """Title-only gate: a denied word beats an allowed one; an empty title is outside."""
    return has(title, allow) & ~has(title, deny)


def is_internship(title: Column, employment_type: Column) -> Column:
    kind = F.regexp_replace(F.lower(strip(or_empty(employment_type))), " ", "")
    return has(title, K.INTERNSHIP_TITLE) | kind.isin(*K.INTERNSHIP_TYPES)


def is_sandbox(tenant: Column) -> Column:
    slug = F.lower(strip(or_empty(tenant)))
    return slug.isin(*K.SANDBOX_TENANTS) | has(slug, K.SANDBOX_SLUG)


def wrong_band(band: Column, wanted: Sequence[str]) -> Column:
    """Unknown bands survive."""
    return (band != "unknown") & ~band.isin(*wanted)


def is_job_mail(sender: Column, subject: Column, senders=K.MAIL_SENDERS) -> Column:
    return any_of(F.lower(or_empty(sender)), senders) | has(subject, K.MAIL_SUBJECT)


def mail_status(sender: Column, subject: Column, snippet: Column, rules=K.MAIL_STATUS, senders=K.MAIL_SENDERS) -> Column:
    text = F.concat(or_empty(subject), F.lit(" "), or_empty(snippet))
    return F.when(is_job_mail(sender, subject, senders), classify(text, [(p, s) for s, p in rules], "other")).otherwise("other")


def needs_action(is_job: Column, status: Column) -> Column:
    return is_job & status.isin(*K.MAIL_NEEDS_ACTION)


def title_matches(title: Column, must: Sequence[str] = K.TITLE_MUST, block: Sequence[str] = K.TITLE_BLOCK) -> Column:
    """Substring gate on the lower-cased title: one of ``must`` (if any are given), none of ``block``."""
    t = F.lower(or_empty(title))
    return (any_of(t, must) if must else F.lit(True)) & ~any_of(t, block)


def keyword_score(title: Column, description: Column, weights: dict[str, int] = K.KEYWORDS) -> Column:
    text = F.lower(F.concat(or_empty(title), F.lit(" "), or_empty(description)))
    return F.least(F.lit(100), reduce(lambda a, b: a + b, (F.when(text.contains(k), w).otherwise(0) for k, w in weights.items()), F.lit(0)))


def gate_reason(gate: Column, title: Column, company: Column, employment_type: Column, verdict: Column, eligible: Column) -> Column:
    """The sentence for one failed gate."""
    quoted = lambda c: F.concat(F.lit("'"), or_empty(c), F.lit("'"))
    hit = F.regexp_substr(title, F.lit(K.FLAGS + K.INTERNSHIP_TITLE))
    by_title = F.concat(F.lit("internship, not full-time — "), quoted(hit), F.lit(" in the title"))
    by_type = F.concat(F.lit("internship, not full-time — employment type "), quoted(employment_type))
    return (
        F.when(gate == K.GATES[0], F.concat(F.lit("not a software engineering role: "), quoted(title)))
        .when(gate == K.GATES[1], F.concat(quoted(company), F.lit(" is an ATS vendor demo board, not an employer")))
        .when(gate == K.GATES[2], F.when(hit.isNotNull(), by_title).otherwise(by_type))
        .when(gate == K.GATES[3], F.concat(F.lit("seniority band is "), verdict["level"], F.lit(", not entry-level")))
        .when(gate == K.GATES[4], F.concat(F.lit("clearance required — "), quoted(quote_of(eligible, "clearance"))))
        .when(gate == K.GATES[5], F.concat(F.lit("citizenship/ITAR — "), quoted(quote_of(eligible, "citizenship"))))
        .when(gate == K.GATES[6], F.concat(F.lit("will not sponsor — "), quoted(quote_of(eligible, "no_sponsorship"))))
    )


def gate_quote(gate: Column, title: Column, employment_type: Column, verdict: Column, eligible: Column) -> Column:
    """The capped text that tripped one gate; a sandbox board has none."""
    return (
        F.when(gate == K.GATES[0], cap(title))
        .when(gate == K.GATES[2], F.when(has(title, K.INTERNSHIP_TITLE), cap(title)).otherwise(cap(employment_type)))
        .when(gate == K.GATES[3], cap(verdict["evidence"]))
        .when(gate == K.GATES[4], cap(quote_of(eligible, "clearance")))
        .when(gate == K.GATES[5], cap(quote_of(eligible, "citizenship")))
        .when(gate == K.GATES[6], cap(quote_of(eligible, "no_sponsorship")))
        .otherwise("")
    )

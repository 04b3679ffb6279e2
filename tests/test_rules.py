"""Bands, years, eligibility, gates, mail: golden rows worked out from the rules."""

import html
import html.entities
import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import fixed as K
from siftwell.functions import rules as R
from siftwell.functions import text as X
from siftwell.functions import tokens as N
from siftwell.functions import urls as U


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def many(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


TITLES = {
    "Software Engineer I": "entry", "Software Engineer II": "mid", "Software Engineer III": "mid", "Software Engineer 2": "mid",
    "Senior Software Engineer I": "senior", "International Sales": "unknown", "Leadership Coach": "unknown", "Lead Engineer": "senior",
    "New Grad Engineer": "entry", "Software Engineering Intern": "intern", "Sr. Developer": "senior", "Internships 2025": "intern",
    "Head of  Data": "senior", "Engineer": "unknown", "": "unknown", "Ingénieur Senior": "senior", "Junior-Entwickler": "entry",
}


def test_title_bands(spark):
    assert many(spark, TITLES, R.title_band) == list(TITLES.values())


YEARS = {
    "3+ years of experience": 3, "3-5 years' experience": 3, "3–5 years’ experience needed": 3, "2+ years required, 5+ years preferred": 2,
    "a 4-year degree program": None, "minimum of 6 years": 6, "At least 1 year": 1, "5 years experience, or 2 years experience": 2,
    "30 years experience": None, "": None, "graduating in 2025 with 3 years of experience": 3,
}


def test_minimum_years(spark):
    assert many(spark, YEARS, R.min_years) == list(YEARS.values())
    assert many(spark, [None], R.min_years) == [None]


def test_level_prefers_title_and_needs_a_description(spark):
    v = lambda t, d, a: one(spark, R.level(F.lit(t), F.lit(d), F.lit(a)))
    assert tuple(v("Software Engineer I", "5 years of experience", True)) == ("entry", "title", "Software Engineer I")
    assert tuple(v("Software Engineer", "1 year of experience", True)) == ("entry", "years", "1+ year")
    assert tuple(v("Software Engineer", "9 years of experience", True)) == ("senior", "years", "9+ years")
    assert tuple(v("Software Engineer", "9 years of experience", False)) == ("unknown", "none", "")
    said = R.explain_level(R.level(F.lit("Engineering Intern"), F.lit(""), F.lit(True)))
    assert one(spark, said) == "the title carries an intern marker"


def eligibility(spark, text, available=True):
    return one(spark, R.eligibility(F.lit(text), F.lit(available)))


@pytest.mark.parametrize(
    ("text", "clearance", "citizenship", "stance"),
    [
        ("An active TS/SCI clearance is required", True, False, "unstated"),
        ("military and sanitary work", False, False, "unstated"),
        ("ITAR rules apply", False, True, "unstated"),
        ("You must be a U.S. citizen.", False, True, "unstated"),
        ("We are unable to provide relocation", False, False, "unstated"),
        ("We will not sponsor visas", False, False, "will_not_sponsor"),
        ("visa sponsorship is available", False, False, "will_sponsor"),
        ("visa sponsorship is available; we cannot sponsor for this one", False, False, "will_not_sponsor"),
        ("Open to US citizens or permanent residents, or candidates requiring sponsorship", False, False, "unstated"),
        ("Open to US citizens or permanent residents, or candidates requiring sponsorship." + " filler" * 60 + " US citizens only", False, True, "unstated"),
    ],
)
def test_eligibility(spark, text, clearance, citizenship, stance):
    e = eligibility(spark, text)
    assert (e["clearance"], e["citizenship"], e["sponsorship"], e["checked"]) == (clearance, citizenship, stance, True)


def test_eligibility_evidence_and_unchecked(spark):
    e = eligibility(spark, "x" * 60 + " needs\n a security  clearance now " + "y" * 60)
    assert e["evidence"][0]["gate"] == "clearance"
    assert e["evidence"][0]["quote"] == "x" * 30 + " needs a security clearance now " + "y" * 34 or len(e["evidence"][0]["quote"]) <= 101
    assert eligibility(spark, "", True)["checked"] is False
    assert eligibility(spark, "US citizens only", False)["checked"] is False
    assert one(spark, R.quote_of(R.eligibility(F.lit("US citizens only here"), F.lit(True)), "citizenship")) == "US citizens only"


def test_citizenship_veto_window_counts_characters_on_both_sides(spark):
    near = "any work authorization" + "\U0001f600" * 100 + " US citizens only"
    far = "any work authorization" + "\U0001f600" * 170 + " US citizens only"
    assert many(spark, [near, far], R.citizenship_evidence) == ["", "US citizens only"]


def test_role_family_internship_sandbox(spark):
    assert many(spark, ["Software Engineer", "Sales Engineer", "Registered Nurse", "", "AI Solutions Developer", "Full Stack Developer"], R.in_role_family) == [True, False, False, False, False, True]
    assert many(spark, ["Internal Tools Engineer", "Internationalization Engineer", "Software Intern", "Co-op Developer"], lambda t: R.is_internship(t, F.lit(""))) == [False, False, True, True]
    assert many(spark, ["Intern", " internship ", "Temporary FT", "Coop", "Co-op", None], lambda t: R.is_internship(F.lit("Engineer"), t)) == [True, True, False, True, False, False]
    assert many(spark, ["leverdemo", "acme_sandbox_2", "democracy", "demodesk", "test", "SalesDemo-Jr ", "acme", None], R.is_sandbox) == [True, True, False, False, True, True, False, False]


MAIL = [
    ("a@greenhouse.io", "We are pleased to offer you the role", "", "offer"), ("a@x.com", "Interview request", "", "interview"),
    ("hr@careers.x", "Coding challenge", "", "assessment"), ("jobs@lever.co", "News", "unfortunately we chose other candidates", "rejected"),
    ("a@lever.co", "Your profile", "the team viewed your application", "viewed"), ("a@x.com", "Thank you for applying", "", "applied"),
    ("m@x.com", "What's it like to interview at X?", "", "other"), ("shop@x.com", "Sale today", "unfortunately over", "other"),
]


def test_mail_status(spark):
    rows = spark.createDataFrame([(i, *m[:3]) for i, m in enumerate(MAIL)], "i int, sender string, subject string, snippet string")
    got = rows.select("i", R.mail_status(F.col("sender"), F.col("subject"), F.col("snippet")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [m[3] for m in MAIL]
    old = rows.where("i = 1").select(R.mail_status(F.col("sender"), F.lit("next steps"), F.lit(""), K.OLD_MAIL_STATUS, ("x.com",)).alias("s"))
    assert old.first()["s"] == "other"  # the older rules want "next steps in"


def test_text_columns(spark):
    assert many(spark, ["a  b\n\tc", "  x ", None], X.collapse) == ["a b c", "x", None]
    assert many(spark, ["w " * 200, "short"], X.cap) == [("w " * 200).strip()[:179] + "…", "short"]
    got = many(spark, ["2024-01-02T03:04:05Z", "2024-01-02", "2024-01-02T03:04:05+0200", "soon", None, "2024-13-40"], lambda c: X.iso_time(c).cast("string"))
    assert got == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", "2024-01-02 01:04:05", None, None, None]
    assert many(spark, ["Ann <a@b.c>", "<a@b.c>", "a@b.c"], X.display_name) == ["Ann", "<a@b.c>", "a@b.c"]
    cut = many(spark, ["one two three four", "abcdefghijklmnop", "tiny"], lambda c: X.cut_at_word(c, 10))
    assert [(c["text"], c["cut"]) for c in cut] == [("one two…", True), ("abcdefghij…", True), ("tiny", False)]
    assert one(spark, X.sort_stamp(F.lit(None).cast("timestamp"))).startswith("0000-")
    assert one(spark, X.from_stamp(X.sort_stamp(F.lit("2024-05-06 07:08:09").cast("timestamp"))).cast("string")) == "2024-05-06 07:08:09"
    assert one(spark, X.epoch_ms(F.lit(1700000000123.0)).cast("string")) == "2023-11-14 22:13:20.123"
    assert one(spark, X.error_label(F.lit("ValueError"), F.lit(""))) == "ValueError"


def test_entities_are_those_of_the_standard_library(spark):
    rng = random.Random(4)
    names = sorted(html.entities.html5)
    texts = [f"a&{n}b &{n.rstrip(';')}= &{n.rstrip(';')}" for n in names]
    texts += [f"&#{n};&#{n} &#x{n:x};&#X{n:X}g" for n in (*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 99999999, 10**9, 10**30)]
    bits = ["&", "amp", "lt", ";", "#", "x", "38", "notit", "not", "in", "amp;", "&&", "é", "漢", "&amp;amp;lt;", " ", "\t", "<", "copy", "&#0038;", "&#00000000000038;", "1F600", "𝒳", "a" * 40, "nbsp"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(4000)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("u", X.unescape(F.col("t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "BatchEval" not in plan
    wrong = [(r["t"], r["u"]) for r in df.collect() if r["u"] != (None if r["t"] is None else html.unescape(r["t"]))]
    assert not wrong, wrong[:5]


def test_html_to_text(spark):
    html = ["&lt;p&gt;Hello&amp;nbsp;you&lt;/p&gt;&lt;script&gt;x()&lt;/script&gt;", "<ul><li>a</li><li>b</li></ul><br/>c", "<p>x</p>\n\n\n\n<p>y</p>", None, "z" * 12000]
    assert many(spark, html, X.html_to_text) == ["Hello you", "a\nb\n\nc", "x\n\ny", "", "z" * 12000]


def test_matches_rebuilds_positions(spark):
    text = "aa1bb22\U0001f600c333"
    got = many(spark, [text, "none", ""], lambda c: X.matches(c, r"\d+"))
    assert [(m["start"], m["text"]) for m in got[0]] == [(3, "1"), (6, "22"), (10, "333")]
    assert got[1] == [] and got[2] == []


def test_tokens_sections_scores(spark):
    assert many(spark, ["Java and Python", "JavaScript only", "React Native app", "robust trust", "we go, and golang", None], N.tokens_in) == [
        ["Java", "Python"], ["JavaScript"], ["React Native"], [], ["Go"], [],
    ]
    assert all(N.needed(p) for ps in K.VOCABULARY.values() for p in ps)
    s = many(spark, ["Requirements:\nPython\nNice to have:\nDocker a plus\nKafka\nRequired\nGo", ""], N.sections)
    assert (s[0]["required"], s[0]["preferred"]) == ("Python\nGo", "Kafka")
    assert (s[1]["required"], s[1]["preferred"]) == ("", "")
    arr = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    report = N.gap(arr("Java", "Kafka", "SQL"), arr("SQL", "React"), arr("Java", "Kafka", "SQL", "React"))
    got = one(spark, N.coverage_score(report, F.lit(True)))
    assert (got["total"], got["tier"], got["required_total"], got["preferred_total"]) == (100, "exact match", 3, 1)
    small = one(spark, N.coverage_score(N.gap(arr("Java"), arr(), arr("Java")), F.lit(False)))
    assert (small["total"], small["tier"]) == (20, "strong")
    none = one(spark, N.coverage_score(N.gap(arr(), arr(), arr("Java")), F.lit(True)))
    assert (none["total"], none["tier"]) == (0, "unscored")
    only_preferred = one(spark, N.coverage_score(N.gap(arr(), arr("Java"), arr("Java")), F.lit(True)))
    assert (only_preferred["total"], only_preferred["tier"]) == (40, "weak")
    assert one(spark, N.gap(arr("Java", "Kafka"), arr(), arr()))["variant"] == "backend"


def test_spans(spark):
    place = lambda d, s: one(spark, N.locate(F.lit(d), F.lit(s)))
    assert [place("3 years'\n  experience", s) for s in ("3 years'", "3 years' experience", "4 years", "")] == ["verbatim", "reflowed", "absent", "absent"]
    assert many(spark, ["  abcd ", "abcde", "x" * 500], N.clean_evidence) == ["", "abcde", "x" * 400]


URLS = {
    "https://boards.greenhouse.io/acme/jobs/1": ("greenhouse", "acme", "", ""), "boards.greenhouse.io/embed/job_board?for=acme": ("greenhouse", "acme", "", ""),
    "https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/x": ("workday", "acme", "wd5", "Careers"), "https://jobs.lever.co:443/acme/1": ("lever", "acme", "", ""),
    "https://careers.icims.com/x": None, "https://example.com/jobs": None, "": None, "https://acme.wd1.myworkdayjobs.com/en-US": None,
}


def test_apply_urls(spark):
    got = many(spark, URLS, lambda u: U.classify_apply_url(u, F.lit("")))
    assert [g and (g["ats"], g["tenant"], g["wd"], g["site"]) for g in got] == list(URLS.values())
    assert many(spark, ["https://jobs.lever.co/leverdemo/1", "https://acme.wd1.x.com/a", "x"], U.board_slugs) == [["jobs", "leverdemo"], ["acme"], []]


def test_said_beginnings_change_no_match(spark):
    """The quick forms of the patterns match what the patterns match, in texts made of their own words."""
    import random

    rng = random.Random(3)
    words = (
        "must required to be a us U.S. united states citizen citizens citizenship is mandatory only ITAR export controlled regulations person requires hold or lawful permanent residents requirement "
        "security clearance active ts / sci top secret polygraph public trust q l dod ability obtain not unable cannot do will won't sponsor sponsorship visa work visas no without the need for we are "
        "happy open offer available h-1b transfers welcome 4 4- year degree program graduating completed finish by 2024 cohort . , é ſecurity ıtar"
    ).split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for quick, plain in ((R.CLEARANCE, K.CLEARANCE), (R.CITIZENSHIP, K.CITIZENSHIP), (R.NO_SPONSORSHIP, K.NO_SPONSORSHIP), (R.YES_SPONSORSHIP, K.YES_SPONSORSHIP), (R.EDUCATION_NOISE, K.EDUCATION_NOISE)):
        a, b = (F.regexp_extract_all("t", F.lit(K.FLAGS + p), F.lit(0)) for p in (quick, plain))
        assert df.where(a != b).count() == 0 and df.where(F.size(b) > 0).count() > 50, plain

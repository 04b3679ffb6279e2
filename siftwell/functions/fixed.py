"""Patterns, word lists and limits that results depend on.

Every pattern is flat (no verbose mode) and used with :data:`FLAGS`, so that case and word boundaries
follow Unicode as the rules expect.
"""

from __future__ import annotations

#: Unicode-aware and case-insensitive.
FLAGS = "(?iuU)"

# --- fixed values: bands from a title, in order ------------------------------------------------
SENIOR_TITLE = (
    r"\b(senior|sr\.?|staff|principal|distinguished|fellow|lead(?!ership)|leader|manager|mgr|director|head\s+of"
    r"|architect|vp|vice\s+president|chief|president|expert|specialist\s+iv)\b"
)
INTERN_TITLE = r"\b(?:intern(?![a-z])|internships?|co-?op)\b"
ENTRY_TITLE = (
    r"\b(new\s?grad(?:uate)?|grad(?:uate)?\s+(?:program|scheme|engineer|hire)|entry[-\s]?level|junior|jr\.?|associate|apprentice"
    r"|early\s+career|campus|university\s+grad(?:uate)?|new\s+college\s+grad(?:uate)?)\b"
)
MID_NUMERAL = r"\b(?:i{2,3}|iv|v|[2-9])\b"
ONE_NUMERAL = r"\b(?:i|1)\b(?![ivx])"
TITLE_BANDS = ((SENIOR_TITLE, "senior"), (INTERN_TITLE, "intern"), (ENTRY_TITLE, "entry"), (MID_NUMERAL, "mid"), (ONE_NUMERAL, "entry"))
JUNIOR_BANDS = ("intern", "entry")

# --- fixed values: years of experience ------------------------------------------------------------
EDUCATION_NOISE = (
    r"(\d\s*[-–]?\s*year\s+(?:degree|program|course|university|college|bachelor)"
    r"|(?:graduat\w+|complet\w+|finish\w+)[^.]{0,30}\b20\d{2}|\b20\d{2}\b\s*(?:graduate|grad|cohort|start))"
)
_YEARS = r"year(?:s)?(?:['’]s?)?"
_QUALIFIER = (
    r"(?:relevant\s+|professional\s+|industry\s+|software\s+|hands[-\s]?on\s+|work\s+|practical\s+|full[-\s]?time\s+|engineering\s+)?"
)
_COUNT = r"(\d{1,2})\s*(?:\+|plus)?\s*(?:[-–]|to)?\s*(?:\d{1,2})?\s*(?:\+)?\s*"
YEARS_PATTERNS = (
    _COUNT + _YEARS + r"\s*(?:of\s+)?" + _QUALIFIER + r"(?:experience|exp\b)",
    _COUNT + _YEARS + r"\s*(?:of\s+)?" + _QUALIFIER + r"(?:required|requirement|minimum|min\b|preferred|in\s+a\s+similar)",
    r"minimum\s+(?:of\s+)?(\d{1,2})\s*(?:\+)?\s*" + _YEARS,
    r"at\s+least\s+(\d{1,2})\s*(?:\+)?\s*" + _YEARS,
)
MAX_YEARS, ENTRY_MAX_YEARS, MID_MAX_YEARS = 25, 2, 5

# --- fixed values: eligibility ----------------------------------------------------------------------
CLEARANCE = (
    r"(\bsecurity\s+clearance\b|\bclearance\s+(?:is\s+)?required\b|\bactive\s+clearance\b|\bts\s*/\s*sci\b|\btop\s+secret\b"
    r"|\bsecret\s+clearance\b|\bsci\s+clearance\b|\bpolygraph\b|\bpublic\s+trust\b|\bq\s+clearance\b|\bl\s+clearance\b"
    r"|\bdod\s+clearance\b|\bability\s+to\s+obtain\s+a\s+clearance\b)"
)
_US = r"(?:us|u\.s\.|united\s+states)"
CITIZENSHIP = (
    r"(\b(?:must|required\s+to)\s+be\s+a?\s*" + _US + r"\s+citizens?\b|\b" + _US + r"\s+citizenship\s+(?:is\s+)?(?:required|mandatory)\b"
    r"|\b" + _US + r"\s+citizens?\s+only\b|\bcitizenship\s+is\s+required\b|\bitar\b"
    r"|\bexport\s+control(?:led|s)?\s+(?:regulations?|requirements?|laws?)\b|\bmust\s+be\s+a\s+(?:us|u\.s\.)\s+person\b"
    r"|\brequires?\s+" + _US + r"\s+citizenship\b|\bmust\s+(?:hold|have|possess)\s+" + _US + r"\s+citizenship\b"
    r"|\b" + _US + r"\s+citizens?\s+or\s+(?:lawful\s+)?permanent\s+residents?\b"
    r"|\bcitizenship\s+(?:is\s+)?(?:a\s+)?(?:requirement|prerequisite)\b)"
)
CITIZENSHIP_VETO = (
    r"(\bregardless\s+of\s+(?:citizenship|immigration|national\s+origin)|\b(?:any|all)\s+(?:form\s+of\s+)?work\s+authoriz\w+"
    r"|\bor\s+(?:candidates\s+)?(?:requiring|needing|with)\s+(?:visa\s+)?sponsorship|\bor\s+(?:those\s+)?(?:who\s+)?(?:require|need)\s+sponsorship"
    r"|\b(?:opt|cpt|f-?1|h-?1b|ead|tn\s+visa)\b|\bvisa\s+holders?\b|\bwe\s+sponsor\b)"
)
VETO_WINDOW, EVIDENCE_CONTEXT = 160, 40
NO_SPONSORSHIP = (
    r"((?:not|unable|cannot|can\s?not|do\s+not|does\s+not|will\s+not|won'?t)[^.]{0,40}?(?:sponsor(?:ship|ing)?|visa\s+sponsorship|work\s+visas?)"
    r"|no\s+(?:visa\s+)?sponsorship(?:\s+(?:is\s+)?(?:available|offered|provided))?|without\s+(?:the\s+need\s+for\s+)?(?:visa\s+)?sponsorship"
    r"|sponsorship\s+is\s+not\s+(?:available|offered|provided)|we\s+are\s+not\s+able\s+to\s+sponsor)"
)
YES_SPONSORSHIP = (
    r"((?:will|do|does|can|happy\s+to|able\s+to|open\s+to)\s+(?:provide\s+|offer\s+)?(?:visa\s+)?sponsor(?:ship|ing)?"
    r"|(?:visa\s+)?sponsorship\s+(?:is\s+)?(?:available|offered|provided)|we\s+sponsor\s+visas?|h-?1b\s+(?:transfers?\s+)?(?:welcome|accepted|supported))"
)

# --- fixed values: role family, internships, sandbox boards ------------------------------------------
ROLE_ALLOW = (
    r"\b(software\s+(?:engineer|developer|dev)|swe|sde|sdet"
    r"|(?:backend|back[-\s]end|frontend|front[-\s]end|full[-\s]?stack|mobile|ios|android|platform|infrastructure|systems|embedded|web)\s+(?:engineer|developer)"
    r"|engineer(?:ing)?,\s*(?:backend|frontend|full[-\s]?stack|mobile|platform)|programmer|developer|software\s+engineering)\b"
)
ROLE_DENY = (
    r"\b(sales|solutions?|pre[-\s]?sales|support|customer|success|account|marketing|recruit\w*|talent|people|finance|legal|procurement"
    r"|product\s+manager|program\s+manager|project\s+manager|technical\s+writer|data\s+(?:scientist|analyst)|analytics\s+engineer|research\s+scientist"
    r"|business|operations\s+engineer|field\s+engineer|implementation|quality\s+(?:assurance\s+)?(?:manager|lead)|designer|ux|ui\s+designer"
    r"|mechanical|electrical|civil|chemical|industrial|hardware|manufacturing|process\s+engineer|test\s+technician|validation)\b"
)
INTERNSHIP_TITLE = (
    r"\b(intern|interns|internship|internships|co-?ops?|placement\s+student|industrial\s+placement|apprentice(?:ship)?|working\s+student"
    r"|werkstudent|summer\s+analyst|new\s+grad\s+intern)\b"
)
INTERNSHIP_TYPES = ("intern", "internship", "coop", "apprenticeship")  # spaces and hyphens removed
SANDBOX_TENANTS = ("leverdemo", "salesdemo-jr")
SANDBOX_SLUG = (
    r"(?:^|[-_])(?:demo|sandbox|staging|playground|dummy)(?:[-_]|$)|(?:demo|sandbox|staging|playground|dummy)$|^(?:test|example|foo|bar)$"
)
GATES = (
    "not_a_software_role", "ats_vendor_demo_board", "internship_not_full_time", "wrong_seniority_band", "security_clearance_required",
    "citizenship_or_itar_restricted", "employer_will_not_sponsor",
)

# --- fixed values: mail -----------------------------------------------------------------------------
MAIL_SENDERS = (
    "greenhouse-mail.io", "greenhouse.io", "ashbyhq.com", "lever.co", "myworkday.com", "smartrecruiters.com", "jobvite.com", "icims.com",
    "recruiting", "careers", "talent",
)
MAIL_SUBJECT = r"applying|your application|application (?:received|viewed)|interview"
MAIL_STATUS = (
    ("offer", r"pleased to offer|offer of employment|extend(?:ing)? an offer|your offer letter"),
    (
        "interview",
        r"(schedule|set ?up|book|invite you)\b.{0,24}(interview|call|screen|chat|conversation|time)|phone screen|interview invit(?:e|ation)"
        r"|interview request|would like to (?:interview|speak|chat|meet)|move forward with your|next (?:round|steps?)",
    ),
    ("assessment", r"assessment|coding challenge|codesignal|hackerrank|online test|take[- ]home|complete .{0,20}challenge"),
    (
        "rejected",
        r"not moving forward|will not be moving|unfortunately|regret to inform|other candidates|position (?:has been )?closed|not (?:be )?selected",
    ),
    ("viewed", r"application was viewed|viewed your application|was sent to the"),
    (
        "applied",
        r"thank you for applying|application received|received your application|we(?:'ve| have) received your application|your application (?:for|to|has)",
    ),
)
MAIL_NEEDS_ACTION = ("offer", "interview", "assessment")
#: The older rule set of the first version.
OLD_MAIL_SENDERS = (
    "greenhouse-mail.io", "greenhouse.io", "ashbyhq.com", "myworkday.com", "smartrecruiters.com", "jobvite.com", "talent.icims.com", "lever.co",
    "recruiting", "careers", "no-reply@openai.com", "makenotion.com",
)
OLD_MAIL_STATUS = (
    ("offer", r"pleased to offer|extend(?:ing)? an offer|offer of employment|your offer|job offer"),
    (
        "interview",
        r"(schedule|set ?up|book|invite you)\b.{0,24}(interview|call|screen|chat|conversation|time)|phone screen|interview invit(e|ation)"
        r"|interview request|would like to (interview|speak|chat|meet)|move forward with your|next (round|step|steps) in",
    ),
    ("assessment", r"assessment|coding challenge|codesignal|hackerrank|online test|take[- ]home|complete .{0,20}challenge"),
    (
        "rejected",
        r"not moving forward|will not be moving|unfortunately|regret to inform|other candidates|position (has been )?closed|not (be )?selected",
    ),
    ("viewed", r"application was viewed|viewed your application|was sent to"),
    (
        "applied",
        r"thank you for applying|application received|received your application|we(?:'ve| have) received your application|your application (for|to|is)",
    ),
)

# --- fixed values: requirement vocabulary -----------------------------------------------------------
VOCABULARY: dict[str, tuple[str, ...]] = {
    "Python": (r"\bpython\b",), "Java": (r"\bjava\b(?!script)",), "JavaScript": (r"\bjavascript\b",), "TypeScript": (r"\btypescript\b",),
    "Go": (r"\bgolang\b", r"\bgo\b(?=\s*(?:,|/|\)|programming|lang))"), "C++": (r"c\+\+",), "C#": (r"c#",), "Rust": (r"\brust\b",),
    "Ruby": (r"\bruby\b",), "Kotlin": (r"\bkotlin\b",), "Swift": (r"\bswift\b",), "Scala": (r"\bscala\b",), "Dart": (r"\bdart\b",),
    "React": (r"\breact\b(?! native)",), "React Native": (r"react native",), "Angular": (r"\bangular\b",), "Vue": (r"\bvue\b",),
    "Node.js": (r"node\.?js",), "Next.js": (r"next\.?js",), "Django": (r"\bdjango\b",), "Flask": (r"\bflask\b",), "FastAPI": (r"\bfastapi\b",),
    "Spring": (r"spring boot",), "AWS": (r"\baws\b", r"amazon web services"), "GCP": (r"\bgcp\b", r"google cloud"), "Azure": (r"\bazure\b",),
    "Kubernetes": (r"\bkubernetes\b", r"\bk8s\b"), "Docker": (r"\bdocker\b",), "Terraform": (r"\bterraform\b",), "Lambda": (r"\blambda\b",),
    "Cognito": (r"\bcognito\b",), "CDK": (r"\bcdk\b",), "IAM": (r"\biam\b",), "EventBridge": (r"\beventbridge\b",), "Stripe": (r"\bstripe\b",),
    "S3": (r"\bs3\b",), "DynamoDB": (r"\bdynamodb\b",), "PostgreSQL": (r"\bpostgresql\b", r"\bpostgres\b"), "MySQL": (r"\bmysql\b",),
    "MongoDB": (r"\bmongodb\b",), "Redis": (r"\bredis\b",), "Kafka": (r"\bkafka\b",), "GraphQL": (r"\bgraphql\b",), "gRPC": (r"\bgrpc\b",),
    "REST": (r"\brest\b", r"\brestful\b"), "OAuth": (r"\boauth\b",), "JWT": (r"\bjwt\b", r"json web token"), "Microservices": (r"microservices?",),
    "CI/CD": (r"ci/cd", r"continuous integration"), "Git": (r"\bgit\b",), "Linux": (r"\blinux\b",), "Agile/Scrum": (r"\bagile\b", r"\bscrum\b"),
    "Unit testing": (r"unit test",), "Integration testing": (r"integration test",), "pytest": (r"\bpytest\b",),
    "Distributed systems": (r"distributed system",), "System design": (r"system design",), "Data structures": (r"data structure",),
    "Algorithms": (r"algorithms?",), "Observability": (r"\bobservability\b",), "Machine learning": (r"machine learning",),
    "LLM": (r"\bllms?\b", r"large language model"), "SQL": (r"\bsql\b",), "NoSQL": (r"\bnosql\b",), "Flutter": (r"\bflutter\b",),
    "iOS": (r"\bios\b",), "Android": (r"\bandroid\b",), "HTML/CSS": (r"\bhtml\b", r"\bcss\b"), "DevOps": (r"\bdevops\b",),
}
BACKEND_SIGNAL = (
    "Python", "Java", "Go", "Rust", "PostgreSQL", "MySQL", "MongoDB", "Redis", "Kafka", "gRPC", "Microservices", "Distributed systems",
    "DynamoDB", "Lambda", "Terraform", "Kubernetes", "SQL", "NoSQL", "System design", "Observability", "DevOps",
)
FRONTEND_SIGNAL = ("React", "Angular", "Vue", "Next.js", "TypeScript", "JavaScript", "HTML/CSS", "React Native", "Flutter", "iOS", "Android")
REQUIRED_HEAD = r"(required|requirements|must have|minimum qualifications|basic qualifications|what you.{0,5}ll need|qualifications)"
PREFERRED_HEAD = r"(preferred|nice to have|bonus|plus|desired|good to have)"
HEADING_CHARS, DOMINANCE, MIN_SIGNALS = 80, 2, 2
WEIGHT_REQUIRED, WEIGHT_PREFERRED, WEIGHT_LEVEL = 60, 25, 15
STRONG_AT, PARTIAL_AT, MIN_EVIDENCE = 0.80, 0.50, 3
RELEASED = {
    "FastAPI": "2018-12", "Next.js": "2016-10", "Kubernetes": "2015-07", "Terraform": "2014-07", "DynamoDB": "2012-01", "Lambda": "2014-11",
    "EventBridge": "2019-07", "Flutter": "2018-12", "TypeScript": "2012-10", "pytest": "2009-11", "gRPC": "2016-08", "GraphQL": "2015-07",
}

# --- fixed values: keyword profiles -------------------------------------------------------------------
KEYWORDS = {
    "flutter": 15, "dart": 10, "full stack": 12, "full-stack": 12, "backend": 10, "software engineer": 10, "python": 10, "typescript": 6,
    "aws": 10, "lambda": 6, "dynamodb": 6, "serverless": 6, "cognito": 4, "api gateway": 4, "cdk": 4, "rest": 5, "api": 4,
    "microservices": 4, "docker": 3, "ci/cd": 3, "sql": 3, "mobile": 6, "react": 4, "node": 4,
}
TITLE_MUST = ("engineer", "developer", "swe", "sde", "full stack", "full-stack")
TITLE_BLOCK = ("senior", "staff", "principal", "lead", "manager", "director", "sr.", "vp")
OLD_KEYWORDS = {
    "flutter": 15, "dart": 10, "aws": 12, "lambda": 8, "dynamodb": 8, "serverless": 8, "python": 10, "typescript": 8, "api gateway": 6,
    "cognito": 5, "cdk": 5, "full stack": 10, "full-stack": 10, "backend": 8, "mobile": 8, "software engineer": 10, "react": 4, "rest": 4,
    "microservices": 4, "ci/cd": 3, "sql": 3,
}
OLD_TITLE_MUST = ("engineer", "developer", "swe")
OLD_TITLE_BLOCK = ("staff", "principal", "director", "manager", "lead", "sr.", "senior")

# --- fixed values: rewrite audit -----------------------------------------------------------------------
PRODUCT_NUMBERS = r"(oauth\s*2\.0|owasp\s+top\s+10|http/?[12]|python\s*3|pydantic\s+v2|s3|ec2|top\s+10|utf-8|base64|sha-?256|oauth2)"
NUMBER = r"\b\d[\d,.]*\b"
PLACEHOLDER = r"\[[A-Z]\]|\[X+\]|\bTODO\b|\bTBD\b"
WORD = r"[A-Za-z][A-Za-z'’\-]*"
SUBJECT_WINDOW = 80

# --- fixed values: application urls ----------------------------------------------------------------------
URL_HOSTS = {
    "job-boards.greenhouse.io": "greenhouse", "boards.greenhouse.io": "greenhouse", "jobs.ashbyhq.com": "ashby", "jobs.lever.co": "lever",
    "apply.workable.com": "workable", "jobs.smartrecruiters.com": "smartrecruiters", "careers.icims.com": "icims",
}
URL_ROUTES = ("embed", "job_board", "jobs")
SHARDED_HOST = r"^([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com$"
LOCALE = r"^[a-z]{2}(-[A-Za-z]{2})?$"
SUPPORTED = ("greenhouse", "ashby", "lever", "workable", "workday")
TENANT_IN_PATH = ("greenhouse.io", "ashbyhq.com", "lever.co", "workable.com")

# --- fixed values: limits ---------------------------------------------------------------------------------
QUOTE_CHARS, CARD_CHARS, ERROR_CHARS = 180, 400, 200
MAX_FAILED_SHARE, REPORTED_FAILURES = 0.25, 10
STALE_HOURS, VIEW_DAYS = 48, 3
BACKLOG_CHUNK, BACKLOG_LIMIT, BACKLOG_CEILING, BACKLOG_CHARS = 25, 150, 1000, 6000
SPAN_MIN, SPAN_MAX = 5, 400

"""Values that results depend on."""

# Query parameters that only track, by name and by the start of a name.
TRACKING = ["fbclid", "gclid", "dclid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "vero_id", "wickedid", "yclid", "ref", "referrer", "source", "src", "campaign", "spm", "scid"]
TRACKING_STARTS = ["utm_", "ga_", "pk_", "mtm_", "hsa_", "matomo_"]

# What pages say when they refuse a robot, ask for a login or for money.
BOT_WALL = [
    "cf-browser-verification", "cf_chl_opt", "cf-challenge-running", "checking your browser before accessing", "attention required! | cloudflare", "just a moment...", "enable javascript and cookies to continue",
    "reference #18.", "access denied | akamai", "datadome", "px-captcha", "perimeterx", "incapsula incident id", "_incapsula_resource", "g-recaptcha", "grecaptcha.render", "hcaptcha.com/captcha", "captcha-delivery.com",
    "please verify you are a human", "are you a robot", "unusual traffic from your computer network",
]
LOGIN = [
    "sign in to continue", "log in to continue", "please sign in to read", "please log in to view", "you must be logged in", "members only", "subscribers only", "this content is for members", "create a free account to read",
    "sign up to read the full", "register to continue reading",
]
PAYWALL = [
    "subscribe to continue reading", "subscribe to read", "this article is for subscribers", "you've reached your article limit", "you have reached your free article", "your free trial has ended", "start your free trial to read",
    "unlock this article", "premium content", "paid subscribers only",
]

# Lines that are not the article's own, after an optional Markdown mark.
BOILERPLATE = [
    r"share (this|on)\b", r"(tweet|share|pin it|email this)\s*$", r"subscribe to (our|the) newsletter", r"sign up for (our|the) newsletter", r"(read|related|you might also like|more from|recommended)[\s:]*$",
    r"(recent|latest|popular|previous|other) (articles?|posts?|stories)\s*:?\s*$", r"more (articles?|posts?)\b.*$", r"(previous|next) (post|article)\b", r"posted in\b.*$", r"tags?:\s*$", r"\d+ (comments?|min read)\s*$",
    r"(copyright|©)\s*\d{4}", r"all rights reserved", r"cookie (policy|settings|preferences)\s*$", r"accept (all )?cookies\s*$", r"advertisement\s*$", r"loading\.{0,3}\s*$",
]

# Statuses of a page and the groups a report counts them in.
STATUS_GROUPS = {
    "stored": "success", "duplicate_url": "duplicate", "duplicate_content": "duplicate", "duplicate_near": "duplicate", "login_required": "blocked", "paywall_partial": "blocked", "bot_wall": "blocked",
    "extraction_failed": "extraction_failure", "junk": "extraction_failure", "invalid_url": "refused", "robots_disallowed": "refused", "rate_limited": "refused", "fetch_failed": None, "api_rejected": None,
}

# Prices in dollars per million tokens, in and out; models that are not listed cost FALLBACK.
RATES = {"llama-3.3-70b-versatile": (0.59, 0.79), "llama-3.1-8b-instant": (0.05, 0.08), "openai/gpt-oss-120b": (0.15, 0.60), "openai/gpt-oss-20b": (0.075, 0.30), "moonshotai/kimi-k2-instruct-0905": (1.00, 3.00)}
FALLBACK = (1.00, 3.00)
# What a question must not hold to go to the cheap model.
HARD_SIGNALS = ["calculate", "compute", "search", "find", "look up", "fetch", "url", "http", "www.", "explain", "why", "how does", "compare", "analyse", "analyze", "write", "code", "debug", "*", "/", "+", "%"]
# Characters that a tool's result may have.
CAPS = {"web_search": 1600, "fetch_url": 3000}
OTHER_CAP = 2000
# Rolling limits on requests (window in hours, limit, per host).
LIMITS = [(1, 60, True), (24, 300, True), (1, 300, False), (24, 2000, False), (720, 20000, False)]

# The last lines of a page that list other articles, as a heading and as a dated entry.
LINK_HEADING = r"(recent|latest|popular|related|previous|other|more)\s+(articles?|posts?|stories|reading)\s*:?\s*$"
LINK_ENTRY = r"^\s*[-*•]\s+.+?\s+-\s+\d{1,2}(st|nd|rd|th)?\s+\w+\s+\d{4}\s*$"
# The calculator's bounds on an exponent and on an expression's characters.
MOST_EXPONENT, MOST_EXPRESSION = 1000, 500

# Tags without text of the page, and those that frame an article.
HIDDEN = frozenset({"script", "style", "noscript", "svg", "template"})
CHROME = HIDDEN | {"nav", "footer", "header", "aside", "form", "iframe", "button"}
# Where pages declare their date, the most trusted first.
META_DATES = [
    "article:published_time", "og:article:published_time", "datePublished", "date", "pubdate", "publish-date", "publication_date", "DC.date.issued", "dc.date", "sailthru.date", "parsely-pub-date", "og:updated_time",
    "article:modified_time",
]
LD_DATES = ["datePublished", "dateCreated", "uploadDate"]
# Dates in prose.
MONTHS = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE_PATTERNS = [rf"\b{MONTHS}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b", rf"\b(\d{{1,2}})\s+{MONTHS}\.?,?\s+(\d{{4}})\b", r"\b(\d{4})-(\d{2})-(\d{2})\b"]

# What a status says to people.
STATUS_MESSAGES = {
    "stored": "Stored successfully.", "invalid_url": "Not a valid URL, even after attempting repair.", "robots_disallowed": "Skipped: robots.txt disallows crawling this page.", "rate_limited": "Skipped: rate limit reached. Try again later.",
    "login_required": "Cannot scrape: this page requires a login.", "paywall_partial": "Cannot scrape: article is behind a paywall (only a teaser is public).", "bot_wall": "Cannot scrape: the site is behind a bot check or CAPTCHA.",
    "fetch_failed": "Could not fetch the page.", "extraction_failed": "Fetched the page, but found no article text in it.", "junk": "Extracted text failed the quality checks.", "duplicate_url": "Already crawled: this URL is already stored.",
    "duplicate_content": "Already stored under a different URL (identical text).", "duplicate_near": "Near-duplicate of an article already stored.", "api_rejected": "The documents API rejected this document.",
}
# Characters that a stored document's fields may have.
TITLE_CHARS, URL_CHARS, SOURCE_CHARS = 500, 2000, 200
# The last messages that a summary leaves, and the estimated tokens below which none is made.
KEEP_MESSAGES, SUMMARY_TOKENS = 6, 6000
# Characters of a product's text in the graph.
GRAPH_TEXT_CHARS = 4000

"""Word lists, patterns, thresholds and clock-free settings as one parameter object.

Every operator that needs vocabulary takes a :class:`RuleSet`. The lists are turned into literals
when a plan is built. Keywords and denied hosts of any number can also come as tables:
``operators.vocabulary`` joins them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------------------------
# Results depend on these being exactly so. All of them can be overridden.
# ---------------------------------------------------------------------------------------------

US_STATE_ABBREVIATIONS = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA",
    "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT",
    "VA", "WA", "WV", "WI", "WY", "DC",
)

US_STATE_NAMES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut",
    "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas",
    "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota",
    "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey",
    "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon",
    "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas",
    "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
)

US_MENTION = r"United States|U\.S\.A?\.?|USA"
ZIP_WINDOW = 12

COMPOUNDING_SIGNALS = (
    "compounding pharmacy", "licensed pharmacist", "prescription required", "pcab accredited",
    "usp <795>", "usp 795", "usp <797>", "usp 797", "compounded medication",
)
MANUFACTURING_SIGNALS = (
    "cgmp", "gmp facility", "peptide synthesis", "custom peptide synthesis", "api manufacturer",
    "bulk manufacturer", "manufacturing facility", "synthesized in", "manufactured in our",
    "our lab", "in-house lab", "solid-phase", "solid phase", "lyophilized in",
)
COMMERCE_SIGNALS = (
    "add to cart", "add to bag", "buy now", "checkout", "shopping cart", "in stock",
    "out of stock", "free shipping", "shop now", "view product", "select options", "quantity",
    "sku", "subtotal",
)
CONTENT_SIGNALS = (
    "we may earn a commission", "affiliate link", "affiliate disclosure",
    "editorially independent", "no paid placement", "medically reviewed by", "fact-checked",
    "our editorial team", "this article", "table of contents", "read our review",
    "buyer's guide", "buying guide",
)
SIGNAL_MINIMUM = 2

EVIDENCE_PHRASES = (
    "for research use only", "research use only", "not for human consumption",
    "not intended for human", "research purposes only", "for laboratory research use only", "ruo",
)
EVIDENCE_MARGIN = 40

NEGATION_WORDS = ("not", "isn't", "aren't", "never", "no longer", "n't")
NEGATION_WINDOW = 25

ADDRESS_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
URL_PATTERN = r"https?://[^\s\"'<>)\]]+"
BARE_DOMAIN_PATTERN = r"\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}\b"
OPT_OUT_PATTERN = r"unsubscribe|opt[\s-]?out|remove me|stop emailing|do not (?:contact|email)"

GENERIC_LOCALS = ("privacy", "abuse", "webmaster", "postmaster", "noreply", "no-reply")
PLACEHOLDER_LOCALS = ("your", "youremail", "your-email", "email", "name", "username", "user")
PLACEHOLDER_MAIL_DOMAINS = (
    "mysite.com", "example.com", "example.org", "domain.com", "yourdomain.com", "yoursite.com",
    "email.com", "sentry.io", "wixpress.com", "shopify.com", "godaddy.com", "squarespace.com",
    "test.com",
)
ROLE_WORDS = ("sales", "info", "contact", "support", "orders", "hello")

NON_COMPANY_HOSTS = (
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com",
    "tiktok.com", "reddit.com", "pinterest.com", "t.me", "google.com", "gstatic.com",
    "googleapis.com", "gravatar.com", "cloudflare.com", "cloudflareinsights.com", "jsdelivr.net",
    "unpkg.com", "wordpress.org", "w3.org", "schema.org", "shopify.com", "wix.com",
    "squarespace.com", "gmail.com", "example.com", "sentry.io", "stripe.com", "paypal.com",
    "trustpilot.com", "archive.org", "cdn.shopify.com",
)
ASSET_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js", ".ico", ".woff", ".woff2",
)
NEVER_OFFICIAL_HOSTS = (
    "peptidebase.io", "thepeptidelist.com", "reddit.com", "amazon.com", "ebay.com",
    "trustpilot.com", "yelp.com", "crunchbase.com", "bloomberg.com", "linkedin.com",
    "facebook.com", "instagram.com", "youtube.com", "x.com", "wikipedia.org", "medium.com",
    "substack.com", "quora.com", "glassdoor.com",
)

CANDIDATE_PATHS = ("", "/about", "/about-us", "/contact", "/contact-us")

QUERY_PLACEHOLDER = "{peptide}"
LOOKUP_QUERY = '"%s" peptides official site'
QUERY_TEMPLATES = {
    "research_only": (
        '"{peptide}" research peptides supplier "for research use only" USA',
        '"{peptide}" research chemicals supplier "not for human consumption"',
        '"{peptide}" "research use only" "add to cart" -reddit -forum',
        'buy "{peptide}" research peptide "COA" third party tested USA',
        '"{peptide}" inurl:product research peptide',
        '"{peptide}" research peptide "cart" "checkout" -amazon -ebay',
        '"{peptide}" peptide vial "certificate of analysis" buy',
    ),
    "consumer_and_research": (
        'buy "{peptide}" peptides online USA',
        '"{peptide}" peptides for sale shop',
        '"{peptide}" peptides "made in USA" shop "add to cart"',
        '"{peptide}" "our lab" peptides buy third-party tested',
        '"{peptide}" peptides "synthesized in" USA store',
    ),
    "compounding_pharmacy": (
        '"{peptide}" compounding pharmacy USA',
        '"{peptide}" compounded prescription pharmacy',
    ),
    "manufacturing_lab": (
        '"{peptide}" peptide manufacturer USA',
        '"{peptide}" custom peptide synthesis lab',
    ),
}
DEFAULT_COMPANY_TYPES = ("research_only", "consumer_and_research")

# Search providers in the order they are asked, with the most results one query may bring
# (None: pages through results until the number asked for is reached).
PROVIDER_CAPS = {
    "google_cse": None, "serper": 100, "brave": 20, "bing": 50, "google_places": None,
}
LOOKUP_PROVIDERS = ("serper", "brave", "google_cse")
LOOKUP_RESULTS = 6

MATCH_THRESHOLD = 0.55
POSITION_STEP = 0.01
POSITION_SPAN = 5

FINAL_STATUSES = ("replied", "qualified", "disqualified")
INTERVAL_DAYS = 3
MAX_FOLLOWUPS = 4
INBOX_DAYS = 30
BODY_CUT = 2_000

ROSTER_SOURCE = "vendor_roster"
ROSTER_HOME_COUNTRY = "United States"

# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleSet:
    """Vocabulary and thresholds of one run. ``RuleSet().but(keywords=(...))`` overrides fields."""

    keywords: tuple[str, ...] = ()
    state_abbreviations: tuple[str, ...] = US_STATE_ABBREVIATIONS
    state_names: tuple[str, ...] = US_STATE_NAMES
    compounding_signals: tuple[str, ...] = COMPOUNDING_SIGNALS
    manufacturing_signals: tuple[str, ...] = MANUFACTURING_SIGNALS
    commerce_signals: tuple[str, ...] = COMMERCE_SIGNALS
    content_signals: tuple[str, ...] = CONTENT_SIGNALS
    signal_minimum: int = SIGNAL_MINIMUM
    evidence_phrases: tuple[str, ...] = EVIDENCE_PHRASES
    evidence_margin: int = EVIDENCE_MARGIN
    negation_words: tuple[str, ...] = NEGATION_WORDS
    negation_window: int = NEGATION_WINDOW
    generic_locals: tuple[str, ...] = GENERIC_LOCALS
    placeholder_locals: tuple[str, ...] = PLACEHOLDER_LOCALS
    placeholder_mail_domains: tuple[str, ...] = PLACEHOLDER_MAIL_DOMAINS
    role_words: tuple[str, ...] = ROLE_WORDS
    non_company_hosts: tuple[str, ...] = NON_COMPANY_HOSTS
    asset_suffixes: tuple[str, ...] = ASSET_SUFFIXES
    never_official_hosts: tuple[str, ...] = NEVER_OFFICIAL_HOSTS
    candidate_paths: tuple[str, ...] = CANDIDATE_PATHS
    opt_out_pattern: str = OPT_OUT_PATTERN
    templates: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(QUERY_TEMPLATES))
    placeholder: str = QUERY_PLACEHOLDER
    provider_caps: dict[str, int | None] = field(default_factory=lambda: dict(PROVIDER_CAPS))
    lookup_providers: tuple[str, ...] = LOOKUP_PROVIDERS
    match_threshold: float = MATCH_THRESHOLD

    def __post_init__(self) -> None:
        for phrase in self.all_phrases():
            if not phrase or phrase != phrase.lower():
                raise ValueError(f"signal phrase {phrase!r} must be lower case and not empty")

    def all_phrases(self) -> tuple[str, ...]:
        return (
            self.compounding_signals + self.manufacturing_signals + self.commerce_signals
            + self.content_signals + self.evidence_phrases
        )

    def reach(self) -> int:
        """Characters on either side of a match that can still decide its result."""
        longest = max((len(p) for p in self.all_phrases() + self.keywords + self.state_names),
                      default=0)
        return longest + max(self.evidence_margin, self.negation_window, 32)

    def but(self, **changes) -> "RuleSet":
        return replace(self, **changes)


DEFAULT_RULES = RuleSet()

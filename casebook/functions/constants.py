"""Fixed values.

Every value in this module must equal the behaviour being reproduced (word
lists, rule tables, patterns, caps, formats), so they are written out plainly
and in their natural order.  Users can pass their own tables to every
operator; these are only the defaults.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — text caps and suffixes
# ---------------------------------------------------------------------------
CELL_CAP = 100_000
CELL_CAP_SUFFIX = "... [TRUNCATED]"
FILE_HEAD_CAP = 10_000
FILE_HEAD_SUFFIX = "... [truncated]"
LOG_TAIL_CAP = 5_000
SUMMARY_CHARS = 600
SUMMARY_READ_CHARS = 1_800
QUERY_CHARS = 500
SUBSTANTIAL_MESSAGE_CHARS = 50

# ---------------------------------------------------------------------------
# FIXED VALUES — rule above a support section
# ---------------------------------------------------------------------------
SUPPORT_SECTION_RULE = "-" * 72

# ---------------------------------------------------------------------------
# FIXED VALUES — default technical keyword patterns (group 1 is the keyword)
# ---------------------------------------------------------------------------
DEFAULT_PATTERNS = [
    r"\b(agent|service|process)\b",
    r"\b(crash|error|failure|timeout)\b",
    r"\b(memory|cpu|performance)\b",
    r"\b(network|connectivity|firewall)\b",
    r"\b(sync|synchronization)\b",
    r"\b(authentication|auth)\b",
    r"\b(macos|windows|linux)\b",
    r"\b(policy|configuration)\b",
    r"\b(telemetry|reporting)\b",
    r"\b(installation|deployment)\b",
    r"\b(detection|engine)\b",
    r"\b(security|protection)\b",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — short stop list used by term overlap and explanations
# ---------------------------------------------------------------------------
SHORT_STOPWORDS = [
    "the", "and", "for", "with", "this", "that", "from", "into", "your", "their",
    "have", "has", "had", "not", "are", "was", "were", "but", "you", "will",
    "can", "should", "could", "would", "about", "such", "than", "then", "them",
    "they", "its", "also", "more", "most", "some", "any", "all", "each", "other",
    "only", "very", "over", "under", "out", "our", "how", "why", "what", "when",
    "where", "which", "whose", "after", "before", "during", "while", "among",
    "between", "against", "without", "within", "per", "via", "of", "to", "in",
    "on", "at", "by", "as", "is", "it", "be", "or", "an", "a",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — explanation flag word lists (substring tests on lower text)
# ---------------------------------------------------------------------------
PLATFORM_WORDS = ["linux", "windows", "debian", "rhel", "ubuntu", "centos", "redhat", "macos"]
SECURITY_WORDS = ["defender", "mde", "endpoint", "security", "edr", "av", "antivirus"]
CONFIGURATION_WORDS = ["policy", "configuration", "deployment", "onboarding", "selinux", "kernel"]
PLATFORM_SENTENCE = "Platform-specific troubleshooting guidance. "
SECURITY_SENTENCE = "Security product troubleshooting. "
CONFIGURATION_SENTENCE = "Configuration and deployment guidance. "
MATCH_SENTENCE_PREFIX = "Article matches incident based on technical terms: "
NO_MATCH_SENTENCE = "Article relevant based on semantic similarity. "

# ---------------------------------------------------------------------------
# FIXED VALUES — rule dictionaries.  Each rule is (label, groups), evaluated
# as substring tests on the lower-cased text: the rule fires when every
# group has at least one needle in the text.  A single group is an "or";
# several groups are an "and" of "or"s.
# ---------------------------------------------------------------------------
RULE_SETS: dict[str, list[tuple[str, list[list[str]]]]] = {
    "technical_issues": [
        ("Device control policy issue", [["policy"], ["device"]]),
        ("Whitelist/exclusion configuration issue", [["whitelist", "exclusion"]]),
        ("JAMF Pro deployment issue", [["jamf"]]),
        ("Mobile device connectivity issue", [["mobile"], ["device"]]),
        ("File synchronization failure", [["sync"], ["fail"]]),
    ],
    "affected_components": [
        ("Microsoft Defender for Endpoint", [["mdatp", "mde"]]),
        ("JAMF Pro", [["jamf"]]),
        ("macOS Finder", [["finder"]]),
        ("File synchronization", [["files"]]),
        ("Device Control Policy", [["device control"]]),
    ],
    "error_patterns": [
        ("Unexpected behavior reported", [["unexpected behavior"]]),
        ("Functionality not working as expected", [["not working"]]),
        ("No data displayed", [["no data"]]),
        ("Connection issues", [["cannot connect"]]),
    ],
    "technical_details": [
        ("JWT token authentication", [["jwt", "token"]]),
        ("communication issues", [["impaired communication"]]),
        ("authentication problems", [["authentication"]]),
        ("authentication reset required", [["reset"], ["auth"]]),
        # the number test of this rule runs on the original-case text
        ("large scale deployment", [["machines"], ["@300", "@304", "@100+", "@200+"]]),
        ("Microsoft Defender for Endpoint", [["defender"]]),
        ("macOS platform", [["macos", "mac os"]]),
    ],
    "platforms": [
        ("macOS", [["macos", "mac os"]]),
        ("Windows", [["windows"]]),
        ("Linux", [["linux"]]),
        ("RHEL", [["rhel", "red hat"]]),
        ("Ubuntu", [["ubuntu"]]),
        ("CentOS", [["centos"]]),
    ],
    "components": [
        ("Microsoft Defender", [["defender"]]),
        ("Endpoint Protection", [["endpoint"]]),
        ("MDE", [["mde"]]),
        ("MDE Sensor", [["sensor"]]),
        ("Security Agent", [["agent"]]),
        ("Authentication System", [["authentication"]]),
        ("JWT Token System", [["jwt"]]),
    ],
    "issue_info": [
        ("communication impairment", [["impaired communication"]]),
        ("invalid configuration", [["not valid", "invalid"]]),
        ("requires support assistance", [["assistance"]]),
        ("reset required", [["reset"]]),
        ("authentication failure", [["authentication"]]),
    ],
    "summary_query_terms": [
        ("macOS", [["macos", "mac os"]]),
        ("Windows", [["windows"]]),
        ("Linux", [["linux"]]),
        ("Microsoft Defender", [["defender"]]),
        ("MDE", [["mde"]]),
        ("Endpoint Protection", [["endpoint"]]),
        ("Microsoft AutoUpdate", [["mau", "microsoft autoupdate"]]),
        ("JAMF", [["jamf"]]),
        ("automatic updates", [["auto update", "automatic update"]]),
        ("deployment", [["deployment"]]),
        ("version management", [["version"]]),
        ("compliance", [["compliance"]]),
        ("JWT token authentication", [["jwt", "token"]]),
        ("communication issues", [["impaired communication"]]),
        ("authentication problems", [["authentication"]]),
        ("authentication reset", [["reset"]]),
        # original-case number test
        ("large scale deployment", [["@300", "@304", "@100+", "@200+"]]),
    ],
    "message_query_terms": [
        ("macOS", [["macos"]]),
        ("Microsoft Defender", [["defender"]]),
        ("JWT token", [["jwt", "token"]]),
        ("authentication", [["authentication"]]),
        ("communication", [["communication"]]),
    ],
}
# A needle starting with "@" is tested against the original-case text.
# Sets whose output is a set (sorted, distinct) rather than an ordered list:
SET_RULE_SETS = {"platforms", "components"}
# Sets whose labels are joined with ", " into one string:
JOINED_RULE_SETS = {"technical_details", "issue_info"}
DEFAULT_QUERY = "Microsoft Defender Endpoint troubleshooting"

# ---------------------------------------------------------------------------
# FIXED VALUES — log analysis
# ---------------------------------------------------------------------------
KEY_LOG_FILES = ["health.txt", "config.txt", "exclusions.txt", "definitions.txt",
                 "log.txt", "console.txt", "syslog.txt"]
LOG_PROMPT_FILES = ["health.txt", "config.txt", "exclusions.txt"]

# ---------------------------------------------------------------------------
# FIXED VALUES — image MIME subtype → file extension
# ---------------------------------------------------------------------------
IMAGE_EXTENSIONS = {"png": "png", "jpeg": "jpg", "jpg": "jpg", "gif": "gif",
                    "svg+xml": "svg", "webp": "webp"}
DEFAULT_IMAGE_EXTENSION = "bin"

# ---------------------------------------------------------------------------
# FIXED VALUES — gap report file name: <prefix><incident>_<title>.txt
# ---------------------------------------------------------------------------
GAP_REPORT_PREFIX = "gap_analysis_"
GAP_REPORT_SUFFIX = ".txt"

# ---------------------------------------------------------------------------
# FIXED VALUES — model cost defaults (per 1K tokens)
# ---------------------------------------------------------------------------
INPUT_COST_PER_1K = 0.01
OUTPUT_COST_PER_1K = 0.03

# ---------------------------------------------------------------------------
# FIXED VALUES — the default English stop list of Spark MLlib's
# StopWordsRemover (181 words), written out so that nothing has to find a jar.
# ---------------------------------------------------------------------------
ENGLISH_STOPWORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
    hers herself it its itself they them their theirs themselves what which who whom this that these
    those am is are was were be been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where
    why how all any both each few more most other some such no nor not only own same so than too very s
    t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
    they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
    weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
    couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
    would
""".split()


def english_stopwords() -> list[str]:
    """Default stop list of the TF-IDF operators; callers may pass their own."""
    return list(ENGLISH_STOPWORDS)

"""Word lists, regular expressions and numeric tables used by the text rules.

Patterns are written once in a neutral form (``\\b``, ``\\B``, ``\\s`` with
ECMAScript meaning: ASCII word characters, Unicode white space) and rendered
for the JVM with :func:`jvm_regex`.
"""

from __future__ import annotations

import re
from fractions import Fraction

# --------------------------------------------------------------------------
# These lists decide results, so they are stated plainly here.
# --------------------------------------------------------------------------

STOP_TERMS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "for", "how", "i", "in", "is", "it", "me", "my",
    "of", "on", "or", "our", "the", "this", "to", "we", "what", "you",
]

LOW_SIGNAL_PHRASES = ["hi", "hello", "thanks", "thank you", "okay", "ok", "cool", "great"]

SMALL_TALK_WORDS = [
    "hi", "hello", "hey", "ok", "okay", "thanks", "bye", "yes", "no", "sure", "great", "cool",
    "good", "nice", "how are you",
]

# The stores use a shorter greeting list than the chat turn does.
STORE_SMALL_TALK_WORDS = [
    "hi", "hello", "hey", "ok", "okay", "thanks", "bye", "yes", "no", "sure", "great", "cool",
]

# (domain, weight, terms), in rule order
DOMAIN_RULES = [
    ("identity", 0.95, ["my name is", "i am", "i'm", "we are", "identity", "profile"]),
    ("memory_system", 0.9, [
        "memory", "metadata", "retrieval", "embedding", "working memory", "vector", "qdrant",
        "neo4j", "postgres", "redis", "mongo"]),
    ("architecture", 0.85, [
        "architecture", "pipeline", "system", "orchestrator", "processor", "storage", "database",
        "api", "backend"]),
    ("project", 0.82, ["project", "capstone", "mvp", "demo", "feature", "roadmap", "requirement"]),
    ("preference", 0.78, [
        "i prefer", "i like", "i dislike", "i want", "we want", "preference", "style"]),
    ("planning", 0.74, [
        "plan", "next step", "todo", "deadline", "schedule", "today", "tomorrow", "yesterday",
        "last time", "previously"]),
    ("engineering", 0.72, [
        "code", "bug", "test", "deploy", "server", "client", "frontend", "repository", "function",
        "class"]),
    ("business", 0.66, [
        "customer", "market", "pricing", "revenue", "business", "sales", "startup", "product"]),
    ("education", 0.64, [
        "learn", "study", "course", "college", "exam", "assignment", "teacher", "student"]),
    ("personal", 0.62, ["family", "friend", "home", "birthday", "hobby", "personal"]),
]

IDENTITY_SHORTCUT = r"\b(my name is|i am|i'm|we are)\b"
PREFERENCE_SHORTCUT = r"\b(i prefer|i like|i dislike|i want|we want)\b"

FACTUAL_PATTERNS = [
    r"\b(my name is|i am|i'm|we are|i'm a|i am a)\b",
    r"\b(i prefer|i like|i dislike|i want|we want|i don't want)\b",
    r"\b(my project|our project|our goal|my goal|i own|we own)\b",
    r"\b(i'm based in|i live in|i work at|i study at|my role is)\b",
    r"\b(i decided|we decided|i chose|we chose)\b",
    r"\b(my email|my phone|my username|my password|my url|my domain)\b",
    r"\b(my (mother|father|sibling|spouse|partner|daughter|son))\b",
    r"\b(i studied|i graduated|i majored|my degree|my certification)\b",
]
EPISODIC_PATTERNS = [
    r"\b(yesterday|today|this morning|this afternoon|tonight)\b",
    r"\b(last (time|week|month|day)|earlier|previously|before)\b",
    r"\b(we (discussed|talked|decided|built|made)|you (said|told|mentioned)|i (told|said|mentioned))\b",
    r"\b(i (experienced|encountered|faced|went through|just finished|completed))\b",
    r"\b(when we|during|at that|in that session|that time)\b",
    r"\b(i (built|created|added|fixed|changed|updated).*yesterday|today|last)\b",
    r"\b(in this conversation|in this session|just now|moments ago|a few minutes ago)\b",
    r"\b(first|then|next|after that|later|afterward)\b",
]
SEMANTIC_PATTERNS = [
    r"\b(generally|usually|typically|normally|in general)\b",
    r"\b(concept of|idea|approach|method|strategy|pattern)\b",
    r"\b(because|since|therefore|thus|which means)\b",
    r"\b(react|nodejs|database|api|architecture|algorithm)\b",
    r"\b((all|most|many|some)([\s\w]+)?(is|are|require|need|benefit from|involve))\b",
    r"\b((is defined as|refers to|means|implies|represents|signifies))\b",
    r"\b(best practice|good practice|standard|convention|rule|principle)\b",
]

# (tag, substrings)
TAG_RULES = [
    ("project", ["project", "capstone"]),
    ("memory", ["memory", "retrieval", "embedding"]),
    ("architecture", ["architecture", "pipeline", "system"]),
    ("identity", ["name is", "i am", "i'm"]),
    ("preference", ["prefer", "like", "want"]),
    ("planning", ["plan", "decision", "next step"]),
    ("engineering", ["bug", "code", "test"]),
]

# (type, case-insensitive?, pattern)
ENTITY_PATTERNS = [
    ("email", True, r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("url", True, r"\bhttps?:\/\/[^\s]+"),
    ("date", True,
     r"\b(?:today|tomorrow|yesterday|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
     r"|\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?)\b"),
    ("version", True, r"\bv?\d+\.\d+(?:\.\d+)?\b"),
    ("phone", True, r"\b(?:\+1|1)?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"),
    ("mentions", False, r"\B@[a-zA-Z0-9_]+\b"),
    ("hashtag", False, r"\B#[a-zA-Z0-9_]+\b"),
    ("code_block", False, r"`[^`]+`"),
    ("file_path", False, r"(?:\/[\w.-]+)+|C:\\(?:[\\w.-]+\\)+[\w.-]+"),
]
# text without any of these characters cannot match the pattern
ENTITY_MARKS = {
    "email": ["@"], "url": ["://"], "mentions": ["@"], "hashtag": ["#"], "code_block": ["`"],
    "file_path": ["/", "\\"], "version": ["."],
}
PROPER_NAME_PATTERN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"
IGNORED_NAMES = ["A", "I", "My", "Our", "The", "This", "That", "We", "You"]
MAX_ENTITIES = 10

NUMBER_PATTERN = r"\b\d+\b"
REASON_PATTERN = r"\b(because|so that|means|requires|must|should|will|decided)\b"
HEDGE_PATTERN = r"\b(maybe|perhaps|not sure|i think|probably)\b"
DECISION_PATTERN = r"\b(decision|plan|architecture|next step|we should)\b"
KEY_WORD_PATTERN = r"\b(my name is|project|capstone|goal|want|architecture|decision|must|important|major)\b"

STABLE_TERMS = ["my name is", "i am", "i'm", "we are", "i prefer", "we want", "our project"]
TEMPORAL_TERMS = ["today", "tomorrow", "yesterday", "currently", "now", "temporary"]
LASTING_TERMS = ["always", "usually", "default", "primary", "major"]
ACTION_TERMS = [
    "need to", "have to", "must", "should", "lets", "let's", "work on", "add", "fix", "build",
    "change", "improve",
]
PLANNING_TERMS = ["next step", "todo", "deadline", "plan", "decision"]
POSITIVE_TERMS = ["like", "prefer", "good", "great", "best", "clear", "improve", "working"]
NEGATIVE_TERMS = ["dislike", "bad", "issue", "problem", "bug", "failed", "wrong", "not working"]
FACT_TERMS = ["my name is", "i prefer", "i want", "we want", "our project"]
UNCERTAIN_TERMS = ["maybe", "perhaps", "not sure", "i think", "probably", "might"]

MEMORY_QUERY_PREFIXES = [
    "what do you remember", "do you remember", "can you remember", "what do you know",
]
# Replies produced without a model: an opening "<assistant name> demo response:"
# or the notice below.
DEMO_REPLY_PATTERN = r"^\w+ demo response:"
FALLBACK_REPLY_NOTICE = "currently running with a local fallback responder"
ASSISTANT_KEEP_TERMS = ["plan", "decision", "architecture", "we should", "next step"]

# (pattern, replacement), applied in this order
CONTRACTIONS = [
    (r"won't", "will not"), (r"can't", "cannot"), (r"n't\b", " not"), (r"i'm\b", "i am"),
    (r"i've\b", "i have"), (r"i'll\b", "i will"), (r"i'd\b", "i would"), (r"it's\b", "it is"),
    (r"that's\b", "that is"), (r"they're\b", "they are"), (r"we're\b", "we are"),
    (r"you're\b", "you are"),
]

CONFLICT_STOP_WORDS = [
    "the", "and", "for", "are", "was", "were", "has", "have", "had", "not", "but", "with", "from", "that", "this",
    "they", "their", "our", "its", "now", "use", "using", "used", "will", "can", "into", "onto", "been", "also",
    "more", "than", "then",
]
CONSOLIDATION_STOP_WORDS = [
    "the", "and", "for", "are", "was", "were", "has", "have", "had", "not", "but", "with", "from", "that", "this",
    "they", "their", "our", "its", "now", "use", "using", "used", "will", "can", "into", "onto", "been", "also",
    "more", "than", "then", "just", "all", "any", "some", "over", "such", "when", "there", "about", "which", "your",
    "would", "could", "should", "get", "got", "may", "his", "her", "him", "she", "who", "what", "how", "why",
    "where", "yes", "let", "did", "does",
]

# topics looked up in two statements that may contradict each other
CONFLICT_TOPICS = [
    ("location", r"\b(?:i live|i'm based|i am based|i moved|my (?:home|city|location) is)\b"),
    ("employment",
     r"\b(?:i work at|i'm working at|i am working at|my (?:job|company|employer) is|i joined)\b"),
    ("project_db",
     r"\b(?:uses?|using|we use|switched to|migrated to)\s+"
     r"\w+(?:db|sql|mongo|postgres|redis|mysql|dynamo|neo4j|qdrant)\b"),
    ("preference", r"\b(?:i prefer|i like|my (?:favorite|preferred)|i (?:switched|changed) to)\b"),
    ("tech_stack",
     r"\b(?:we (?:use|are using|switched to)|our (?:stack|backend|frontend|database|framework|language) is)\b"),
    ("name", r"\b(?:my name is|i am called|people call me|call me)\b"),
    ("age", r"\b(?:i am|i'm)\s+\d+\s+(?:years? old|yo)\b"),
]
# topics voted on by the members of a consolidation group
GROUP_TOPICS = [
    ("location", r"\b(?:live|based|city|town|location|moved|home)\b"),
    ("employment", r"\b(?:work|job|company|employer|hired|joined|role|position)\b"),
    ("tech_stack",
     r"\b(?:uses?|using|stack|backend|frontend|database|framework|language|library|tool)\b"),
    ("project", r"\b(?:project|feature|roadmap|mvp|demo|requirement|task)\b"),
    ("preference", r"\b(?:prefer|like|dislike|favourite|favorite|want)\b"),
    ("identity", r"\b(?:name|am|called|known|age|years old)\b"),
    ("planning", r"\b(?:plan|schedule|deadline|next|todo|step)\b"),
]

NOISY_ENTITY_TYPES = ["code_block", "file_path", "mentions", "hashtag"]

# entity graph: phrases and capitalised names
MULTI_PROPER_PATTERN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
SINGLE_PROPER_PATTERN = r"\b([A-Z][a-zA-Z]{2,})\b"
ORGANIZATION_PATTERN = r"\b(?:Inc|Ltd|LLC|Corp|Co)\b"
TASK_PATTERN = (
    r"\b(?:implement|build|create|add|fix|refactor|write|set up|deploy|update|remove|delete|migrate"
    r"|test|review|design)\s+(.{3,60}?)(?:[,;.]|$)")
PREFERENCE_PATTERN = (
    r"\b(?:i prefer|i like|i love|i want|i use|i rely on|i depend on)\s+(.{3,60}?)(?:[,;.]|$)")
DECISION_PHRASE_PATTERN = (
    r"\b(?:(?:i|we) decided(?: to)?|(?:i|we) chose|(?:i|we) picked|(?:i|we) went with)\s+"
    r"(.{3,60}?)(?:[,;.]|$)")
PROPER_SKIP = [
    "The", "This", "That", "These", "Those", "When", "Where", "What", "Which", "How", "Why", "Who", "Will", "Can",
    "Let", "Yes", "No", "Ok", "Just", "We", "I", "My", "Our", "Its", "In", "On", "At", "For", "To", "From", "With",
    "And", "But", "Or", "If", "So", "Not",
]
ENTITY_PRIORITY = [
    "person", "project", "organization", "task", "decision", "preference", "topic", "event",
]
RELATIONSHIP_TYPES = [
    "works_on", "related_to", "depends_on", "decided", "assigned_to", "prefers", "mentioned_in",
    "completed", "belongs_to",
]
WORKS_ON_PATTERN = (
    r"\b(?:working on|assigned to|in charge of|responsible for|owns|leading|implementing)\b")
DEPENDS_ON_PATTERN = (
    r"\b(?:depends on|requires|needs|built on top of|is blocked by|relies on)\b")
COMPLETED_PATTERN = r"\b(?:completed|finished|done with|shipped|released|merged)\b"

# job errors
TRANSIENT_CODES = [
    "ECONNRESET", "ECONNREFUSED", "ETIMEDOUT", "ENOTFOUND", "EHOSTUNREACH", "EPIPE",
    "ECONNABORTED", "EAI_AGAIN", "ENETUNREACH", "ENOBUFS", "EADDRNOTAVAIL",
]
TRANSIENT_STATUS = [408, 425, 429, 500, 502, 503, 504]
TRANSIENT_NAMES = ["AbortError", "FetchError"]
TRANSIENT_SUBSTRINGS = [
    "timeout", "econnreset", "rate limit", "socket hang up", "connection reset", "network error",
    "enotfound", "socket closed", "redis connection", "resource exhausted", "service unavailable",
    "too many requests", "upstream connect error", "connect timeout", "read timeout",
    "write timeout", "socket timeout", "request timed out",
]
PERMANENT_STATUS = [400, 401, 403, 404, 422]
PERMANENT_NAMES = ["SyntaxError", "TypeError", "RangeError", "URIError"]
PERMANENT_SUBSTRINGS = [
    "invalid payload", "missing required", "validation error", "malformed", "unknown job type",
    "invalid job", "schema error", "not a function", "cannot read properties",
    "is not a constructor", "is not defined", "invalid argument", "bad request", "unauthorized",
    "forbidden", "not found",
]

# latency bucket bounds, seconds
HTTP_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]
JOB_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10, 30]
RETRIEVAL_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2, 5]
RERANK_BUCKETS = [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.025, 0.05, 0.1]
RESULT_COUNT_BUCKETS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16]

# --------------------------------------------------------------------------
# Regex rendering
# --------------------------------------------------------------------------

#: white space as ECMAScript defines it, usable inside a character class
WHITE_SPACE = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WHITE_SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_WORD = "[A-Za-z0-9_]"
_BEFORE, _AFTER = f"(?<!{_WORD})", f"(?!{_WORD})"
_BOUNDARY = f"(?:{_BEFORE}(?={_WORD})|(?<={_WORD}){_AFTER})"
_NOT_BOUNDARY = f"(?:{_BEFORE}{_AFTER}|(?<={_WORD})(?={_WORD}))"
_WORD_AHEAD = re.compile(r"(?:\((?:\?:)?)*[A-Za-z0-9]|\[[A-Za-z0-9-]+\]")


def expand_white_space(pattern: str) -> str:
    """Replace ``\\s`` by the explicit class, inside or outside brackets."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(WHITE_SPACE if in_class else f"[{WHITE_SPACE}]")
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            if two[0] == "[":
                in_class = True
            elif two[0] == "]":
                in_class = False
            out.append(two[0])
            i += 1
    return "".join(out)


def jvm_regex(pattern: str, ignore_case: bool = False) -> str:
    """Render a neutral pattern for ``java.util.regex``.

    Java's ``\\b`` is Unicode-aware, so boundaries are spelled out.  A leading
    ``\\b`` in front of a word character and a trailing one behind a word
    character need one look-around only.
    """
    text = expand_white_space(pattern)
    if text.startswith(r"\b") and _WORD_AHEAD.match(text, 2):
        text = _BEFORE + text[2:]
    if text.endswith(r"\b") and text[-3:-2].isalnum() or text.endswith(")\\b") and _ends_in_words(text):
        text = text[:-2] + _AFTER
    text = text.replace(r"\b", _BOUNDARY).replace(r"\B", _NOT_BOUNDARY)
    return ("(?i)" if ignore_case else "") + text


def _ends_in_words(pattern: str) -> bool:
    """True when the final group is an alternation of branches that end in a letter."""
    body = pattern[:-2]
    if re.search(r"[?*+}\]](?:\||\)+$)", body):
        return False
    return all(branch.rstrip(")")[-1:].isalnum() for branch in body.split("|"))


# --------------------------------------------------------------------------
# Two-decimal rounding cut points
# --------------------------------------------------------------------------


def _cut_points() -> list[float]:
    """Smallest doubles that round up to 0.01, 0.02 … 1.00 at two decimals.

    Rounding looks at the exact binary value, so 0.155 (stored slightly below)
    gives 0.15.  Entry ``k`` is the first double at or above ``(k + 0.5)/100``.
    """
    import math

    cuts = []
    for k in range(100):
        value = (k + 0.5) / 100
        if Fraction(value) < Fraction(2 * k + 1, 200):
            value = math.nextafter(value, 1.0)
        cuts.append(value)
    return cuts


ROUND_CUTS = _cut_points()

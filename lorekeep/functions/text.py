"""Text functions as column expressions: tokens, n-grams, fingerprints, clean-up, redaction, signals.

All stay on the JVM side; a null text counts as empty unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern and its limit.
TOKEN = r"[a-z0-9_./:@-]+|[一-鿿]+"
LATIN = r"[a-z0-9_./:@-]{2,}"
MAX_TOKENS = 2000


def text_of(c: Column | str) -> Column:
    """The text, or empty for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """Lower-case tokens: Latin runs of two letters and more, CJK runs as bigrams; the first 2000."""
    low = F.lower(text_of(c))
    runs = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    cjk = lambda t: t.rlike("^[一-鿿]")
    pieces = F.transform(
        runs,
        lambda t: F.when(cjk(t) & (F.length(t) > 1), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))
        .when(cjk(t) | (F.length(t) > 1), F.array(t))
        .otherwise(F.array().cast("array<string>")),
    )
    # Without CJK letters the runs of two letters and more are the tokens as they stand.
    latin = F.regexp_extract_all(low, F.lit(LATIN), F.lit(0))
    return F.slice(F.when(low.rlike("[一-鿿]"), F.flatten(pieces)).otherwise(latin), 1, MAX_TOKENS)


def char_bigrams(c: Column | str) -> Column:
    """Distinct character pairs of the cleaned title; a title under two letters is its own only member.

    The cleaned title is bound once, so that a title that is itself an expression is not computed for each pair.
    """
    t = F.trim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9一-鿿]+", " "))
    pairs = lambda x: F.when(F.length(x) < 2, F.array(x)).otherwise(F.array_distinct(F.regexp_extract_all(x, F.lit("(?=(..))"), F.lit(1))))
    return F.get(F.transform(F.array(t), pairs), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(both / union)


def fingerprint(kind: Column, title: Column, content: Column) -> Column:
    """24 hex digits that ignore letter case and the amount of white space."""
    joined = F.concat_ws("\n", text_of(kind), text_of(title), text_of(content))
    plain = F.trim(F.regexp_replace(F.lower(joined), r"\s+", " "))
    return F.substring(F.sha2(plain.cast("binary"), 256), 1, 24)


def estimated_tokens(c: Column | str) -> Column:
    """ceil(CJK letters / 1.5 + other letters / 4)."""
    t = text_of(c)
    cjk = F.regexp_count(t, F.lit("[一-鿿぀-ヿ가-힯]"))
    return F.ceil(cjk / F.lit(1.5) + (F.length(t) - cjk) / F.lit(4.0)).cast("long")


def first_sentence(c: Column | str, limit: int = 200) -> Column:
    """Up to the first sentence end, else the whole text; at most ``limit`` letters, so one letter more than that, white space aside, tells it."""
    t = F.regexp_replace(F.regexp_extract(text_of(c), rf"^\s*+((?:\s*+\S){{0,{limit + 1}}}+)", 1), r"\s+", " ")
    found = F.regexp_extract(t, r"^(.*?[.!?。！？])(?:\s|$)", 1)
    return F.substring(F.when(found == "", t).otherwise(found), 1, limit)


# What a line may begin with (containers and headings), lines that are only a rule, and inline marks around text.
# Groups are possessive, so texts, targets and rules of any length need no deep stack.
_BLOCK_START = r"^ {0,3}(?:(?:> ?)++|#{1,6}(?:[ \t]+|$)|(?:[-*+]|\d{1,9}[.)])[ \t]+)"
_RULE = r"^ {0,3}(?:(?:\*[ \t]*+){3,}+|(?:-[ \t]*+){3,}+|(?:_[ \t]*+){3,}+)$"
_FENCE = r"(?ms)^ {0,3}(```+|~~~+).*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)"
_TARGET = r"!?\[([^\[\]]*)\]\((?:[^()\s]++|\([^()]*\))*+(?:\s+[\"'(][^)]*)?\)"
_MARKS = r"(?=[*_~`])(?<![\w\\])(\*{1,3}|_{1,3}|~~|`+)(?=\S)(.+?)(?<=\S)\1(?!\w)"


def strip_markdown(c: Column | str) -> Column:
    """Plain text of CommonMark: fenced code goes; of each line what opens a block goes, up to three deep; links and images leave
    their text, emphasis, strike-through and code spans what they enclose, up to two deep; white space is collapsed."""
    body = F.regexp_replace(text_of(c), _FENCE, " ")

    def line(x: Column) -> Column:
        out = F.regexp_replace(x, _RULE, "")
        for _ in range(3):
            out = F.regexp_replace(out, _BLOCK_START, "")
        return out

    out = F.regexp_replace(F.array_join(F.transform(F.split(body, r"\r?\n"), line), " "), _TARGET, "$1")
    for _ in range(2):
        out = F.regexp_replace(out, _MARKS, "$2")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def redact(c: Column | str) -> Column:
    """Secrets by marks; the name of an assigned secret stays."""
    out = text_of(c)
    # What counts as a secret, and its mark.
    for pattern, by in (
        (r"(?i)-----BEGIN [^-]*PRIVATE KEY-----[\s\S]*?-----END [^-]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
        (r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]"),
        (r"(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)\s*[:=]\s*[\"']?[^\s\"']{6,}[\"']?", "$1=[REDACTED]"),
        (r"\b(?:sk|ghp|github_pat|xox[baprs])[-_][A-Za-z0-9_-]{12,}\b", "[REDACTED_TOKEN]"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return out


# The six named entities.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(c: Column | str) -> Column:
    """Visible text of a page: no comments, scripts, styles or tags; named entities decoded; white space collapsed."""
    out = F.regexp_replace(text_of(c), r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, letter in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(letter))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def compact(c: Column | str, limit: int) -> Column:
    """The longest run of whole sentences within ``limit`` letters (40 at least), else the cut text and an ellipsis."""
    t = F.trim(F.regexp_replace(text_of(c), r"\s+", " "))
    head = F.substring(t, 1, max(40, limit))
    whole = F.regexp_extract(head, r"^(.*[.!?。！？])", 1)
    return F.when(F.length(t) <= max(40, limit), t).when(F.length(whole) >= 40, whole).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…")))


def normalised(c: Column | str) -> Column:
    """Lower case without white space and punctuation."""
    return F.lower(F.regexp_replace(text_of(c), r"[\s\p{P}]", ""))


def grounded(evidence: Column, transcript: Column, window: int = 30, stride: int = 15) -> Column:
    """Does normalised evidence (6 letters and more, of its first 200) or a 30-letter window of it stand in the normalised transcript?"""
    e = normalised(F.substring(F.trim(text_of(evidence)), 1, 200))
    t = normalised(transcript)
    starts = F.sequence(F.lit(0), F.greatest(F.length(e) - window, F.lit(0)), F.lit(stride))
    windows = F.exists(starts, lambda i: F.contains(t, F.substring(e, i + 1, F.lit(window))))
    return (F.length(F.trim(text_of(evidence))) >= 6) & (F.length(e) >= 6) & (F.contains(t, e) | ((F.length(e) > window) & windows))


def base36(c: Column) -> Column:
    """A non-negative number in base 36, lower case."""
    return F.lower(F.conv(c.cast("string"), 10, 36))


def safe_id(c: Column | str, limit: int = 72) -> Column:
    """Lower-case letters, digits, dashes and underscores; other runs become dashes, none at the ends; ``item`` if nothing is left."""
    text = F.when(text_of(c) == "", "item").otherwise(text_of(c))
    plain = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.when(plain == "", "item").otherwise(plain)


def memory_document(title: Column, content: Column, tags: Column | None = None, files: Column | None = None, kind: Column | None = None) -> Column:
    """What ranking reads of a record: its title twice, content, tags, files and type, those that are there, a line each."""
    parts = [title, title, content, F.array_join(tags, " ") if tags is not None else None, F.array_join(files, " ") if files is not None else None, kind]
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts if p is not None))


def fnv1a(c: Column | str) -> Column:
    """FNV-1a of the UTF-16 units of letters up to U+FFFF, 32 bits, 8 hex digits."""
    codes = F.transform(F.filter(F.split(text_of(c), ""), lambda x: x != ""), F.ascii)
    step = lambda h, x: (h.bitwiseXOR(x.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step))), 8, "0")


def age_label(age_ms: Column) -> Column:
    """today, yesterday, N days, N months."""
    days = F.floor(F.greatest(age_ms, F.lit(0)) / 86_400_000).cast("long")
    return F.when(days == 0, "today").when(days == 1, "yesterday").when(days < 60, F.concat(days.cast("string"), F.lit(" days"))).otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months")))


def lenient_json(c: Column | str) -> Column:
    """The first object of a text as JSON: fences and what stands around it off, commas before a closing brace dropped; null if it can't be read."""
    body = F.regexp_extract(F.regexp_replace(text_of(c), "```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    fixed = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(fixed).isNotNull() & (fixed != ""), fixed)

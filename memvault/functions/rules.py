"""Rule tables: category inference, lenient synonyms, and extraction from conversations.

Rules are data; ``case`` turns them into one CASE expression, first match wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memvault.functions.text import trim

# fixed values: (category, beginnings, parts) in order of precedence; None stands for the credential url test
CATEGORY_RULES: list[tuple[str, tuple[str, ...], tuple[str, ...] | None]] = [
    ("password", ("password:", "secret:", "credential:"), ()),
    ("error", ("error:", "bug:", "panic:", "exception:"), ()),
    ("preference", ("preference:",), ()),
    ("instruction", ("rule:", "instruction:", "runbook:", "how to "), ()),
    ("decision", ("decision:",), ()),
    ("goal", ("goal:", "objective:", "okr:", "milestone:"), ()),
    ("commitment", ("todo:", "commitment:", "action item:"), ()),
    ("learning", ("learning:", "til:"), ()),
    ("event", ("event:", "incident:"), ()),
    ("relationship", ("relationship:",), ()),
    ("observation", ("observation:",), ()),
    ("artifact", ("artifact:",), ()),
    ("context", ("context:", "background:"), ()),
    ("fact", ("fact:",), ()),
    ("password", (), None),
    ("password", (), ("password:", "password is", "api_key", "api key", "secret_key", "secret key", "signing secret", "webhook secret", "auth token", "private key")),
    ("error", (), ("panic:", "panic in ", "fix panic", "panicked", "segfault", "stack trace", "failed with", "connection refused", "connection timeout", "pool exhausted", "deadlock", "timeout error", "out of memory", "exception:")),
    ("decision", (), ("we decided", "decided to ", "agreed to ", "standardized on ", "switched from ", "migrating to ", "chosen over ", "is deprecated", "adopted ")),
    ("instruction", ("never ", "do not ", "don't "), ("prevent ", " never ", "must always ", "must never ", " do not ", " don't ")),
    ("preference", (), ("prefers ", "prefer ", "user prefers", "likes to use ", "favorite ", "dark mode", "keybindings")),
    ("instruction", ("always ",), ("make sure to ", "step 1")),
    ("goal", (), ("objective:", "roadmap ", "our goal is", "target is to ", "aiming to ", "okr:", "milestone:")),
    ("commitment", (), ("promised to ", "committed to ", "will deliver by ", "deadline is ", "due by ")),
    ("learning", (), ("learned that ", "lesson learned", "discovered that ", "turns out that ", "root cause was ", "realized that ", "to avoid process freeze")),
    ("event", (), ("incident occurred", "outage on ", "incident on ", "deployed v", "released v", "meeting with ", "postmortem")),
    ("relationship", (), ("reports to ", "is the maintainer of ", "is the owner of ", "tech lead for ", "manages the ", "works closely with ")),
    ("observation", (), ("noticed that ", "observed that ", "profiling shows ", "metrics show ", "cpu spikes when ", "latency increases when ")),
    ("artifact", (), ("dockerfile", "openapi", "schema definition", "specification saved in ", "located at `", "stored in `src/")),
    ("context", (), ("currently working on ", "for this sprint", "project scope ")),
]

# fixed values: (category, parts, whole words) of lenient category names
SYNONYMS: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("password", ("pass", "secret", "token", "cred", "api_key", "apikey", "private_key"), ("key", "keys")),
    ("instruction", ("instruct", "rule", "runbook", "procedure"), ("process",)),
    ("decision", ("decis", "choice"), ()),
    ("preference", ("pref", "like"), ()),
    ("learning", ("learn", "lesson", "insight"), ()),
    ("goal", ("goal", "target", "objective"), ()),
    ("commitment", ("commit", "todo", "task"), ()),
    ("artifact", ("artif", "code", "document"), ("doc", "docs")),
    ("event", ("event", "incident", "meeting"), ()),
    ("relationship", ("relat", "team", "owner"), ()),
    ("observation", ("obser", "metric"), ()),
    ("error", ("error", "bug", "issue"), ()),
    ("context", ("context", "background"), ()),
]
# fixed values: names that are no category
NO_CATEGORY = ("entity", "node", "item", "record")

# fixed values: (category, confidence, parts, beginnings) of sentences worth keeping
SENTENCE_RULES: list[tuple[str, float, tuple[str, ...], tuple[str, ...]]] = [
    ("preference", 0.94, ("i prefer", "i like", "my favorite", "my default", "i always use", "user prefers", "i dislike", "i hate", "i want to use"), ()),
    ("decision", 0.95, ("we decided", "i decided", "decision is", "let's go with", "we chose", "i chose", "switched to", "switching to", "we will use"), ()),
    ("instruction", 0.93, ("always remember", "always ensure", "make sure to", "rule:", "instruction:", "do not ", "don't "), ("always ", "never ")),
    ("goal", 0.90, ("goal is", "objective is", "target date", "deadline is", "milestone:", "we need to deliver"), ()),
    ("error", 0.92, ("error:", "failed with", "exception:", "panic:", "bug in", "incident:"), ()),
    ("learning", 0.90, ("learned that", "takeaway:", "realized that"), ()),
    ("fact", 0.92, ("runs on port", "port is", "hosted at", "located at", "path is", "version is", "my name is", "my pan", "my email", "password is", "secret is", "endpoint is", "configured with"), ()),
    ("observation", 0.89, ("observed that", "noticed that", "turns out", "found that", "observation:", "note:"), ()),
]
# fixed values: beginnings of questions, and whole acknowledgements
QUESTIONS = ("what ", "how ", "where ", "why ", "when ", "who ", "is there ", "can you ", "could you ")
ACKNOWLEDGEMENTS = ("thank you", "thanks", "sounds good", "looks good", "perfect", "no problem", "you're welcome")
# fixed values: fillers that a turn may begin with, longest alternative as listed
FILLERS = (
    "sure thing,", "sure,", "okay,", "ok,", "understood,", "got it,", "yes,", "yeah,", "yep,", "hey,", "hi there,", "hello,",
    "thanks,", "thank you,", "certainly,", "absolutely,", "great,", "awesome,", "note that", "please note that", "remember that",
    "fyi,", "by the way,", "can you help me with", "could you please", "i wanted to let you know that",
    "i wanted to mention that", "i would like to note that", "just to let you know,",
)
# fixed values: words that become tags
TAG_WORDS = (
    "postgres postgresql mysql sqlite redis mongodb docker kubernetes linux macos windows rust python javascript typescript "
    "react vue nextjs port api auth token jwt tls ssl ssh theme dark-mode light-mode font editor vim vscode terminal zsh bash "
    "cli git github ci cd test deploy server database ui ux"
).split()
# fixed values: first-person beginnings of a user's sentence, and what stands for them
REWRITES = (("i prefer ", "User prefers "), ("i like ", "User likes "), ("i want to ", "User wants to "), ("i always use ", "User always uses "), ("my ", "User's "))

# fixed values: titles and tags that link nothing
GENERIC_TITLES = ("untitled", "note", "fact", "decision", "memory", "scratch", "test", "todo", "temp")
GENERIC_TAGS = ("fact", "decision", "imported", "auto", "default", "quick", "general", "temp")


def any_of(text: Column, beginnings: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    """Whether a text begins with one of beginnings or holds one of parts; one pattern, so that plans stay small."""
    quoted = [rf"^\Q{b}\E" for b in beginnings] + [rf"\Q{p}\E" for p in parts]
    return text.rlike("|".join(quoted))


def has_credential_url(text: Column) -> Column:
    """Whether a word holds ://, @ and two colons or more."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.contains("://") & w.contains("@"))
    return F.exists(words, lambda w: F.size(F.split(w, ":")) >= 3)


def category_of(content: Column) -> Column:
    """The category that a text's wording suggests; fact if none."""
    text = F.lower(trim(content))
    out = None
    for category, beginnings, parts in CATEGORY_RULES:
        test = has_credential_url(text) if parts is None else any_of(text, beginnings, parts)
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.otherwise("fact")


def lenient_category(name: Column) -> Column:
    """The category that a foreign name stands for; null if none."""
    from memvault.schema import CATEGORIES

    text = F.lower(trim(name))
    out = F.when(text.isin("", *NO_CATEGORY), F.lit(None).cast("string")).when(text.isin(*CATEGORIES), text)
    for category, parts, whole in SYNONYMS:
        test = any_of(text, (), parts)
        out = out.when(test | text.isin(*whole) if whole else test, category)
    return out

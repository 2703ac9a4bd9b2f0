"""Fixed values of the evidence pipeline, and the switches for behaviour that users may want otherwise."""

from __future__ import annotations

from dataclasses import dataclass

# Words that ranking, claims and provenance pass over.
RANK_STOP_WORDS = "a an and are as at be but by can do does for from has have how if in into is it its of on or our that the their this to we what when where which with you your".split()
CLAIM_STOP_WORDS = "and are but for from has have into that the this with your you was were will should could would any all its their they them".split()
PROVENANCE_STOP_WORDS = "and are but for from into that the this with your".split()

# Words that a task's or a field's word stands for.
TASK_SYNONYMS = {
    "api": "api sdk endpoint reference developer docs",
    "auth": "auth authentication authorization token oauth",
    "cache": "cache cached caching store storage",
    "command": "command terminal shell cli run",
    "config": "config configuration settings mcp json",
    "docs": "docs documentation guide reference api manual",
    "error": "error exception failure failed troubleshoot",
    "feature": "feature included includes support capability",
    "install": "install installation setup package npm pip",
    "integration": "integration connect plugin api webhook",
    "security": "security safe permission sandbox read-only",
    "server": "server service daemon process stdio",
    "tool": "tool function capability mcp",
}
FIELD_SYNONYMS = {
    "command": "command terminal shell cli run",
    "config": "config configuration settings json",
    "configuration": "config configuration settings json",
    "description": "description summary overview",
    "email": "email e-mail contact",
    "install": "install installation setup",
    "installation": "install installation setup",
    "location": "location address city",
    "purpose": "purpose used use overview",
    "title": "title heading name",
    "updated": "updated modified changed",
}

# Words that negate a claim.
NEGATIONS = ["not", "never", "no longer", "cannot", "can't", "doesn't", "does not", "isn't", "is not", "did not", "without", "deprecated", "unsupported", "disabled", "false"]

# Patterns of text that addresses a reading machine; case doesn't matter.
INJECTION_PATTERNS = {
    "instruction": [
        r"ignore (all )?(previous|above|prior) instructions",
        r"disregard (all )?(previous|above|prior) instructions",
        r"system prompt",
        r"developer message",
        r"you are now",
        r"act as",
        r"follow these instructions",
        r"do not tell (the )?user",
    ],
    "credential": [r"api[_ -]?key", r"access token", r"password", r"cookie", r"secret", r"credential"],
    "exfiltration": [r"send .* (to|via) https?://", r"post .* (to|via) https?://", r"exfiltrat", r"upload .* (secret|credential|token|cookie)"],
}

# Hosts and paths of source classes.
RESEARCH_HOSTS = ["arxiv.org", "doi.org", "pubmed.ncbi.nlm.nih.gov", "semanticscholar.org"]
FORUM_HOSTS = ["reddit.com", "stackoverflow.com", "stackexchange.com", "news.ycombinator.com", "community."]
MARKET_HOSTS = ["github.com", "npmjs.com", "pypi.org", "crates.io"]
NEWS_HOSTS = ["reuters.com", "apnews.com", "bbc.", "nytimes.com", "theverge.com", "techcrunch.com"]
BLOG_HOSTS = ["medium.com", "substack.com"]

SEVERITY = {"high": 0.4, "medium": 0.2, "low": 0.08}


@dataclass(frozen=True)
class EngineConfig:
    """Numbers and switches of the pipeline; the defaults give the documented results."""

    max_chunk_chars: int = 1800
    min_chunk_chars: int = 80
    k1: float = 1.4
    b: float = 0.75
    phrase_bonus: float = 1.5
    heading_boost: float = 0.25
    metadata_boost: float = 0.35
    structured_boost: float = 0.45
    position_prior: float = 0.05
    max_tokens: int = 1800
    min_score: float = 0.05
    cosine_threshold: float = 0.5
    jaccard_threshold: float = 0.18
    shingle: int = 4
    topical_floor: float = 0.45
    contradiction_top: int = 6
    claim_top: int = 6
    claim_min_score: float = 0.25
    claim_min_coverage: float = 0.25
    confidence_top: str = "first_by_id"  # or "best_score"
    typed_leaves: bool = False  # a schema leaf "number" or "boolean" names a type rather than a string


DEFAULTS = EngineConfig()

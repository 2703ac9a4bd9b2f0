"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CLAIM_STOP_WORDS, NEGATIONS, PROVENANCE_STOP_WORDS, RANK_STOP_WORDS, TASK_SYNONYMS


def strings(words: Iterable[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def rounded(c: Column, places: int = 4) -> Column:
    """A double rounded as the SQL does: scaled first, then half away from zero.  round() takes the shortest decimal print instead."""
    return F.round(c * float(10**places)) / float(10**places)


def strip(c: Column) -> Column:
    """Without white space at both ends (trim() only takes blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Unix line ends, no blanks before them, at most one empty line, single blanks, trimmed."""
    for pattern, by in ((r"\r\n", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        c = F.regexp_replace(c, pattern, by)
    return strip(c)


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def normalize_match(c: Column) -> Column:
    return one_line(F.lower(c))


def words(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; may hold empty strings at the ends."""
    return F.split(F.lower(c), "[^a-z0-9]+")


def tokens(c: Column) -> Column:
    """Ranking terms, with repeats."""
    return F.filter(words(c), lambda t: (F.length(t) > 1) & ~t.isin(RANK_STOP_WORDS))  # a long list of literals becomes a hash set


def expand(terms: Column) -> Column:
    """Task terms with their synonyms, each once, in order."""
    table = F.create_map(*[x for k, v in TASK_SYNONYMS.items() for x in (F.lit(k), strings(v.split()))])
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t)))))


def task_terms(task: Column) -> Column:
    return expand(tokens(task))


def phrases(c: Column) -> Column:
    """Parts of two or more words between commas, stops, colons and semicolons."""
    parts = F.transform(F.split(F.lower(c), "[,.;:]"), strip)
    return F.filter(parts, lambda p: F.size(F.split(p, r"\s+")) >= 2)


def claim_terms(c: Column) -> Column:
    return F.array_distinct(F.filter(words(c), lambda t: (F.length(t) > 2) & ~t.isin(CLAIM_STOP_WORDS)))


def provenance_terms(c: Column) -> Column:
    return F.array_distinct(F.filter(words(c), lambda t: (F.length(t) > 2) & ~t.isin(PROVENANCE_STOP_WORDS)))


def query_term_count(c: Column) -> Column:
    return F.size(F.filter(words(c), lambda t: F.length(t) > 2))


def shingle_words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " +"), lambda t: F.length(t) > 1)


def word_runs(w: Column, n: int = 4) -> Column:
    """Distinct runs of n words; empty below n words.  w is named often, so it should be a column."""
    # the shifted arrays side by side: naming w within a lambda would split the text again for each run
    runs = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(F.size(w) - i, F.lit(0))).alias(f"w{i}") for i in range(n)])
    whole = F.slice(runs, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
    return F.array_distinct(F.transform(whole, lambda r: F.concat_ws(" ", *[r[f"w{i}"] for i in range(n)])))


def shingles(c: Column, n: int = 4) -> Column:
    return word_runs(shingle_words(c), n)


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays of distinct values."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length, empty ones or zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def sentences(c: Column) -> Column:
    """Sentences of 30 to 280 letters that begin with a capital or a digit."""
    parts = F.transform(F.split(F.regexp_replace(c, r"\s+", " "), r"(?<=[.!?])\s+(?=[A-Z0-9])"), strip)
    return F.filter(parts, lambda s: F.length(s).between(30, 280))


def negated(text: Column, terms: Column) -> Column:
    """Some sentence holds one of the terms and a negation."""
    pattern = "(?<![A-Za-z0-9_])(?:" + "|".join(NEGATIONS) + ")(?![A-Za-z0-9_])"
    parts = F.split(F.lower(text), r"(?<=[.!?])\s+")
    return F.exists(parts, lambda s: F.exists(terms, lambda t: F.instr(s, t) > 0) & s.rlike(pattern))


def coverage(matched: Column, terms: Column) -> Column:
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(terms, matched)) / F.size(terms))


def preview(c: Column, most: int) -> Column:
    line = one_line(c)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most - 3), F.lit("...")))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("int")


def last_index(c: Column, part: str) -> Column:
    """0-based place of the last occurrence, -1 for none."""
    at = F.instr(F.reverse(c), part[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(c) - at - len(part) + 1)


def trim_to_budget(c: Column, max_tokens: int) -> Column:
    """Cut at the last empty line, else the last sentence, if that keeps over 60 % of four letters a token."""
    most = max(0, 4 * max_tokens)
    cut = F.substring(c, 1, most)
    paragraph = last_index(cut, "\n\n")
    sentence = F.greatest(*(last_index(cut, p) for p in (". ", "? ", "! ")))
    kept = F.when(paragraph > most * 0.6, F.substring(cut, F.lit(1), paragraph)).when(sentence > most * 0.6, F.substring(cut, F.lit(1), sentence + 1)).otherwise(cut)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(strip(kept), F.lit("\n\n[truncated]")))


def token_savings(raw: Column, returned: Column) -> Column:
    """raw_tokens, returned_tokens, saved_tokens and savings_ratio of two token counts."""
    saved = F.greatest(F.lit(0), raw - returned)
    return F.struct(raw.alias("raw_tokens"), returned.alias("returned_tokens"), saved.alias("saved_tokens"), F.when(raw == 0, F.lit(0.0)).otherwise(rounded(saved / raw)).alias("savings_ratio"))


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)

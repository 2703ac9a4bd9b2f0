"""DuckDB SQL for the text functions, written independently of the column expressions: the oracle's building blocks."""

from __future__ import annotations

from ..config import CLAIM_STOP_WORDS, NEGATIONS, PROVENANCE_STOP_WORDS, RANK_STOP_WORDS, TASK_SYNONYMS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_list(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by}, 'g')"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "''")


def normalize(x: str) -> str:
    x = sub(x, r"\r\n", "chr(10)")
    x = sub(x, r"[ \t]+\n", "chr(10)")
    x = sub(x, r"\n{3,}", "chr(10) || chr(10)")
    return strip(sub(x, r"[ \t]{2,}", "' '"))


def one_line(x: str) -> str:
    return strip(sub(x, r"\s+", "' '"))


def words(x: str) -> str:
    return f"string_split_regex(lower({x}), '[^a-z0-9]+')"


def kept_words(x: str, least: int, stop: list[str]) -> str:
    return f"list_filter({words(x)}, lambda t: length(t) > {least} and not list_contains({words_list(stop)}, t))"


def tokens(x: str) -> str:
    return kept_words(x, 1, RANK_STOP_WORDS)


def claim_words(x: str) -> str:
    return kept_words(x, 2, CLAIM_STOP_WORDS)


def provenance_words(x: str) -> str:
    return kept_words(x, 2, PROVENANCE_STOP_WORDS)


def in_order(x: str) -> str:
    """Distinct values in order; x should be a column."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def synonyms(x: str) -> str:
    table = " ".join(f"when {q(k)} then {words_list(v.split())}" for k, v in TASK_SYNONYMS.items())
    return f"flatten(list_transform({x}, lambda t: case t {table} else [t] end))"


def tokens_estimate(x: str) -> str:
    return f"cast(ceil(length({x}) / 4.0) as integer)"


def preview(x: str, most: int) -> str:
    line = one_line(x)
    return f"case when length({line}) <= {most} then {line} else substr({line}, 1, {most - 3}) || '...' end"


def last_index(x: str, part: str) -> str:
    """part: a SQL string of known length 2."""
    return f"(case when instr(reverse({x}), reverse({part})) = 0 then -1 else length({x}) - instr(reverse({x}), reverse({part})) - 1 end)"


def split_sentences(x: str, then: str = "") -> str:
    """Split after . ! ? and white space (before a capital or digit, where then is a class)."""
    if then:  # RE2 has no look-around: mark the place, twice because matches share letters
        marked = f"regexp_replace({x}, '([.!?])\\s+({then})', '\\1' || chr(1) || '\\2', 'g')"
        marked = f"regexp_replace({marked}, '([.!?])\\s+({then})', '\\1' || chr(1) || '\\2', 'g')"
    else:
        marked = f"regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"string_split({marked}, chr(1))"


def negation_pattern() -> str:
    return q("(^|[^A-Za-z0-9_])(" + "|".join(NEGATIONS) + ")([^A-Za-z0-9_]|$)")


def paragraphs(texts: str) -> str:
    """texts: a query of doc_id and text."""
    return f"""
sources as ({texts}),
texts as (select doc_id, {normalize("text")} as t from sources),
parts as (select doc_id, string_split_regex(t, '\\n\\n+') as ps from texts),
numbered as (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as i from parts),
placed as (select doc_id, i, p, coalesce(sum(length(p) + 2) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from numbered),
paragraphs as (
  select doc_id, row_number() over (partition by doc_id order by i) as k, {strip("p")} as text,
         cast(pos + length(p) - length(regexp_replace(p, '^\\s+', '')) as integer) as char_start,
         cast(pos + length(p) - length(regexp_replace(p, '^\\s+', '')) + length({strip("p")}) as integer) as char_end
  from placed where length({strip("p")}) > 0)"""


def chunks(texts: str, headings: str = "select cast(null as bigint) as doc_id, cast(null as varchar) as heading") -> str:
    """texts: a query of doc_id and text; headings: of doc_id and heading, those a page is known to have."""
    return f"""{paragraphs(texts)},
known as (select doc_id, list(lower({one_line("heading")})) as heads from ({headings}) group by doc_id),
marked as (select p.*, length(text) <= 80 and not regexp_matches(text, '[.!?]$') and regexp_matches(text, '^[A-Z0-9][A-Za-z0-9 /:_-]+$') or coalesce(list_contains(heads, lower({one_line("text")})), false) as heading from paragraphs p left join known using (doc_id)),
fold as (
  select doc_id, k, 1 as piece, char_start as first, case when heading then text end as section, text, char_start, char_end from marked where k = 1
  union all
  select m.doc_id, m.k,
         f.piece + case when m.heading or m.char_end - f.first > 1800 then 1 else 0 end,
         case when m.heading or m.char_end - f.first > 1800 then m.char_start else f.first end,
         case when m.heading then m.text else f.section end, m.text, m.char_start, m.char_end
  from fold f join marked m on m.doc_id = f.doc_id and m.k = f.k + 1),
pieces as (
  select doc_id, piece, {normalize("string_agg(text, chr(10) || chr(10) order by k)")} as text, arg_min(section, k) as section, min(char_start) as char_start, max(char_end) as char_end
  from fold group by doc_id, piece),
chunks as (
  select doc_id, cast(row_number() over (partition by doc_id order by piece) as integer) as chunk_id, section, text, char_start, char_end, {tokens_estimate("text")} as token_estimate
  from pieces where length(text) >= 80)"""


SPREAD = "select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents"
PARAGRAPHS = paragraphs(SPREAD)
CHUNKS = chunks(SPREAD)


def ranked(tasks: list[str], chunks: str = CHUNKS, signals: str = "select distinct doc_id, cast([] as varchar[]) as meta, cast([] as varchar[]) as data from chunks") -> str:
    """signals: a query of doc_id and the tokens of what the page says of itself."""
    rows = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(tasks, 1))
    return f"""{chunks},
tasks as (select * from (values {rows}) v(task_id, task)),
raw_terms as (select task_id, task, {synonyms(tokens("task"))} as l, list_filter(list_transform(string_split_regex(lower(task), '[,.;:]'), lambda p: {strip("p")}), lambda p: len(string_split_regex(p, '\\s+')) >= 2) as phrases from tasks),
terms as (select task_id, task, phrases, {in_order("l")} as terms from raw_terms),
toks as (select *, {tokens("text")} as toks from chunks),
stats as (select doc_id, count(*) as n, avg(len(toks)) as average from toks group by doc_id),
pairs as (select c.doc_id, t.task_id, c.chunk_id, u.term from toks c, terms t, unnest(t.terms) u(term) where list_contains(c.toks, u.term)),
freq as (select doc_id, task_id, term, count(*) as df from pairs group by all),
bm as (
  select c.doc_id, p.task_id, c.chunk_id,
         sum(ln(1 + (s.n - f.df + 0.5) / greatest(f.df + 0.5, 1.0)) * (len(list_filter(c.toks, lambda x: x = p.term)) * 2.4)
             / (len(list_filter(c.toks, lambda x: x = p.term)) + 1.4 * (1 - 0.75 + 0.75 * len(c.toks) / greatest(s.average, 1.0)))) as bm25
  from pairs p join toks c on c.doc_id = p.doc_id and c.chunk_id = p.chunk_id
  join stats s on s.doc_id = p.doc_id join freq f on f.doc_id = p.doc_id and f.task_id = p.task_id and f.term = p.term
  group by all),
signals as ({signals}),
scored as (
  select c.doc_id, c.char_start, c.char_end, t.task_id, t.task, c.chunk_id, c.section, c.text, c.token_estimate,
         case when len(t.terms) = 0 then case when c.chunk_id = 1 then 1.0 else 0.0 end else coalesce(b.bm25, 0.0) end as bm25,
         case when len(t.terms) = 0 then 0.0 else len(list_filter(t.phrases, lambda p: contains(lower(c.text), p))) * 1.5 end as phrase,
         case when len(t.terms) = 0 then 0.0 else len(list_filter(t.terms, lambda x: list_contains({tokens("coalesce(c.section, '')")}, x))) * 0.25 end as heading,
         case when len(t.terms) > 0 and c.chunk_id = 1 then 0.05 else 0.0 end as position,
         len(list_filter(t.terms, lambda x: list_contains(c.toks, x) and list_contains(g.meta, x))) * 0.35 as metadata,
         len(list_filter(t.terms, lambda x: list_contains(c.toks, x) and list_contains(g.data, x))) * 0.45 as structured_data,
         list_filter(t.terms, lambda x: list_contains(c.toks, x)) as matched_terms
  from toks c join signals g on g.doc_id = c.doc_id cross join terms t left join bm b on b.doc_id = c.doc_id and b.task_id = t.task_id and b.chunk_id = c.chunk_id),
topped as (select *, bm25 + phrase + heading + metadata + structured_data + position as raw, max(bm25 + phrase + heading + metadata + structured_data + position) over (partition by doc_id, task_id) as top from scored),
ranked as (
  select *, round(raw, 4) as score, case when top > 0 then round(raw / top, 4) else 0.0 end as normalized_score,
         row_number() over (partition by doc_id, task_id order by round(raw, 4) desc, chunk_id) as rank
  from topped)"""


def selected(budget: int) -> str:
    """After ranked(): the greedy fold, as a recursive walk in rank order."""
    take = f"(r.normalized_score >= 0.05 and f.total + r.token_estimate <= {budget} and not f.done)"
    return f"""walk as (
  select doc_id, task_id, rank, true as taken, token_estimate as total, token_estimate >= {budget} as done from ranked where rank = 1
  union all
  select r.doc_id, r.task_id, r.rank, {take}, f.total + case when {take} then r.token_estimate else 0 end, f.done or ({take} and f.total + r.token_estimate >= {budget})
  from walk f join ranked r on r.doc_id = f.doc_id and r.task_id = f.task_id and r.rank = f.rank + 1),
selected as (select r.* from ranked r join walk w using (doc_id, task_id, rank) where w.taken)"""

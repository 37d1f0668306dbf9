"""DuckDB counterparts of the queries in :mod:`paperloom.plans.queries`."""

from __future__ import annotations

import unicodedata

from paperloom.operators import clean
from paperloom.rules import CANDIDATE_COLUMNS, CATEGORIES, CATEGORY_WORDS, COUNTRIES, COUNTRY_WORDS, DROP_HEADINGS, EXCEPTION_WORDS, GIOIA_WORDS, KEEP_HEADINGS, MEDICAL_WORDS, METHODS_HEADINGS, METHODS_WORDS, ORGANISATION_WORDS, PHYSICAL_WORDS, QUERIES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


#: Signs that unfold to several ASCII characters and may occur in running text.
SEVERAL = "ﬀﬁﬂﬃﬄﬅﬆĳĲǆǅǄǉǈǇǌǋǊ…½¼¾№™℅‼⁇"
_WIDE = "".join(chr(o) for o in [*range(0xFF01, 0xFF5F), 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000])
_WIDE_TO = "".join(unicodedata.normalize("NFKC", c) for c in _WIDE)


def fold(c: str) -> str:
    out = f"strip_accents(translate(coalesce({c}, ''), {_q(_WIDE)}, {_q(_WIDE_TO)}))"
    for s in SEVERAL:
        a = "".join(x for x in unicodedata.normalize("NFKD", s) if x < "\x80")
        out = f"replace({out}, {_q(s)}, {_q(a)})"
    return rf"regexp_replace({out}, '[^\x00-\x7F]+', '', 'g')"


def norm_title(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({fold(c)}), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def slug(c: str) -> str:
    return rf"coalesce(nullif(left(array_to_string(list_filter(regexp_split_to_array(lower({fold(c)}), '[^a-z0-9]+'), lambda x: x <> '')[1:6], '_'), 60), ''), 'untitled')"


def short_title(c: str) -> str:
    return rf"coalesce(nullif(rtrim(left(trim(regexp_replace(lower({fold(c)}), '[^a-z0-9]+', '_', 'g'), '_'), 50), '_'), ''), 'untitled')"


_U = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{_U}+|{_U}+$', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{_U}+'), lambda x: x <> '')"


_NO_GRID = f"(select * from (select unnest({_list(COUNTRIES)}) as country), (select unnest({_list(CATEGORIES)}) as category, unnest(range(1, {len(CATEGORIES) + 1})) as category_no))"


def _grid(papers: int) -> str:
    return f"(select country, category, category_no::int as category_no, paper::int as paper, country || '_' || paper || '-' || category_no as slot from {_NO_GRID}, (select unnest(range(1, {papers + 1})) as paper))"


_BEST = "(case screening_status when 'strong_candidate' then 4 when 'candidate' then 3 when 'manual_download_needed' then 2 when 'needs_review' then 1 else 0 end) desc, coalesce(category_score, 0) desc, (case when coalesce(pdf_url, '') <> '' then 1 else 0 end) desc, coalesce(year, 0) desc, cand_no"


def _hits(ws: str) -> str:
    return f"list_filter({ws}, lambda k: contains(hay, lower(k)))"


def _by(key: str, m: dict[str, list[str]]) -> str:
    return "case " + " ".join(f"when {key} = {_q(k)} then {_list(v)}" for k, v in m.items()) + " else []::varchar[] end"


def _scores(texts: str, country: str, category: str, keep: str, table: str) -> str:
    hay = f"lower(array_to_string(list_filter([{texts}], lambda x: x is not null and x <> ''), ' '))"
    return f"""(select {keep}, {_hits(_by(country, COUNTRY_WORDS))} as ch, {_hits(_by(category, CATEGORY_WORDS))} as kh, {_hits(_list(ORGANISATION_WORDS))} as oh, {_hits(_list(MEDICAL_WORDS))} as mh, {_hits(_list(PHYSICAL_WORDS))} as ph
    from (select *, {hay} as hay from {table}))"""


SQL: dict[str, str] = {}
SQL["title_forms"] = f"select cand_no, {norm_title('title')} as norm_title, {slug('title')} as slug, {short_title('title')} as short_title, array_to_string(list_sort(list_filter(string_split({norm_title('title')}, ' '), lambda x: x <> '')), ' ') as sorted_title from candidates"
SQL["record_ids"] = f"select cand_no, case when lower({strip('doi')}) <> '' then 'doi:' || lower({strip('doi')}) when {norm_title('title')} <> '' then 'ttl:' || left(sha1({norm_title('title')}), 16) else 'raw:' end as rid from candidates"
SQL["host_counts"] = r"select lower(regexp_replace(regexp_extract(coalesce(pdf_url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), '[\[\]]', '', 'g')) as host, count(*) as n from candidates group by 1"
_STRIPPED = "regexp_replace(coalesce(abstract, ''), '<[^>]+>', ' ', 'g')"
SQL["plain_abstracts"] = f"select cand_no, {strip(_STRIPPED)} as plain, len({words('abstract')})::int as n_words from candidates"
SQL["index_round_trip"] = f"select cand_no, array_to_string({words('abstract')}, ' ') as rebuilt, len(list_distinct({words('abstract')}))::int as n_words from candidates"
SQL["csv_projection"] = "select cand_no::varchar as key, " + ", ".join(f"coalesce({c}::varchar, '') as {c}" for c in CANDIDATE_COLUMNS) + " from candidates"
SQL["aliased_columns"] = "select cand_no, " + ", ".join(f"coalesce(nullif({strip(c)}, ''), " + ({"country": strip("target_country_region") + ", "}.get(c, "")) + f"'') as {c}" for c in ("country", "category", "title", "local_pdf_path", "screening_status")) + " from candidates"
SQL["target_paths"] = f"select cand_no, 'pdfs/' || country || '/' || coalesce(nullif(slot, ''), country || '_unassigned') || '_' || {slug('title')} || '.pdf' as target, case when starts_with(coalesce(local_pdf_path, ''), '/') then local_pdf_path else '/data/' || coalesce(local_pdf_path, '') end as source from candidates"
SQL["leading_numbers"] = r"select cand_no, coalesce(try_cast(case when regexp_full_match(string_split(coalesce(related_category, ''), ' ')[1], '\d{1,9}') then string_split(related_category, ' ')[1] end as int), 0) as n_matches, coalesce(year, 0)::int as year_no, least(greatest(coalesce(year, 0), 1), 200)::int as page_size from candidates"
SQL["category_numbers"] = f"select cand_no, list_position({_list(CATEGORIES)}, category)::int as category_no from candidates"
_COUNTRY_RE = "|".join(COUNTRIES)
SQL["file_names_parsed"] = rf"""select log_no, paper_id, case when regexp_matches(paper_id, '^({_COUNTRY_RE})_') then regexp_extract(paper_id, '^({_COUNTRY_RE})_', 1) else coalesce(country, '') end as country, no as category_number,
  coalesce(case when no between 1 and 6 then {_list(CATEGORIES)}[no] end, '') as category_name
  from (select *, try_cast(nullif(regexp_extract(paper_id, '^(?:{_COUNTRY_RE})_(\d)-\d+_', 1), '') as int) as no from (select log_no, country, regexp_replace(coalesce(pdf_file, ''), '(?i)\.pdf$', '') as paper_id from preprocess_log))"""
SQL["event_props"] = "select event_type, count(json_extract(props, '$.k')) as n, sum(json_extract(props, '$.k')::bigint)::bigint as total from events group by 1"
_AUTHORS = "array_to_string(list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: trim(a, ' ')), lambda x: x <> ''), '; ')"
SQL["works_normalised"] = f"""select cand_no, coalesce(replace('https://doi.org/' || doi, 'https://doi.org/', ''), '') as doi, coalesce(title, '') as title, {_AUTHORS} as authors, year, coalesce(journal_source, '') as journal_source, coalesce(pdf_url, '') as pdf_url, coalesce(oa_status, '') as oa_status,
  case when coalesce(pdf_url, '') <> '' then 'openalex:oa' else '' end as oa_source, coalesce(license, '') as license, array_to_string({words('abstract')}, ' ') as abstract, coalesce(is_oa, false) as is_oa from candidates"""
_NAME = "trim(case when contains(a, ',') then regexp_replace(trim(regexp_extract(a, '([^,]*)$', 1), ' ') || ' ' || trim(regexp_extract(a, '^([^,]*)', 1), ' '), '^ | $', '', 'g') else trim(a, ' ') end, ' ')"
SQL["items_normalised"] = f"""select cand_no, coalesce(doi, '') as doi, coalesce(title, '') as title, array_to_string(list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: {_NAME}), lambda x: x <> ''), '; ') as authors, year, coalesce(journal_source, '') as journal_source,
  {strip("regexp_replace('<jats:p>' || abstract || '</jats:p>', '<[^>]+>', ' ', 'g')")} as abstract from candidates"""
SQL["papers_normalised"] = """select cand_no, coalesce(doi, '') as doi, coalesce(title, '') as title, array_to_string(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: trim(a, ' ')), '; ') as authors, year, coalesce(journal_source, '') as journal_source, coalesce(pdf_url, '') as pdf_url,
  case when is_oa then 'open' else '' end as oa_status, case when coalesce(pdf_url, '') <> '' then 'semantic_scholar' else '' end as oa_source, coalesce(abstract, '') as abstract, coalesce(is_oa, false) as is_oa from candidates"""
SQL["limited_per_query"] = "select country, category, rn, cand_no, id from (select *, (row_number() over (partition by country, category order by cand_no))::int as rn from candidates) where rn <= 20"
SQL["united_sources"] = """select kind, country, category, count(*) as n, count(domain) as n_domain, count(case when coalesce(doi, '') <> '' then 1 end) as n_doi
  from (select 'candidate' as kind, country, category, doi, null as domain from candidates union all select 'log', country, category, doi, domain from download_safety_log) group by all"""
SQL["targets"] = f"select g.country, g.category, category_no, paper, slot, coalesce(n, 0)::bigint as n from {_grid(2)} g left join (select country, category, count(*) as n from candidates group by all) c on g.country = c.country and g.category = c.category"
SQL["taken_slots"] = "select country, category, array_to_string(list_sort(list(distinct slot)), ',') as slots, count(*) as n from candidates where coalesce(slot, '') <> '' group by all"
SQL["keyword_scores"] = f"""select cand_no, len(ch)::int as country_score, len(oh)::int as workplace_organization_score, len(kh)::int as category_score, (len(mh) + len(ph))::int as exclusion_medical_score, array_to_string(ch, ', ') as target_country_region,
  array_to_string(oh, ', ') || case when len(ph) > 0 then case when len(oh) > 0 then ' | ' else '' end || 'physical-env: ' || array_to_string(ph, ', ') else '' end as research_context, len(kh) || ' matches: ' || array_to_string(kh, ', ') as related_category,
  'country=' || len(ch) || ', org=' || len(oh) || ', category=' || len(kh) || ', medical/physical=' || (len(mh) + len(ph)) as reason_for_inclusion
  from {_scores('title, abstract, journal_source', 'country', 'category', 'cand_no', 'candidates')}"""
SQL["score_totals"] = f"""select country, count(*) as n, sum(len(oh))::bigint as organisation, sum(len(mh) + len(ph))::bigint as medical, sum(len(kh))::bigint as category_words, sum(len(ch))::bigint as country_words
  from {_scores('text', 'country', _q(CATEGORIES[2]), 'country', 'documents')} group by country"""
SQL["ranked_in_cell"] = f"select country, category, rn, cand_no from (select *, (row_number() over (partition by country, category order by {_BEST}))::int as rn from candidates) where rn <= 2"
SQL["places_filled"] = f"""with free as (select *, (row_number() over (partition by country, category order by paper))::int as rn from {_grid(9)} where slot not in (select slot from candidates where coalesce(slot, '') <> '')),
  best as (select *, (row_number() over (partition by country, category order by {_BEST}))::int as rn from candidates where category_score >= 1 and coalesce(slot, '') = '')
  select b.country, b.category, b.rn, f.slot as new_slot, b.cand_no from best b join free f on b.country = f.country and b.category = f.category and b.rn = f.rn"""
SQL["places_open"] = f"select country, category, slot, 'missing' as status, case when paper = 1 then 'find first paper' else 'find second paper' end as needed_action from {_grid(2)} where slot not in (select slot from candidates where coalesce(slot, '') <> '' and category_score >= 2 and batch_no = 0)"
SQL["files_numbered"] = f"""select cand_no, sequence, case when sequence is not null then country || '_' || category_no || '-' || sequence || '_' || {short_title('title')} || '.pdf' else '' end as file_name from (
  select cand_no, country, title, list_position({_list(CATEGORIES)}, category) as category_no, case when ok then (row_number() over (partition by country, category, ok order by case when batch_no = 0 then 0 else 9 end, lower({strip('title')}), cand_no))::int end as sequence
  from (select *, coalesce(local_pdf_path, '') <> '' as ok from candidates))"""
SQL["names_freed"] = f"""with c as (select cand_no, country as folder, {short_title('title')} as name from candidates), t as (select distinct folder, name from documents d join c on d.cand_no = c.cand_no),
  r as (select c.cand_no, c.folder, c.name, row_number() over (partition by c.folder, c.name order by c.cand_no) - 1 + case when t.name is null then 0 else 1 end as k from c left join t on c.folder = t.folder and c.name = t.name)
  select cand_no, folder, name || case when k = 0 then '' else '_dup' || k end || '.pdf' as free_name from r"""
SQL["status_tally"] = "select coalesce(nullif(array_to_string(list_sort(list(coalesce(status, '') || '=' || n)), ', '), ''), '0') as summary from (select status, count(*) as n from preprocess_log group by 1)"
SQL["warnings_sorted"] = r"select doc_id, array_to_string(list_sort(list(distinct w)), '; ') as warnings from (select doc_id, unnest(regexp_split_to_array(coalesce(warnings, ''), '\s*;\s*')) as w from preprocess_log) where w <> '' group by 1"


def _upserted() -> str:
    out = []
    kinds = {"year": "n", "category_score": "n", "is_oa": "b"}
    for c in ["title", "authors", "year", "doi", "slot", "notes", "is_oa", "category_score", "screening_status", "created_at"]:
        kind = kinds.get(c, "s")
        there = {"n": f"{c} is not null and {c} <> 0", "b": f"{c} is true", "s": f"{c} is not null and {c} <> ''"}[kind]
        own = f"(arg_min({{'v': {c}}}, o)).v"
        last, early = f"arg_max({c}, o) filter (where {there})", f"arg_min({c}, o) filter (where {there})"
        if c == "created_at":
            value = own
        elif c in ("slot", "notes"):
            value = f"coalesce({early}, {own})"
        elif c == "screening_status":
            value = f"coalesce(arg_min({c}, o) filter (where {c} in ('needs_review', 'rejected')), {last}, {own})"
        else:
            value = f"coalesce({last}, {own})"
        out.append(f"{value} as {c}")
    return ", ".join(out)


_COLS = "title, authors, year, doi, slot, notes, is_oa, category_score, screening_status, created_at"
SQL["upserted"] = f"""with e as (select *, min(cand_no) over (partition by id) as first_at, row_number() over (partition by id order by cand_no desc) as back from candidates where batch_no = 0),
  r as (select id, 0 as isnew, first_at, {_COLS}, first_at as o from e where back = 1 union all select id, 1, cand_no, {_COLS}, 1000000000000 + cand_no from candidates where batch_no > 0)
  select id, (case when min(o) >= 1000000000000 then 1 else 0 end)::int as first_new, (min(o) % 1000000000000)::bigint as first_no, {_upserted()} from r group by id"""
SQL["enriched"] = """with l as (select k, min({'a': case when oa_status is null then 0 else 1 end, 'oa_status': oa_status, 'b': case when license is null then 0 else 1 end, 'license': license, 'c': case when pdf_url is null then 0 else 1 end, 'pdf_url': pdf_url}) as l
    from (select distinct lower(trim(doi, ' ')) as k, oa_status, license, pdf_url from download_safety_log where lower(trim(doi, ' ')) <> '') group by k),
  j as (select c.*, l.l as l from candidates c left join l on lower(trim(c.doi, ' ')) = l.k),
  f as (select cand_no, is_oa, case when coalesce(oa_status, '') = '' and l.oa_status is not null then l.oa_status else oa_status end as oa_status, case when coalesce(license, '') = '' and l.license is not null then l.license else license end as license,
    case when coalesce(pdf_url, '') = '' and l.pdf_url is not null then l.pdf_url else pdf_url end as pdf_url from j)
  select cand_no, oa_status, license, pdf_url, coalesce(is_oa, false) or coalesce(pdf_url, '') <> '' as is_oa from f"""
_FIRST = "select cand_no, first from (select cand_no, min(cand_no) over (partition by k) as first from (select cand_no, {} as k from candidates) where k <> '') where cand_no > first"
SQL["same_doi_first"] = _FIRST.format(f"lower({strip('doi')})")
SQL["same_title_first"] = _FIRST.format(norm_title("title"))


def _re(p: str) -> str:
    """A pattern of the cleaner in RE2's dialect, with Unicode white space, digits and words spelt out."""
    p = p.replace("(?iU)", "(?i)").replace("(?U)", "")
    return p.replace(r"\s", _U).replace(r"\S", _U.replace("[", "[^", 1)).replace(r"\d", r"\p{Nd}").replace("'", "''")


def _clean_lines() -> str:
    t = "coalesce(text, '')"
    for code, sign in (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("⏎", "")):
        t = f"replace({t}, '{code}', '{sign}')"
    t = rf"regexp_replace(replace(replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(173), ''), '([\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\p{{Nl}}])-\n{_U}*([\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\p{{Nl}}])', '\1\2', 'g')"
    line = strip(r"regexp_replace(raw, '[ \t]+', ' ', 'g')")
    form = rf"regexp_replace(lower({strip(rf'''regexp_replace(regexp_replace(line, '^[\p{{Nd}}IVXivx]+[\.\)]?{_U}*', ''), '[^a-zA-Z/&\-\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]', '', 'g')''')}), '{_U}+', ' ', 'g')"
    starts = lambda ws: f"len(list_filter({_list(ws)}, lambda k: starts_with(h, k))) > 0"
    holds = lambda ws: f"len(list_filter({_list(ws)}, lambda k: contains(low, k))) > 0"
    m = lambda p: f"regexp_matches(line, '{_re(p)}')"
    n = lambda p: f"len(regexp_extract_all(line, '{_re(p)}'))"
    quote = "(length(line) > 25 and (regexp_matches(line, '[“”‘’«»]') or length(line) - length(replace(line, '\"', '')) >= 2))"
    return f"""lines as (select doc_id, pos, line, lower(line) as low, {form} as h from (select doc_id, pos, {line} as line from (select doc_id, unnest(string_split(t, chr(10))) as raw, unnest(range(len(string_split(t, chr(10))))) as pos from (select doc_id, {t} as t from documents)))),
  classed as (select *, case when line <> '' and length(line) <= 70 and len({words('line')}) <= 8 and not ends_with(line, '.') and h <> '' then case when {starts(DROP_HEADINGS)} then 'drop' when {starts(METHODS_HEADINGS)} then 'methods' when {starts(KEEP_HEADINGS)} then 'keep' end end as heading,
    case when line = '' then null when {m(clean.DOI_LINE)} then 'doi' when {m(clean.URL_LINE)} then 'url' when {m(clean.PAGE_LINE)} then 'page' when {m(clean.EMAIL)} and length(line) < 120 then 'email'
    when {m(clean.AFFILIATION)} and length(line) < 100 and not regexp_matches(line, '[.?!]$') then 'affil' when {m(clean.P_VALUE)} or {m(clean.STATISTIC)} or {holds(['cronbach', 'p-value', 't-value'])} then 'stat'
    when {n(clean.NUMBER)} >= 3 and length(regexp_replace(line, '{_U}', '', 'g')) > 0 and {n(chr(92) + 'd')} > length(regexp_replace(line, '{_U}', '', 'g')) * 0.35 then 'table' end as junk,
    {quote} or {holds(EXCEPTION_WORDS)} as exc, (not {m(clean.CITATION)}) and ({quote} or {holds(GIOIA_WORDS)}) as in_drop, {quote} or {holds(EXCEPTION_WORDS)} or {holds(METHODS_WORDS)} as in_methods from lines),
  moded as (select *, coalesce(last_value(heading ignore nulls) over w, 'keep') as mode, sum(case when line = '' or heading is not null then 1 else 0 end) over w as block, line <> '' and heading is null as body, junk is null or exc as clear from classed
    window w as (partition by doc_id order by pos rows between unbounded preceding and current row)),
  kept as (select *, body and clear and case mode when 'drop' then in_drop when 'methods' then in_methods else true end as kept, body and not clear as skipped from moded)"""


SQL["line_classes"] = f"with {_clean_lines()} select heading, junk, mode, kept, count(*) as n, sum(length(line))::bigint as chars from kept group by all"
SQL["documents_cleaned"] = f"""with {_clean_lines()},
  paragraphs as (select doc_id, block, string_agg(line, ' ' order by pos) as p from kept where kept group by all), bodies as (select doc_id, string_agg(p, chr(10) || chr(10) order by block) as cleaned from paragraphs group by 1),
  info as (select doc_id, string_agg(case when mode = 'methods' then line || ' (minimal/context only)' else line end, '|' order by pos) filter (where heading in ('keep', 'methods')) as ks, string_agg(line, '|' order by pos) filter (where heading = 'drop') as rs,
    [case when bool_or(heading = 'drop' and regexp_matches(h, '^(reference|bibliography)')) then 'references removed' end, case when bool_or(skipped and junk in ('stat', 'table')) then 'tables removed' end, case when bool_or(kept and mode = 'drop') then 'qualitative quotes retained' end,
     case when not coalesce(bool_or(heading in ('keep', 'methods')), false) then 'no section headings detected; line-level cleaning only' end] as ws from kept group by 1)
  select i.doc_id, coalesce(b.cleaned, '') as cleaned, coalesce(ks, '') as kept_sections, coalesce(rs, '') as removed_sections, array_to_string(list_sort(list_filter(ws, lambda x: x is not null)), '; ') as warnings from info i left join bodies b on i.doc_id = b.doc_id"""
SQL["text_states"] = f"""select doc_id, n_words, case when {strip('text')} = '' then 'no_text' when n_words < 100 and coalesce(pages, 0) > 0 and length(text) / pages < 60 then 'short_scanned' when n_words < 100 then 'short' else 'text' end as state
  from (select *, len({words('text')})::int as n_words from documents)"""
SQL["latest_runs"] = "select doc_id, log_no, status, word_count_raw, word_count_cleaned from (select *, row_number() over (partition by doc_id order by processed_at desc nulls last, log_no desc) as rn from preprocess_log) where rn = 1"


# --- the search pipeline, files and logs

SQL["cell_queries"] = "select * from (values " + ", ".join(f"({_q(c)}, {_q(k)}, {i}::int, {j}::int, {n}::int, {_q(q)})" for i, (c, cells) in enumerate(QUERIES.items()) for j, (k, qs) in enumerate(cells.items()) for n, q in enumerate(qs)) + ") t(country, category, country_ord, category_ord, query_ord, query)"
_FOUND = f"(select w.*, c.country, c.category from ({SQL['works_normalised']}) w join candidates c using (cand_no))"
SQL["collected"] = f"""select cand_no, case when lower({strip('doi')}) <> '' then 'doi:' || lower({strip('doi')}) when {norm_title('title')} <> '' then 'ttl:' || left(sha1({norm_title('title')}), 16) else 'raw:' end as id, country, category, '' as slot, '' as local_pdf_path, '' as notes, '' as duplicate_of,
  '2024-01-01T00:00:00+00:00' as created_at, '2024-01-01T00:00:00+00:00' as updated_at, len(ch)::int as country_score, len(kh)::int as category_score, len(oh)::int as workplace_organization_score, (len(mh) + len(ph))::int as exclusion_medical_score
  from {_scores('title, abstract, journal_source', 'country', 'category', 'cand_no, doi, title, country, category', _FOUND)}"""
SQL["looked_up"] = """select c.cand_no, coalesce(l.u is not null, false) as l_is_oa, coalesce(l.oa_status, '') as l_oa_status, coalesce(l.u, '') as l_pdf_url, coalesce(l.lic, '') as l_license, '' as l_host_type
  from candidates c left join (select lower(trim(doi, ' ')) as k, min(pdf_url) as u, max(license) as lic, max(oa_status) as oa_status from download_safety_log where trim(doi, ' ') <> '' group by 1) l on lower(trim(c.doi, ' ')) = l.k"""
SQL["workplace_checked"] = f"select cand_no, len(oh) > 0 as in_workplace, array_to_string(oh, ', ') as hits from {_scores('title, abstract, journal_source', 'country', 'category', 'cand_no', 'candidates')}"
_SOURCE = "(case when starts_with(coalesce(local_pdf_path, ''), '/') then local_pdf_path else '/data/' || coalesce(local_pdf_path, '') end)"
_THERE = f"{_SOURCE} in (select {_SOURCE} from candidates where cand_no in (select cand_no from documents where cand_no is not null))"
SQL["files_there"] = f"select cand_no, {_THERE} as there from candidates"
SQL["organised"] = f"""with r as (select *, list_position({_list(CATEGORIES)}, category)::int as no, {strip('title')} as tt, {strip('local_pdf_path')} as lp, {_THERE} as there from candidates where country in ({', '.join(map(_q, COUNTRIES))})),
  s as (select *, case when coalesce(batch_no = 3, false) then 'skipped_rejected' when lp = '' then 'skipped_no_pdf' when not there then 'skipped_missing_file' when no is null then 'error' else 'dry_run' end as status from r),
  n as (select *, case when status = 'dry_run' then (row_number() over (partition by country, no, status order by case screening_status when 'adopted' then 0 when 'strong_candidate' then 1 when 'candidate' then 2 else 9 end, lower(tt), cand_no))::int end as sequence from s),
  b as (select *, case when sequence is not null then country || '_' || no || '-' || sequence || '_' || {short_title('tt')} || '.pdf' end as base from n),
  t as (select distinct country, lower(country || '_1-1_' || {short_title('title')} || '.pdf') as name from candidates where cand_no % 2 = 0),
  f as (select b.*, case when t.name is null then base else replace(base, '.pdf', '_dup1.pdf') end as free from b left join t on b.country = t.country and lower(b.base) = t.name)
  select cand_no, no as category_number, sequence, case when sequence is not null then '/out/' || country || '/' || free else '' end as new_path, status,
    case when sequence is not null then case when free <> base then 'renamed: ' || base || ' -> ' || free else '' end when status = 'error' then 'unknown category: ' || {strip('category')} when status = 'skipped_missing_file' then 'no file: ' || case when starts_with(lp, '/') then lp else '/data/' || lp end else '' end as note from f"""
SQL["saved_count"] = "select count(*) filter (where l.legal_download_status = 'safe_downloaded' and c.batch_no > 0) as saved, count(*) as looked_at from download_safety_log l join candidates c on l.cand_no = c.cand_no"
_HOST = SQL["host_counts"].removeprefix("select ").split(" as host,")[0]
SQL["download_rows"] = f"""select cand_no, coalesce(country, '') as country, coalesce(category, '') as category, coalesce(title, '') as title, coalesce(doi, '') as doi, coalesce(pdf_url, '') as pdf_url, {_HOST} as domain, coalesce(oa_status, '') as oa_status, coalesce(license, '') as license,
  coalesce(legal_download_status, '') as legal_download_status, coalesce(legal_download_reason, '') as legal_download_reason, case when batch_no = 0 then 'pdfs/' || cand_no else coalesce(local_pdf_path, '') end as local_pdf_path from candidates"""
SQL["magic_bytes"] = "select doc_id, coalesce(pages > 1 and text is not null, false) or coalesce(starts_with(text, '%PDF'), false) as magic, coalesce(pages > 1 and text is not null, false) or coalesce(starts_with(text, '%PDF'), false) or coalesce(lang = 'en', false) as either from documents"
SQL["run_dates"] = "select event_type, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' as newest, strftime(current_date, '%Y-%m-%d') as today from events group by 1"
_STATE = "struct_pack(o := o, d := d, t := t, kept := kept, dup := dup)"
SQL["duplicates_exact"] = f"""with k as (select cand_no as o, lower({strip('doi')}) as d, {norm_title('title')} as t from candidates),
  r as (select list({{'o': o, 'd': d, 't': t, 'kept': []::struct(o bigint, d varchar, t varchar)[], 'dup': []::struct(o bigint, leader bigint)[]}} order by o) as rows from k),
  z as (select list_reduce(list_prepend({{'o': -1::bigint, 'd': '', 't': '', 'kept': []::struct(o bigint, d varchar, t varchar)[], 'dup': []::struct(o bigint, leader bigint)[]}}, rows), lambda a, x: struct_pack(o := x.o, d := x.d, t := x.t,
    kept := case when len(list_filter(a.kept, lambda e: (e.d = x.d and x.d <> '') or (e.t = x.t and x.t <> ''))) = 0 then list_append(a.kept, struct_pack(o := x.o, d := x.d, t := x.t)) else a.kept end,
    dup := list_append(a.dup, struct_pack(o := x.o, leader := coalesce(list_min(list_transform(list_filter(a.kept, lambda e: e.d = x.d and x.d <> ''), lambda e: e.o)), list_min(list_transform(list_filter(a.kept, lambda e: e.t = x.t and x.t <> ''), lambda e: e.o))))))).dup as dups from r)
  select p.o as cand_no, p.leader as duplicate_of from (select unnest(dups) as p from z)"""

_DASHED = "coalesce('- ' || replace(nullif({0}, ''), '{1}', chr(10) || '- '), '{2}')"
SQL["document_notes"] = f"""select d.doc_id, array_to_string(['paper_id: ' || coalesce(paper_id, ''), 'country: ' || coalesce(country, ''), 'category_number: ' || coalesce(category_number::varchar, ''), '',
  'kept_sections:', {_DASHED.format("kept_sections", "|", "- (none detected)")}, '', 'removed_sections:', {_DASHED.format("removed_sections", "|", "- (none detected)")}, '', 'warnings:', replace({_DASHED.format("replace(warnings, 'detected; line', 'detected;_line')", "; ", "- (none)")}, 'detected;_line', 'detected; line'), '',
  'word_count_raw: ' || len({words('text')}), 'word_count_cleaned: ' || len({words('cleaned')})], chr(10)) as notes from documents d join ({SQL['documents_cleaned']}) c on d.doc_id = c.doc_id"""

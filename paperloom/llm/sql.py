"""SQL counterparts of the text queries, where SQL can express them over whole tables (README names the tests of the others)."""

from __future__ import annotations

from paperloom.llm.textforms import IGNORABLE, LOOK_ALIKES

_LATIN = r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"
_OTHER = "".join(LOOK_ALIKES)
_SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
_MIMIC = rf"[{IGNORABLE}{_SPACES}\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}\x{{FB00}}-\x{{FB06}}]|\p{{L}}[\x{{300}}-\x{{36F}}]|[{_LATIN}][{_OTHER}]|[{_OTHER}][{_LATIN}]"

_WINDOWS = "w as (select doc_id, k, hash(substring(text, k, 300)) as h, substring(text, k, 300) as s from (select doc_id, text, unnest(range(1, length(text) - 298)) as k from documents where length(text) >= 300)), shared as (select h from w group by h having count(distinct doc_id) > 1)"

SQL: dict[str, str] = {
    "p2_found": f"select cand_no, field_name from (select cand_no, 'title' as field_name, title as t from candidates union all select cand_no, 'authors', authors from candidates) where regexp_matches(t, '{_MIMIC}')",
    "p8_found": f"with {_WINDOWS}, d as (select distinct doc_id, h from w semi join shared using (h)) select distinct a.doc_id as doc_a, b.doc_id as doc_b from d a join d b on a.h = b.h and a.doc_id < b.doc_id",
    "p8_coverage": f"""with {_WINDOWS}, hit as (select doc_id, k, lag(k) over (partition by doc_id order by k) as before from w semi join shared using (h)),
  n as (select doc_id, sum(case when before is null then 300 else least(300, k - before) end) as shared_chars from hit group by 1)
  select d.doc_id, coalesce(length(text), 0)::bigint as n_chars, coalesce(shared_chars, 0)::bigint as shared_chars from documents d left join n on d.doc_id = n.doc_id""",
}

# maximal repeats: runs of equal windows on one diagonal, between the first of each group of whole copies
SQL["p8_spans"] = """with reps as (select min(doc_id) as doc_id, text from documents where length(text) >= 300 group by text),
  w as (select doc_id, k, hash(substring(text, k + 1, 300)) as h from (select doc_id, text, unnest(range(0, length(text) - 299)) as k from reps)),
  j as (select x.doc_id as a, y.doc_id as b, x.k as ka, y.k as kb from w x join w y on x.h = y.h and x.doc_id < y.doc_id),
  r as (select *, ka - row_number() over (partition by a, b, ka - kb order by ka) as run from j)
  select a, b, min(ka)::int as start_a, min(kb)::int as start_b, (max(ka) - min(ka) + 300)::int as length from r group by a, b, ka - kb, run"""

"""SQL with the meaning of each query, for a check against another engine."""

from __future__ import annotations

from opinionmill import schema as S
from opinionmill.functions import text as tx
from opinionmill.sources.store import _role_names
from workload import fixtures as fx
from workload.queries import DOC_ROLES, SEARCH, SELECTION

WS = f"[{tx.WS}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def pct(part: str, whole: str) -> str:
    return (
        f"cast(case when {whole} = 0 then 0 else "
        f"round_even(({part})::double / {whole} * 100, 0) end as integer)")


def half_up(part: str, whole: str) -> str:
    return (
        f"cast(case when {whole} = 0 then 0 else "
        f"floor(({part})::double / {whole} * 100 + 0.5) end as integer)")


def with_(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"


N = "count(*)"
NPOS = "count(*) filter (where polarity = 'pos')"
NNEG = "count(*) filter (where polarity = 'neg')"
COUNTS = f"{N} as total, {NPOS} as pos, {NNEG} as neg, min(ord) as first_ord"

# ----------------------------------------------------------------------- fixtures

OPINIONS = """opinions as (
select ((l_orderkey % 134217728) * 8 + l_linenumber % 8) * 4294967296
         + (l_partkey % 262144) * 16384 + l_suppkey % 16384 as ord,
  p_brand as product,
  'order ' || l_orderkey || ' ' || o_orderpriority as review_text,
  p_type || '-' || (p_size % 2) as category,
  lower(p_type) as aspect_raw,
  case when p_size % 2 = 0 and l_returnflag = 'A' then 'pos'
       when p_size % 2 = 1 and l_returnflag = 'R' then 'neg'
       when l_returnflag = 'N' and l_linenumber = 7 then 'neu'
       when p_size % 2 = 0 then 'neg' else 'pos' end as polarity,
  case when l_partkey % 11 = 0 then ''
       when l_partkey % 13 = 0 then 'hôm nay'
       when l_partkey % 60 < 14 then (l_partkey % 60) || ' ngày trước'
       when l_partkey % 60 < 40 then ((l_partkey % 60) // 7) || ' tuần trước'
       when l_partkey % 60 < 55 then ((l_partkey % 60) // 30) || ' tháng trước'
       else '1 năm trước' end as time_text
from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)"""

REVIEWS = """reviews as (
select doc_id as ord, source as product,
  case doc_id % 5 when 0 then text || ' https://a.example/x?y=1<b>z</b>'
    when 1 then text || ' <br/>www.a.example end'
    when 2 then text || chr(160) || chr(160) || 'e' || chr(769)
    when 3 then text else 'NaN' end as text,
  case when doc_id % 7 = 0 then null else (doc_id % 60) || ' ngày trước' end as time_text
from documents)"""

PAGES = """reviews as (
select page_id as ord, regexp_extract(url, '^https?://([^/]+)', 1) as product,
  html as text, '' as time_text from pages)"""


def sub(x: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"


def edges(x: str) -> str:
    return sub(x, tx.EDGE_SPACES_PATTERN, "")


BLANKED = "case when text is null or lower(text) in ('', 'nan') then '' else text end"


def collapsed(x: str) -> str:
    return f"trim({sub(x, f'{WS}+')})"


def preprocessed(x: str) -> str:
    urls = sub(f"nfc_normalize({x})", rf"https?://[^{tx.WS}]+|www\.[^{tx.WS}]+")
    return collapsed(sub(urls, "<[^>]+>"))


CLEAN = f"clean as (select *, {preprocessed(BLANKED)} as clean from reviews)"


def split(x: str) -> str:
    return f"case when {edges(x)} = '' then [] else regexp_split_to_array({edges(x)}, '{WS}+') end"


SENTENCES = "sentences as (select conv_id * 1000 + turn as sent_id, text from conversations)"
WORDS = f"""words as (
select sent_id, (i - 1)::integer as word_id, w[i] as word
from (select sent_id, w, unnest(range(1, len(w) + 1)) as i
      from (select sent_id, {split('text')} as w from sentences)))"""
LABELLED = """labelled as (
select *, case length(word) % 5 when 0 then 'B-ASP' when 1 then 'I-ASP' else 'O' end as label
from words)"""
TOKENS = """pieces as (
select sent_id, word_id, p,
  case when p = 0 then cls else (cls + 1) % 3 end as cls
from (select sent_id, word_id,
        case length(word) % 5 when 0 then 1 when 1 then 2 else 0 end as cls,
        unnest(range(0, cast(ceil(length(word) / 4) as bigint))) as p
      from words)),
tokens as (
select sent_id, row_number() over (partition by sent_id order by word_id, p) as pos, word_id, cls
from pieces
union all
select sent_id, 0, null, 0 from sentences
union all
select s.sent_id, 1 + count(p.p), null, 0
from sentences s left join pieces p on s.sent_id = p.sent_id group by s.sent_id)"""
LABEL = "case cls when 0 then 'O' when 1 then 'B-ASP' when 2 then 'I-ASP' end"
KEPT = f"""kept as (select * from tokens where pos <= {S.MAX_TOKENS - 2} or word_id is null)"""
FIRST = f"""first_label as (
select sent_id, word_id, {LABEL} as label
from tokens where word_id is not null
qualify row_number() over (partition by sent_id, word_id order by pos) = 1)"""


def spans(source: str, keys: str) -> str:
    """Gaps and islands over (keys, word_id, word, label)."""
    return f"""marks as (
select *, sum((label = 'B-ASP')::int) over w as b, sum((label = 'O')::int) over w as o
from {source} window w as (partition by {keys} order by word_id)),
open_at as (
select *, max(case when label = 'B-ASP' then o end)
  over (partition by {keys} order by word_id) as ob from marks),
grouped as (
select {keys}, b, min(word_id) as start, string_agg(word, ' ' order by word_id) as seg
from open_at where label in ('B-ASP', 'I-ASP') and b > 0 and o = ob group by {keys}, b),
spans as (
select *, trim(replace(seg, '_', ' ')) as display from grouped
where length(trim(replace(seg, '_', ' '))) >= 2)"""


TAXONOMY = "taxonomy as (select * from (values " + ", ".join(
    f"({quoted(c)}, {quoted(k)}, {i})"
    for i, (c, k) in enumerate((c, k) for c, ks in fx.TAXONOMY.items() for k in ks)
) + ") t(category, keyword, kw_ord))"

RAW_ASPECTS = f"""doc_words as (
select distinct unnest({split('text')}) as w from documents),
raw_aspects as (
select distinct case
  when length(w) % 7 = 0 then 'Sạc nhanh ' || length(w) || ' ' || w
  when length(w) % 7 = 1 then '  T' || w || '_X'
  when length(w) % 7 = 2 and length(w) > 8 then 'màn_hình ' || length(w)
  when length(w) % 7 = 3 and length(w) > 9 then 'Sản_phẩm'
  else w end as aspect_raw from doc_words)"""


def canonical(x: str) -> str:
    s = sub(f"replace(lower({edges(x)}), '_', ' ')", f"{WS}+")
    return f"case when length({s}) >= 2 then {s} end"


def spec(x: str) -> str:
    hit = f"regexp_extract({x}, {quoted(tx.SPEC_TAIL_PATTERN)}, 1)"
    return f"case when {hit} = '' then {x} else {hit} end"


CLEAN_ASPECTS = f"""clean_aspects as (
select aspect_raw, {spec('c')} as s from (
  select aspect_raw, {canonical('aspect_raw')} as c from raw_aspects))"""
TERMS = f"""terms as (
select distinct s from clean_aspects
where s is not null and s not in {strings(fx.BLACKLIST)})"""


def matched(source: str, key: str) -> str:
    """Best contained keyword for each distinct ``key`` of ``source``."""
    return f"""hits as (
select {key}, keyword, category from (select distinct {key} from {source})
join taxonomy on contains({key}, keyword)
qualify row_number() over (
  partition by {key} order by length(keyword) desc, category, kw_ord) = 1)"""


def word_taxonomy(table: str) -> str:
    return f"""taxonomy as (
select 'C' || (length(keyword) % 7) as category, keyword,
  row_number() over (order by keyword) - 1 as kw_ord
from (select distinct unnest({split('lower(text)')}) as keyword from {table})
where length(keyword) >= 4)"""


def ratios(pairs: str) -> tuple[str, ...]:
    """``ratios(s, keyword, category, kw_ord, ratio)`` for rows of ``pairs``.

    The longest common block, the first in s and then in the keyword, splits both
    strings; the same is done left and right of it until nothing is common.
    """
    return (f"""pairs as materialized (select *, row_number() over () as p from {pairs})""",
    """spots as materialized (
select p, i, j, max(i) over (partition by p, i - j, run) - i + 1 as more
from (select *, i - row_number() over (partition by p, i - j order by i) as run
  from (select p, i, s[i + 1] as x, keyword, unnest(range(length(keyword))) as j
        from (select *, unnest(range(length(s))) as i from pairs))
  where x = keyword[j + 1]))""",
    """blocks as (
select p, 0::bigint as a, length(s) as b, 0::bigint as c, length(keyword) as d, 0::bigint as got from pairs
union all
select p, case side when 0 then a when 1 then mid.i + mid.k else 0 end,
  case side when 0 then mid.i when 1 then b else 0 end,
  case side when 0 then c when 1 then mid.j + mid.k else 0 end,
  case side when 0 then mid.j when 1 then d else 0 end,
  case side when 2 then mid.k else 0 end
from (select blocks.p, a, b, c, d, arg_max({'i': i, 'j': j, 'k': least(more, b - i, d - j)},
        least(more, b - i, d - j) * 1000000 - i * 1000 - j) as mid
      from blocks join spots on spots.p = blocks.p and i >= a and i < b and j >= c and j < d
      group by blocks.p, a, b, c, d), (select unnest([0, 1, 2]) as side))""",
    """ratios as (
select s, keyword, category, kw_ord, 2.0::double * got / (length(s) + length(keyword)) as ratio
from pairs join (select p, sum(got) as got from blocks group by p) using (p))""")


def fuzzy(terms: str) -> tuple[str, ...]:
    """``best(s, keyword, category, ratio)`` for the distinct terms of ``terms``.

    Only pairs that as many edits as letters may stay unmatched can turn into each other
    are rated; the others cannot reach the cutoff. (That function edits bytes, so all
    letters beyond ASCII are made one; this brings no pair further apart.)
    """
    total = "(length(s) + length(keyword))"
    plain = "regexp_replace({}, '[^\\x00-\\x7F]', '#', 'g') as {}"
    near = f"""(select s, keyword, category, kw_ord
  from (select s, {plain.format('s', 'a')} from {terms})
  join (select *, {plain.format('keyword', 'b')} from taxonomy)
  on abs(length(s) - length(keyword)) <= {S.LENGTH_BAND}
  and 2 * least(length(s), length(keyword)) >= {S.FUZZY_CUTOFF} * {total}
  and levenshtein(a, b) <= {total} - 2 * ceil({S.FUZZY_CUTOFF} * {total} / 2))"""
    return (*ratios(near), f"""best as (
select * from (select s, keyword, category, ratio from ratios where ratio >= {S.FUZZY_CUTOFF}
  qualify row_number() over (partition by s
    order by ratio desc, length(keyword) desc, category, kw_ord) = 1)
where not contains(keyword, s))""")


def mentions(models, near: bool = False) -> tuple[str, ...]:
    return (
    f"""review_words as (
select ord, product, time_text, text, clean, (i - 1) as word_id, w[i] as word
from (select *, unnest(range(1, len(w) + 1)) as i
      from (select *, {split('clean')} as w from clean where length(clean) > 0))),
tagged as (
select ord, word_id, word, case
  when lower(word) in {strings(models.heads)} then 'B-ASP'
  when lower(word) in {strings(models.tails)} then 'I-ASP' else 'O' end as label
from review_words)""",
    spans("tagged", "ord"),
    """mentions as (
select s.ord * 1048576 + row_number() over (partition by s.ord order by start) - 1 as ord,
  product, text as review_text, clean as sentence, display as aspect_raw, seg as term,
  time_text
from spans s join clean c on s.ord = c.ord)""",
    f"mention_terms as (select *, {spec('c')} as s from "
    f"(select *, {canonical('aspect_raw')} as c from mentions))",
    f"wanted as (select * from mention_terms where s not in {strings(fx.BLACKLIST)})",
    matched("wanted", "s"),
    *(fuzzy("(select distinct s from wanted where s not in (select s from hits))") if near else ()),
    f"""polarities as (
select ord, case when
    count(*) filter (where lower(word) in {strings(models.negative)})
  > count(*) filter (where lower(word) in {strings(models.positive)})
  then 'neg' else 'pos' end as polarity from review_words group by ord)""",
    """extracted as (
select w.ord, product, review_text, h.category, aspect_raw, polarity, time_text,
  sentence, term
from wanted w join hits h on w.s = h.s join polarities p on w.ord // 1048576 = p.ord)""",
    *(("""near as (
select w.ord, product, review_text, n.category, aspect_raw, polarity, time_text
from wanted w join best n on w.s = n.s join polarities p on w.ord // 1048576 = p.ord)""",)
      if near else ()))


MENTIONS = mentions(fx.MODELS)

# ------------------------------------------------------------------------- counts

PROFILE = f"""profile as (
select category, total, pos, neg, {pct('pos', 'total')} as pos_rate,
  {pct('neg', 'total')} as neg_rate,
  {pct('pos - neg', 'grand')} as impact, first_ord
from (select category, {COUNTS} from opinions group by category),
     (select count(*) as grand from opinions))"""
_T = "cast((1.0::double + pos::double / total * 4.0::double) * 4503599627370496 as bigint) * 10"
PRODUCTS = f"""scored as (
select *, {_T} as m from (select product, {COUNTS} from opinions group by product)),
products as (
select product, total, pos, neg, {pct('pos', 'total')} as pos_rate,
  {pct('neg', 'total')} as neg_rate, score,
  case when score >= 4.5 then 5 when score >= 3.5 then 4 else 3 end as stars
from (select *, (m // 4503599627370496
        + case when m % 4503599627370496 > 2251799813685248
             or (m % 4503599627370496 = 2251799813685248
                 and (m // 4503599627370496) % 2 = 1)
          then 1 else 0 end) / 10.0::double as score from scored))"""

DAYS = f"""case when regexp_extract(lower(time_text), {quoted(tx.AGE_PATTERN)}, 1) = '' then -1
  else cast(regexp_extract(lower(time_text), {quoted(tx.AGE_PATTERN)}, 1) as bigint)
    * case regexp_extract(lower(time_text), {quoted(tx.AGE_PATTERN)}, 2)
        when 'ngày' then 1 when 'tuần' then 7 when 'tháng' then 30 else 365 end end"""
SLOTS_BY_AGE = f"""slotted as (
select polarity, case when d > 21 then 0 when d > 14 then 1 when d > 7 then 2
  when d >= 1 then 3 when d = 0 then 4 end as slot
from (select polarity, {DAYS} as d from opinions))"""
SLOTS_BY_PLACE = """slotted as (
select polarity, (row_number() over (order by ord) - 1)
  // (select ceil(count(*) / 5)::bigint from opinions) as slot from opinions)"""
TREND = f"""trend as (
select g.slot::integer as slot, coalesce(total, 0) as total,
  coalesce({pct('pos', 'total')}, 0) as pos_rate, coalesce({pct('neg', 'total')}, 0) as neg_rate
from (select unnest(range(5)) as slot) g
left join (select slot, {N} as total, {NPOS} as pos, {NNEG} as neg
           from slotted group by slot) s on g.slot = s.slot)"""
SERIES = """select string_agg((slot * 25) || ',' || (100 - pos_rate), ' ' order by slot) as pos_pts,
  string_agg((slot * 25) || ',' || (100 - neg_rate), ' ' order by slot) as neg_pts,
  '0,100 ' || string_agg((slot * 25) || ',' || (100 - pos_rate), ' ' order by slot)
    || ' 100,100' as pos_poly from trend"""
HEAT = f"""top_cats as (
select category, row_number() over (order by total desc, first_ord) - 1 as col
from (select category, {COUNTS} from opinions group by category)
order by total desc, first_ord limit 10),
cells as (
select g.product, col::integer as col, g.category,
  coalesce({pct('pos', 'total')}, 0) as pos_pct, coalesce({pct('neg', 'total')}, 0) as neg_pct
from (select product, category, col from (select distinct product from opinions), top_cats) g
left join (select product, category, {COUNTS} from opinions group by product, category) c
  on g.product = c.product and g.category = c.category)"""

# --------------------------------------------------------------------------- feed

FEED = """tag_first as (
select review_text as text, category as aspect, polarity, min(ord) as ord,
  arg_min(product, ord) as product
from opinions group by all),
tags as (
select text, aspect, polarity, first_value(product) over w as product,
  row_number() over w - 1 as tag_pos,
  row_number() over (order by text, ord) as place
from tag_first window w as (partition by text order by ord)),
feed as (
select text, first(product) as product,
  string_agg(aspect || ':' || polarity, '|' order by tag_pos) as tags
from tags group by text)"""


def chosen(sel) -> str:
    """The tags of the selected items, before the category restriction."""
    conds = ["true"]
    if sel.product is not None:
        conds.append(f"product = {quoted(sel.product)}")
    if sel.category is not None:
        conds.append(f"text in (select text from tags where aspect = {quoted(sel.category)})")
    if sel.query:
        q = quoted(sel.query.lower())
        conds.append(
            f"(contains(lower(text), {q}) or contains(lower(product), {q}) or text in "
            f"(select text from tags where contains(lower(aspect), {q})))")
    return " and ".join(conds)


def sliced(sel) -> str:
    only = "" if sel.category is None else f" and aspect = {quoted(sel.category)}"
    return f"sliced as (select * from tags where {chosen(sel)}{only})"


SLICE_COUNTS = f"""counted as (
select aspect, {N} as total, {NPOS} as pos, {NNEG} as neg, min(place) as seen
from sliced group by aspect)"""


def page_sql(sel, page: int, size: int = 10) -> str:
    return with_(OPINIONS, FEED, f"""found as (
select *, row_number() over (order by text) - 1 as row, count(*) over () as found
from feed where {chosen(sel)}),
paged as (
select *, greatest(1, ceil(found / {size}))::integer as pages from found),
placed as (select *, least({page}, pages)::integer as page from paged)""") + (
        "select text, product, tags, row, found, pages, page from placed "
        f"where row >= (page - 1) * {size} and row < page * {size}")


FACETS = """facets as (
select product, count(*) as items, min(text) as seen from feed group by product)"""


def facet_sql(page: int, size: int = 20) -> str:
    return with_(OPINIONS, FEED, FACETS, f"""ranked as (
select product, items, row_number() over (order by items desc, seen) - 1 as row,
  greatest(1, ceil(count(*) over () / {size}))::integer as pages from facets),
placed as (
select *, (case when {page} > pages then 1 else {page} end)::integer as page from ranked)""") + (
        f"select page, pages, row, product, items from placed "
        f"where row >= (page - 1) * {size} and row < page * {size}")


def slice_aspects_sql(sel) -> str:
    return with_(OPINIONS, FEED, sliced(sel), SLICE_COUNTS) + """
select aspect, total, pos, neg, total / max(total) over () * 100 as bar_width
from (select * from counted order by total desc, seen limit 10)"""


# ------------------------------------------------------------------------- ledger


def hex_sum(start: int, size: int = 12) -> str:
    return f"sum(cast('0x' || substr(d, {start}, {size}) as bigint))::varchar"


# the digested columns in the order of their names, doc_id being called ord
DIGESTED = {"lang": "lang", "n_chars": "n_chars", "ord": "doc_id", "text": "text"}
DIGEST = " || ".join(
    f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in DIGESTED.values())


CONTENT_KEY = f"""keys as (
select source, count(*) as rows,
  md5(concat_ws('|', count(*), {hex_sum(1)}, {hex_sum(13)}, {hex_sum(25, 8)},
    {', '.join(quoted(n) for n in (*DIGESTED, *_role_names(DOC_ROLES)))})) as cache_key
from (select source, md5({DIGEST}) as d from documents) group by source),
uploads as (
select cast(substr(source, 4) as bigint) as batch, source || '.csv' as name,
  rows, cache_key as hash from keys),
ledger as (
select batch + 1 as seq, name, '02/01/2026 03:04' as date, rows, hash
from uploads where batch % 2 = 0)"""
STALE = """stale as (
select distinct lower(p_type) as cache_key from part
where p_type || '-' || (p_size % 2) = 'PROMO-1')"""
GAPPY = """gappy as (
select case when o_custkey % 5 > 0 then o_orderstatus end as status,
  case when o_custkey % 5 > 1 then o_orderpriority end as priority,
  case when o_custkey % 5 > 2 then o_custkey % 97 end as cust,
  o_orderkey as ord from orders)"""


def on_reviews(x: str, view: str = REVIEWS) -> str:
    return with_(view) + f"select ord, {x} as out from reviews"


ORACLE: dict[str, str] = {
    "read_reviews": """select row_number() over (order by doc_id) - 1 as ord,
        doc_id::varchar as doc_id, source, n_chars::varchar as n_chars,
        md5(text) as text_md5 from documents""",
    "read_reviews_csv": """select row_number() over (order by doc_id) - 1 as ord,
        doc_id::varchar as doc_id, text, lang, source, n_chars::varchar as n_chars from documents""",
    "bind_roles": """select row_number() over (order by doc_id) - 1 as ord,
        source as product, text, '' as time_text from documents""",
    "bind_roles_defaults": f"""select row_number() over (order by doc_id) - 1 as ord,
        '{S.DEFAULT_PRODUCT}' as product, text, lang as time_text from documents""",
    "drop_empty_rows": with_(GAPPY) + """select * from gappy
        where status is not null or priority is not null or cust is not null""",
    "dedupe_rows": with_(GAPPY) + """select status, priority, cust, min(ord) as ord
        from gappy group by status, priority, cust""",
    "load_report": with_(GAPPY) + """select (select count(*) from gappy) as rows_read,
        (select count(*) from (select distinct status, priority, cust from gappy
          where status is not null or priority is not null or cust is not null)) as rows_kept""",
    "blank_missing": on_reviews(BLANKED),
    "nfc_text": on_reviews("nfc_normalize(text)"),
    "strip_urls": on_reviews(sub("text", tx.URL_PATTERN)),
    "strip_html": on_reviews(sub("text", tx.TAG_PATTERN)),
    "strip_html_pages": on_reviews(sub("text", tx.TAG_PATTERN), PAGES),
    "collapse_ws": on_reviews(collapsed("text")),
    "preprocess_text": on_reviews(preprocessed("text")),
    "clean_reviews": with_(REVIEWS, CLEAN) + "select * from clean where length(clean) > 0",
    "clean_html_reviews": with_(PAGES, CLEAN)
    + "select ord, product, clean from clean where length(clean) > 0",
    "parse_days_ago": with_(OPINIONS) + f"select ord, time_text, {DAYS} as days_ago from opinions",
    "polarity_code": with_(OPINIONS) + f"""select ord,
        case polarity when 'pos' then '{S.DISPLAY_POS}' when 'neg' then '{S.DISPLAY_NEG}' end
          as shown, polarity as code from opinions""",
    # tokens
    "split_words": with_(SENTENCES, WORDS) + "select * from words",
    "argmax_label": with_(SENTENCES, WORDS, TOKENS)
    + f"select sent_id, pos, word_id, {LABEL} as label from tokens",
    "truncate_subwords": with_(SENTENCES, WORDS, TOKENS, KEPT)
    + "select sent_id, pos, word_id from kept",
    "first_subword_label": with_(SENTENCES, WORDS, TOKENS, FIRST)
    + "select * from first_label",
    "align_words_labels": with_(SENTENCES, WORDS, TOKENS, FIRST)
    + "select * from words join first_label using (sent_id, word_id)",
    "bio_spans": with_(SENTENCES, WORDS, LABELLED, spans("labelled", "sent_id"))
    + "select sent_id, start, display, seg from spans",
    "bio_spans_in_row": with_(SENTENCES, WORDS, LABELLED, spans("labelled", "sent_id"))
    + """select sent_id, row_number() over (partition by sent_id order by start) - 1 as nth,
        display, seg from (select sent_id, start, display, seg from spans)""",
    "score_tokens": with_(REVIEWS, CLEAN) + f""", words as (
        select sent_id, (i - 1)::integer as word_id, w[i] as word from (
          select ord as sent_id, w, unnest(range(1, len(w) + 1)) as i
          from (select ord, {split('clean')} as w from clean where length(clean) > 0))),
        pieces as (
        select sent_id, word_id, p, case when p > 0 then 'O'
            when lower(word) in {strings(fx.MODELS.heads)} then 'B-ASP'
            when lower(word) in {strings(fx.MODELS.tails)} then 'I-ASP' else 'O' end as label
        from (select *, unnest(range(0, greatest(1, cast(ceil(length(word) / 4) as bigint)))) as p
              from words)),
        ends as (select sent_id, count(*) + 1 as last from pieces group by sent_id)
        select sent_id, row_number() over (partition by sent_id order by word_id, p) as pos,
          word_id, label from pieces
        union all select sent_id, 0, null, 'O' from ends
        union all select sent_id, last, null, 'O' from ends""",
    "segment_words": with_(REVIEWS, CLEAN) + f""", words as (
        select ord, i, w[i] as word, i > 1 and lower(w[i - 1] || ' ' || w[i]) in {strings(fx.PHRASES)} as joins
        from (select ord, w, unnest(range(1, len(w) + 1)) as i
              from (select ord, {split('clean')} as w from clean where length(clean) > 0)))
        select ord, string_agg(case when i = 1 then '' when joins then '_' else ' ' end || word, '' order by i)
          as segmented from words group by ord""",
    "tag_mentions": with_(REVIEWS, CLEAN, *MENTIONS[:3])
    + "select ord, product, aspect_raw from mentions",
    "build_pairs": with_(REVIEWS, CLEAN, TAXONOMY, *MENTIONS)
    + "select ord, sentence, term from extracted",
    "score_pairs": with_(REVIEWS, CLEAN, TAXONOMY, *MENTIONS)
    + """select ord, term, case polarity when 'pos' then 'positive' else 'negative' end as label
        from extracted""",
    "extract_opinions": with_(REVIEWS, CLEAN, TAXONOMY, *MENTIONS)
    + """select ord, product, review_text, category, aspect_raw, polarity, time_text
        from extracted""",
    "extract_opinions_fuzzy": with_(REVIEWS, CLEAN, TAXONOMY, *mentions(fx.NEAR_MODELS, near=True))
    + """select ord, product, review_text, category, aspect_raw, polarity, time_text
        from extracted union all select * from near""",
    "score_stream": with_(
        """reviews as (select doc_id as ord, source as product, text, '' as time_text
        from documents)""", CLEAN, TAXONOMY, *MENTIONS)
    + """select ord, product, review_text, category, aspect_raw, polarity from extracted""",
    # taxonomy
    "canonical_aspect": with_(RAW_ASPECTS)
    + f"select aspect_raw, {canonical('aspect_raw')} as canonical from raw_aspects",
    "strip_spec_tail": with_(RAW_ASPECTS, CLEAN_ASPECTS) + "select * from clean_aspects",
    "drop_generic": with_(RAW_ASPECTS, CLEAN_ASPECTS, TERMS) + "select * from terms",
    "keyword_match": with_(RAW_ASPECTS, CLEAN_ASPECTS, TERMS, TAXONOMY, matched("terms", "s"))
    + "select t.s, keyword, category from terms t left join hits h on t.s = h.s",
    "keyword_match_words": with_(TAXONOMY) + f"""select sent_id, keyword, category from (
        select conv_id * 1000 + turn as sent_id,
          ' ' || trim({sub('lower(text)', f'[^{tx.WORD}]+')}) || ' ' as hay from conversations) s
        left join taxonomy on contains(hay, ' ' || keyword || ' ')
        qualify row_number() over (partition by sent_id
          order by length(keyword) desc nulls last, category, kw_ord) = 1""",
    "keyword_match_join": with_(RAW_ASPECTS, CLEAN_ASPECTS, TERMS, TAXONOMY, matched("terms", "s"))
    + "select s, keyword, category from hits",
    "keyword_match_large": with_(
        RAW_ASPECTS, CLEAN_ASPECTS, TERMS, word_taxonomy("conversations"),
        """parts as (select distinct s, substr(s, i, n) as part from (
          select s, n, unnest(range(1, length(s) - n + 2)) as i from (
            select s, unnest(range(4, length(s) + 1)) as n from terms)))""")
    + """select s, keyword, category from parts join taxonomy on part = keyword
        qualify row_number() over (
          partition by s order by length(keyword) desc, category, kw_ord) = 1""",
    "similarity": with_(
        RAW_ASPECTS, CLEAN_ASPECTS, TERMS, TAXONOMY, *ratios("""(select s, keyword, category, kw_ord
        from terms join taxonomy on abs(length(s) - length(keyword)) <= 3)"""))
    + "select s, keyword, ratio from ratios",
    "fuzzy_match": with_(RAW_ASPECTS, CLEAN_ASPECTS, TERMS, TAXONOMY, *fuzzy("terms"))
    + "select * from best",
    "fuzzy_match_large": with_(
        RAW_ASPECTS, CLEAN_ASPECTS, TERMS, word_taxonomy("benchmark"), *fuzzy("terms"))
    + "select * from best",
    "normalize_aspects": with_(
        RAW_ASPECTS, CLEAN_ASPECTS, TERMS, TAXONOMY, matched("terms", "s"),
        *fuzzy("(select s from terms where s not in (select s from hits))"))
    + """select aspect_raw, coalesce(h.category, n.category) as category from clean_aspects c
        left join hits h on c.s = h.s left join best n on c.s = n.s
        where coalesce(h.category, n.category) is not null""",
    "length_band_candidates": with_(RAW_ASPECTS, CLEAN_ASPECTS, TERMS, TAXONOMY)
    + """select s, category, keyword from terms join taxonomy
        on abs(length(s) - length(keyword)) <= 3""",
    "normalize_aspects_exact": with_(
        RAW_ASPECTS, CLEAN_ASPECTS, TERMS, TAXONOMY, matched("terms", "s"))
    + "select aspect_raw, category from clean_aspects c join hits h on c.s = h.s",
    "validate_categories": with_(OPINIONS) + """select aspect_raw,
        count(*) > 0 and count(*) filter (where category = 'PROMO-1') = 0 as valid
        from opinions group by aspect_raw""",
    "taxonomy_index": """select p_type as category, lower(p_name) as keyword,
        length(p_name) as kw_len, row_number() over (
          order by length(p_name) desc, p_type, p_partkey) - 1 as rank from part""",
    # metrics
    "kpi_metrics": with_(OPINIONS) + f"""select total, pos as pos_count, neg as neg_count,
        pos_rate, neg_rate, 100 - pos_rate - neg_rate as neu_rate, pos_rate - neg_rate as nps,
        case when pos_rate >= neg_rate then 'good' else 'needs improvement' end as nps_band
        from (select *, {pct('pos', 'total')} as pos_rate, {pct('neg', 'total')} as neg_rate
              from (select {COUNTS} from opinions))""",
    "top_aspect": with_(OPINIONS) + f"""select category as top_aspect, total as top_aspect_count
        from (select category, {COUNTS} from opinions group by category)
        order by total desc, first_ord limit 1""",
    "opinion_cube": with_(OPINIONS)
    + f"select product, category, {COUNTS} from opinions group by product, category",
    "aspect_profile": with_(OPINIONS, PROFILE)
    + "select category, total, pos, neg, pos_rate, neg_rate from profile",
    "aspect_impact": with_(OPINIONS, PROFILE) + "select category, pos, neg, impact from profile",
    "worst_aspects": with_(OPINIONS, PROFILE)
    + """select category, total, pos, neg, pos_rate, neg_rate, impact
        from profile order by neg desc, total desc, first_ord limit 8""",
    "drivers": with_(OPINIONS, PROFILE) + """(select 'pos' as side, category, impact as rate,
          row_number() over (order by impact desc, total desc, first_ord) - 1 as place
        from profile where impact > 0 order by place limit 2)
        union all (select 'neg', category, abs(impact),
          row_number() over (order by impact, total desc, first_ord) - 1 as place
        from profile where impact < 0 order by place limit 2)""",
    "has_time": with_(OPINIONS) + "select bool_or(time_text <> '') as has_time from opinions",
    "trend_by_recency": with_(OPINIONS, SLOTS_BY_AGE, TREND) + "select * from trend",
    "trend_by_position": with_(OPINIONS, SLOTS_BY_PLACE, TREND) + "select * from trend",
    "trend_series": with_(OPINIONS, SLOTS_BY_AGE, TREND) + SERIES,
    "trend_series_untimed": with_(OPINIONS, SLOTS_BY_PLACE, TREND) + SERIES,
    "product_ranking": with_(OPINIONS, PRODUCTS)
    + "select *, row_number() over (order by score desc, product) as rank from products",
    "best_products": with_(OPINIONS, PRODUCTS)
    + "select * from products order by pos_rate desc, score desc, product limit 3",
    "top_products": with_(OPINIONS, PRODUCTS)
    + """select product, total, pos, neg, pos_rate, neg_rate from products
        order by total desc, score desc, product limit 15""",
    "top_aspects_scaled": with_(OPINIONS, PROFILE)
    + """select category, total, pos, neg, pos_rate, neg_rate,
          total / max(total) over () * 100 as bar_width
        from (select * from profile order by total desc, first_ord limit 10)""",
    "heatmap": with_(OPINIONS, HEAT) + "select * from cells",
    "heatmap_dominant": with_(OPINIONS, HEAT) + """select product, category,
        case when greatest(pos_pct, neg_pct) = 0 then null
          when pos_pct >= neg_pct then 'pos' else 'neg' end as side,
        greatest(pos_pct, neg_pct) as value from cells""",
    "heatmap_maps": with_(OPINIONS, HEAT) + """select product,
        string_agg(category || ':' || pos_pct || ':' || neg_pct, '|' order by category) as cells
        from cells group by product""",
    "sample_reviews": with_(OPINIONS) + f"""select product, total,
        string_agg(line, chr(10) || chr(10) order by place) || case when total > 10
          then chr(10) || chr(10) || '... và ' || (total - 10) || ' đánh giá khác' else '' end
          as tooltip
        from (select product, row_number() over (partition by product order by ord) as place,
            count(*) over (partition by product) as total,
            case polarity when 'pos' then '{S.DISPLAY_POS}' else '{S.DISPLAY_NEG}' end
              || ' | ' || category || ':' || chr(10) || '  "' || replace(review_text, '"', '''')
              || '"' as line from opinions)
        where place <= 10 group by product, total""",
    # feed
    "review_feed": with_(OPINIONS, FEED) + "select * from feed",
    "feed_summary": with_(OPINIONS) + """select *,
        sentences || ' câu → ' || mentions || ' khía cạnh' as caption
        from (select count(distinct review_text) as sentences, count(*) as mentions
              from opinions)""",
    "smart_alerts": with_(OPINIONS, FEED) + """select
        case polarity when 'neg' then 'quality' else 'opportunity' end as alert,
        product, aspect, mentions
        from (select product, aspect, polarity, count(*) as mentions, min(place) as seen
              from tags where polarity in ('pos', 'neg') group by product, aspect, polarity)
        qualify row_number() over (partition by polarity order by mentions desc, seen) = 1""",
    "aspect_facet_counts": with_(OPINIONS, FEED)
    + "select aspect, count(distinct text) as items from tags group by aspect",
    "product_facet_counts": with_(OPINIONS, FEED)
    + "select product, count(*) as items from feed group by product",
    "facet_page": facet_sql(2),
    "facet_page_past_end": facet_sql(9),
    "filter_feed": with_(OPINIONS, FEED) + f"select * from feed where {chosen(SELECTION)}",
    "search_feed": with_(OPINIONS, FEED) + f"select * from feed where {chosen(SEARCH)}",
    "feed_page": page_sql(SEARCH, 3),
    "feed_page_past_end": page_sql(SELECTION, 900),
    "feed_page_deep": page_sql(type(SEARCH)(), 10**9),
    "slice_aspects": slice_aspects_sql(SEARCH),
    "slice_aspects_selected": slice_aspects_sql(SELECTION),
    "slice_sentiment": with_(OPINIONS, FEED, sliced(SELECTION)) + f"""select pos, neg,
        {half_up('pos', '(pos + neg)')} as pos_rate, {half_up('neg', '(pos + neg)')} as neg_rate
        from (select {NPOS} as pos, {NNEG} as neg from sliced)""",
    "slice_alerts": with_(OPINIONS, FEED, sliced(SEARCH), SLICE_COUNTS)
    + f"""select aspect, neg, {half_up('neg', 'total')} as neg_rate from counted
        where neg > 0 order by neg desc, seen limit 5""",
    "slice_best_products": with_(OPINIONS, FEED, sliced(type(SEARCH)(category="PROMO-0")))
    + f"""select product, total, pos_rate from (
          select product, {N} as total, {half_up(NPOS, N)} as pos_rate, min(place) as seen
          from sliced group by product)
        order by pos_rate desc, seen limit 3""",
    # store, ledger
    "write_opinions": with_(OPINIONS)
    + """select aspect_raw as cache_key, polarity, count(*) as n
        from opinions group by aspect_raw, polarity""",
    "store_cube": with_(OPINIONS)
    + f"""select product, category, {COUNTS} from opinions where aspect_raw <> 'medium'
        group by product, category""",
    "stored_page_deep": page_sql(type(SEARCH)(), 10**9),
    "stored_facet_page": facet_sql(2),
    "write_nothing": with_(OPINIONS) + """select aspect_raw as cache_key, count(*) as n
        from opinions where aspect_raw <> 'promo' group by aspect_raw""",
    "analyse_upload": with_(
        """reviews as (select doc_id as ord, source as product, text, '' as time_text
        from documents)""", CLEAN, TAXONOMY, *MENTIONS)
    + "select product, review_text, category, aspect_raw, polarity from extracted",
    "file_key": f"""with texts as (
        select doc_id // 1000 as block, doc_id, string_split(text, chr(10)) as parts from documents),
        lines as (select block, doc_id, i, parts[i] as value
          from (select *, unnest(range(1, len(parts) + 1)) as i from texts)),
        placed as (select block, value,
          (row_number() over (partition by block order by doc_id, i) - 1)::varchar as ord from lines)
        select block, count(*) as rows, md5(concat_ws('|', count(*), {hex_sum(1)}, {hex_sum(13)},
          {hex_sum(25, 8)}, 'ord', 'value',
          {', '.join(quoted(n) for n in _role_names(DOC_ROLES))})) as cache_key
        from (select block, md5(length(ord) || ':' || ord || length(value) || ':' || value) as d
          from placed) group by block""",
    "read_opinions": with_(OPINIONS) + "select * from opinions where aspect_raw = 'medium'",
    "latest_opinions": with_(OPINIONS) + """select * from opinions where aspect_raw = (
        select lower(p_type) from part
        order by ascii(lower(p_type)) * 1000 + length(p_type) desc limit 1)""",
    "load_history": with_(OPINIONS) + "select * from opinions where aspect_raw = 'economy'",
    "purge_stale": with_(OPINIONS, STALE) + """select aspect_raw as cache_key, count(*) as n
        from opinions where aspect_raw not in (select cache_key from stale) group by aspect_raw""",
    "stale_keys": with_(STALE) + "select * from stale",
    "content_key": with_(CONTENT_KEY) + "select * from keys",
    "append_history": with_(CONTENT_KEY) + """select * from ledger union all
        select (select max(seq) from ledger) + batch + 1, name, '02/01/2026 03:04', rows, hash
        from uploads""",
    "skip_processed": with_(CONTENT_KEY) + """select batch, name, hash,
        case when hash in (select hash from ledger) then 'cached' else 'new' end as status
        from uploads""",
    "history_view": with_(CONTENT_KEY) + """select seq, name, date, rows,
        case when seq % 3 = 0 then '' else 'b' || hash || 'b' end as key,
        seq % 3 <> 0 as can_open from ledger""",
}
# the same results, found again or stored by another way
ORACLE["normalize_aspects_memo"] = ORACLE["normalize_aspects"]
ORACLE["score_uploads"] = ORACLE["analyse_upload"]
# both model slots filled from the same word lists give the same opinions
ORACLE["extract_opinions_models"] = ORACLE["extract_opinions"]

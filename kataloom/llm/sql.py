"""The training-data queries that SQL can express, in DuckDB's dialect, by plain definitions."""

from __future__ import annotations

import unicodedata

#: Latin letters, each with a letter that looks like it, by the other script.
TWINS = {
    "Cyrillic": "AА BВ CС EЕ HН IІ JЈ KК MМ OО PР QԚ SЅ TТ WԜ XХ YҮ YУ ËЁ ÏЇ aа cс dԁ eе hһ iі jј oо pр qԛ sѕ wԝ xх yу yү ëё ïї",
    "Greek": "AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ jϳ oο vν ÁΆ ÉΈ HΉ ÍΊ ÓΌ ÝΎ óό",
    "Armenian": "OՕ UՍ gց hհ nո oօ uս",
    "Latin": "aɑ gɡ iı",
}


#: A run of letters, digits and underscores, or of other characters that aren't white space.
RUNS_OF = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x{85}\p{Z}\x1c-\x1f]+"


def _looks() -> str:
    """The form in which texts that look the same are equal, step by step from the definition, as SQL over ``text_raw``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    twins = [pair for row in TWINS.values() for pair in row.split()]
    wide = [chr(c) for c in range(0xFF01, 0xFFEF) if unicodedata.decomposition(chr(c)).split(" ")[0] in ("<wide>", "<narrow>") and c != 0xFFA0]
    plain = [chr(int(unicodedata.decomposition(c).split(" ")[1], 16)) for c in wide]
    out, picture, held = "text_raw", r"[\p{So}\p{Sk}\x{1f000}-\x{1faff}]", ""
    # A joiner between two pictures shows: it is kept under another sign. Pictures share their neighbours, so this is done twice.
    for _ in range(2):
        out = rf"regexp_replace({out}, '({picture}\x{{fe0f}}?)\x{{200d}}({picture})', '\1{held}\2', 'g')"
    # Format characters, selectors, fillers and control characters, besides tab and line breaks, don't show.
    unseen = r"\p{Cf}\x{34f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{3164}\x{ffa0}\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}\x{1}-\x{8}\x{e}-\x{1f}\x{7f}"
    out = f"regexp_replace({out}, '[{unseen}]', '', 'g')"
    out = rf"regexp_replace({out}, '\p{{Zs}}', ' ', 'g')"
    for a, b in ((wide, plain), ([x[1] for x in twins], [x[0] for x in twins])):
        out = f"translate({out}, {quote(''.join(a))}, {quote(''.join(b))})"
    return f"nfc_normalize({out})"


def oracle_sql() -> dict[str, str]:
    counted = """
        select distinct comment_id, token from (
            select comment_id, unnest(tokens) as token from cleaned_comments where not is_duplicate and not is_spam
        ) where token is not null and token <> '' and comment_id is not null"""
    blanks = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"
    punctuation = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
    leaf = lambda x: f"lower(translate({x}, {blanks}||{punctuation}, ''))"
    return {
        "p1_found": f"""
            with c as ({counted}), n as (select count(distinct comment_id) as n from c),
            d as (select token, count(*) as k from c group by token),
            big as (select c.* from c join d using (token), n where k >= 4 and 800 * k >= n.n),
            p as (select a.token as token_a, b.token as token_b, count(*) as k from big a join big b on a.comment_id = b.comment_id and a.token < b.token group by all)
            select token_a, token_b from p join d x on x.token = token_a join d y on y.token = token_b, n
            where p.k >= 4 and 800 * p.k >= n.n and n.n::hugeint * p.k >= 8::hugeint * x.k * y.k""",
        "p3_found": f"""
            with r as (select id, text_raw as t, {leaf('text_raw')} as plain from comments where text_raw is not null),
            s as (select *, list_filter(regexp_split_to_array(t, '[|;\\r\\n]+'), lambda x: regexp_matches(x, '\\S')) as parts from r where length(plain) >= 12),
            f as (select *, case when len(parts) >= 2 and len(list_filter(parts, lambda x: regexp_matches(x, '(?s)^\\s*[\\p{{L}}\\p{{N}}_]+\\s*[:=]\\s*\\S.*$'))) = len(parts)
                then array_to_string(list_sort(list_transform(parts, lambda x: {leaf("regexp_replace(x, '(?s)[:=].*$', '')")} || '/' || {leaf("regexp_replace(x, '(?s)^[^:=]*[:=]', '')")})), '//') end as fields from s),
            k as (select plain, min(fields) as fields from f group by plain),
            g as (select f.id, coalesce('f' || k.fields, 't' || f.plain) as key from f join k using (plain)),
            m as (select key, min(id) as first_id from g group by key)
            select first_id, id as copy_id from g join m using (key) where id <> first_id""",
        "p4_found": f"""
            with r as (select id, text_raw, {_looks()} as form from comments where text_raw is not null),
            g as (select form, min(id) as first_id, arg_min(text_raw, id) as first_text from r group by form)
            select first_id, id as twin_id from r join g using (form) where text_raw <> first_text""",
        "p5_found": r"""
            with recursive w as (select id, list_sort(list_distinct(regexp_extract_all(lower(text_raw), '[\p{L}\p{N}]+'))) as words from comments where text_raw is not null),
            s as (select words, min(id) as id, len(words) as n from w where len(words) >= 10 group by words),
            x as (select id, n, unnest(words) as word from s),
            df as (select word, count(*) as k from x group by word),
            o as (select x.id, x.n, x.word, row_number() over (partition by x.id order by df.k, x.word) as place from x join df using (word)),
            cand as (select distinct a.id as a, b.id as b from o a join o b on a.word = b.word and a.id < b.id
                where a.place <= a.n - ceil(0.7 * a.n) + 1 and b.place <= b.n - ceil(0.7 * b.n) + 1 and 10 * a.n >= 7 * b.n and 10 * b.n >= 7 * a.n),
            link as (select a, b from cand join s p on p.id = a join s q on q.id = b
                where 10 * len(list_intersect(p.words, q.words)) >= 7 * (p.n + q.n - len(list_intersect(p.words, q.words)))),
            arcs as (select a, b from link union all select b, a from link),
            reach(node, root) as (select a, a from arcs union select b, root from reach join arcs on a = node where root < b),
            root as (select node, min(root) as root from reach group by node),
            g as (select w.id, coalesce(root.root, s.id) as root from w join s using (words) left join root on root.node = s.id),
            first as (select root, min(id) as first_id from g group by root)
            select first_id, id as other_id from g join first using (root) where id <> first_id""",
        "p6_found": f"""
            with c as ({counted}), n as (select count(distinct comment_id) as n from c), d as (select token as term, count(*) as k from c group by token)
            select term, case when k <= 2 then 'rare' else 'common' end as mark from d, n where k <= 2 or 10 * k > n.n""",
        "p7_documents": "select doc_id, true as once, true as split_only_if_larger from documents where length(text) > 0",
        "p7_contents": rf"""
            with r as (select regexp_extract_all(text, '{RUNS_OF}') as runs from documents where text is not null), s as (select len(runs) as n, length(array_to_string(runs, '')) as k from r where len(runs) > 0)
            select sum(n)::bigint as runs, sum(k)::bigint as characters, sum(ceil(n / (select max_tokens from size_limits where limit_name = 'container')))::bigint as parts, false as wrong from s""",
        "p8_kept": """
            with d as (select distinct lower(trim(source)) as source from documents where length(text) > 0), t as (select lower(trim(source)) as source, target_share from mix_targets),
            g as (select sum(target_share) as g from t join d using (source))
            select t.source, round(case when d.source is null then 0 else target_share / g end, 6) as goal_share, true as reached, true as within_cap from t left join d using (source), g""",
        "p9_covered": "select doc_id, length(text) as characters, true as within_limits from documents where length(text) > 0",
        "p9_found": r"""
            select doc_id from documents where len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x{85}\p{Z}\x1c-\x1f]+')) > (select max_tokens from size_limits where limit_name = 'piece')""",
    }

"""The queries of ``queries`` in DuckDB's SQL, written from their definitions."""

from __future__ import annotations

import unicodedata

from kataloom.config import DEFAULTS
from kataloom.functions.words import slang_map, stopwords

W = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x{85}\p{Z}\x{1c}-\x{1f}]"
TOKEN = W + r"+(?:[-'']" + W + "+)*"
CANDIDATES = """
    select n as id, lower(trim(term)) as term, case when lower(trim(term)) like '#%' then 'HASHTAG' when instr(lower(trim(term)), ' ') > 0 then 'PHRASE' else 'KEYWORD' end as type,
        ['LEXICON', 'FREQUENCY', 'NGRAM'][1 + (n // 7) % 3] as source_method, n % 50 as frequency, (n % 1000) / 1000.0::double as score, url as discovered_from,
        (n % 5)::int as iteration, ['PENDING', 'APPROVED', 'REJECTED', 'PENDING'][1 + (n // 7) % 4] as status
    from (select *, ('0x' || substr(md5(entry_key), 1, 6))::bigint as n from lexicon_entries where not excluded and term is not null)"""
DOCS = "select id as comment_id, t as tokens from (select id, list_filter(tokens, lambda x: x is not null and x <> '') as t from cleaned_comments where not is_duplicate and not is_spam) where len(t) > 0"
NORMAL_TERM = lambda c: rf"lower(trim(regexp_replace(regexp_replace({c}, '[\x{{00}}-\x{{1f}}\x{{7f}}]', '', 'g'), '{SPACE}+', ' ', 'g')))"


def _nfkc(c: str) -> str:
    """NFKC for texts whose compatibility characters are single ones: translate, then compose."""
    table = {}
    for code in [*range(0xA0, 0x3100), *range(0xFF00, 0xFFF0)]:
        x = unicodedata.normalize("NFKC", chr(code))
        if unicodedata.decomposition(chr(code)).startswith("<") and len(x) == 1 and x != chr(code):
            table[chr(code)] = x
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"nfc_normalize(translate({c}, {q(''.join(table))}, {q(''.join(table.values()))}))"


def _normalized(c: str) -> str:
    out = _nfkc(c)
    out = rf"regexp_replace({out}, '[\x{{00}}-\x{{08}}\x{{0b}}\x{{0c}}\x{{0e}}-\x{{1f}}\x{{7f}}-\x{{9f}}\p{{Cf}}\p{{Co}}]', '', 'g')"
    out = f"lower({out})"
    out = rf"regexp_replace({out}, '(?:https?://|www\.)\S+', '', 'gi')"
    out = rf"regexp_replace({out}, '@[\p{{L}}\p{{N}}_.\-]+', '', 'g')"
    out = rf"regexp_replace({out}, '#([\p{{L}}\p{{N}}_]+)', '\1', 'g')"
    # No back references: a character goes if it equals the two before it.
    out = f"list_transform([string_split({out}, '')], lambda s: list_aggregate(list_filter(s, lambda x, i: i < 3 or x <> s[i-1] or x <> s[i-2]), 'string_agg', ''))[1]"
    return f"trim(regexp_replace(coalesce({out}, ''), '{SPACE}+', ' ', 'g'))"


def _grams(sizes: list[int]) -> str:
    one = lambda k: f"select comment_id, unnest(list_transform(range(1, len(tokens) - {k - 2}), lambda i: array_to_string(tokens[i:i+{k - 1}], ' '))) as term, {k}::bigint as size from docs where len(tokens) >= {k}"
    return " union all ".join(map(one, sizes))


def _tfidf(sublinear: bool, smooth: bool, sizes: list[int] = [1]) -> str:  # noqa: B006
    tf = "1 + ln(tf)" if sublinear else "tf"
    idf = "ln(1 + n.n / df.df)" if smooth else "ln(n.n / df.df)"
    return f"""grams as ({_grams(sizes)}), tf as (select comment_id, term, count(*)::double as tf from grams group by all), df as (select term, count(*)::double as df from tf group by term),
        n as (select count(*)::double as n from docs), w as (select comment_id, term, ({tf}) * ({idf}) as w from tf join df using (term), n),
        norm as (select comment_id, sqrt(sum(w * w)) as norm from w group by comment_id), x as (select term, w / case when norm > 0 then norm else 1 end as x from w join norm using (comment_id)),
        scores as (select term, sum(x) as score, count(*) as doc_freq, greatest(max(x), 0) as max_weight from x group by term)"""


_PAIRS = """raw as (select comment_id, unnest(range(1, len(tokens) + 1)) as i, tokens from docs), step as (select unnest(range(1, 5)) as k),
    p as (select least(tokens[i], tokens[i + k]) as l, greatest(tokens[i], tokens[i + k]) as r from raw, step where i + k <= len(tokens) and tokens[i] <> tokens[i + k]),
    c as (select l as "left", r as "right", count(*) as "count" from p group by all), m as (select t, count(*)::double as m from (select l as t from p union all select r from p) group by t),
    tot as (select 2 * count(*)::double as t2 from p),
    pairs as (select "left", "right", "count", log2(("count" / t2) / ((a.m / t2) * (b.m / t2))) as pmi,
        case when -log2("count" / t2) > 0 then log2(("count" / t2) / ((a.m / t2) * (b.m / t2))) / -log2("count" / t2) else 1.0 end as npmi
        from c join m a on a.t = "left" join m b on b.t = "right", tot where "count" >= 3)"""


def oracle_sql() -> dict[str, str]:
    stop = "[" + ", ".join(f"'{w}'" for w in stopwords()) + "]"
    slang = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in slang_map().items()) + "}"
    tokens = lambda c: f"regexp_extract_all({c}, '{TOKEN}')"
    kept = lambda c: rf"list_filter({c}, lambda x: length(x) >= 2 and not regexp_full_match(x, '\p{{Nd}}+') and not list_contains({stop}, x))"
    slanged = lambda c: f"flatten(list_transform({c}, lambda x: string_split(coalesce(slang.m[x], x), ' ')))"
    match = f"""
        forms as (select id as keyword_id, array_to_string({tokens(_normalized("regexp_replace(term, '^#+', '')"))}, ' ') as form from keywords where status = 'ACTIVE' and term is not null),
        words as (select id as comment_id, {tokens(_normalized('text_raw'))} as tokens from comments where text_raw is not null),
        found as (select comment_id, unnest(list_distinct(flatten(list_transform(range(1, 1 + (select max(len(string_split(form, ' '))) from forms)),
            lambda k: list_transform(range(1, greatest(len(tokens) - k + 2, 1)), lambda i: array_to_string(tokens[i:i+k-1], ' ')))))) as form from words),
        matches as (select distinct comment_id, keyword_id from found join forms using (form) where form <> '')"""
    seeds = f"""
        slang as (select {slang} as m),
        seeds as (select form, arg_min(term, (iteration, type, term)) as term, arg_min(id, (iteration, type, term)) as keyword_id from (
            select id, iteration, type, term, array_to_string({kept(slanged(tokens(_normalized('term'))))}, ' ') as form from keywords, slang where status = 'ACTIVE' and term is not null) where form <> '' group by form)"""
    pool = f"""
        cand as ({CANDIDATES}), blocked as (select form as term from seeds union select term from keywords union select term from cand),
        pgrams as ({_grams([1, 2, 3])}), per as (select term, any_value(size) as size, comment_id, count(*) as tf from pgrams group by term, comment_id),
        pool as (select term, any_value(size) as size, sum(tf)::bigint as "count", count(*) as doc_freq from per group by term
            having count(*) >= 3 and length(term) >= 3 and not regexp_full_match(replace(term, ' ', ''), '\\p{{Nd}}+') and term not in (select term from blocked where term is not null))"""
    near = """
        seed_tokens as (select distinct unnest(string_split(form, ' ')) as t from seeds),
        assoc as (select token, max(pmi) as value, arg_max(seed_token, pmi) as seed_token from (
            select "left" as token, "right" as seed_token, pmi from pairs union all select "right", "left", pmi from pairs)
            where pmi > 0 and seed_token in (select t from seed_tokens) and token not in (select t from seed_tokens) group by token)"""
    weights = DEFAULTS["discovery"]["weights"]
    span = lambda c: f"case when max({c}) over () > min({c}) over () then ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) else 0 end"
    whole = rf"case when contains(x.text_clean, regexp_replace(w.term, '^#+', '')) then regexp_matches(x.text_clean, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(regexp_replace(w.term, '^#+', '')) || '($|[^\p{{L}}\p{{N}}_])') else false end"
    texts = "x as (select id, text_clean from cleaned_comments where not is_duplicate and not is_spam)"
    reason = """case when coalesce(n, '') = '' then 'empty' when length(n) > 120 then 'too_long' when type = 'HASHTAG' and instr(n, ' ') > 0 then 'space_in_hashtag'
        when type = 'HASHTAG' and length(case when n like '#%' then n else '#' || n end) < 2 then 'bare_hashtag' when type = 'PHRASE' and instr(n, ' ') = 0 then 'phrase_of_one_word'
        when type = 'KEYWORD' and instr(n, ' ') > 0 then 'space_in_keyword' when type = 'KEYWORD' and n like '#%' then 'hash_in_keyword' end"""
    kind = "case when n like '#%' then 'HASHTAG' when instr(n, ' ') > 0 then 'PHRASE' else 'KEYWORD' end"
    phone = r"(?:\+?62|0)8[\p{Nd}\s\x0b.\-]{7,13}\p{Nd}"
    counts = rf"""len(regexp_extract_all(text_raw, '(?i)(?:https?://|www\.)\S+')) as urls, len(regexp_extract_all(text_raw, '@[\p{{L}}\p{{N}}_.\-]+')) as mentions,
        len(regexp_extract_all(text_raw, '#[\p{{L}}\p{{N}}_]+')) as hashtags, regexp_matches(text_raw, '{phone}') as has_phone"""
    runs = """runs as (select id, max(n) as longest_run from (select id, count(*) as n from (select id, i, ch, i - row_number() over (partition by id, ch order by i) as g from
        (select id, unnest(string_split(text_raw, '')) as ch, generate_subscripts(string_split(text_raw, ''), 1) as i from comments where text_raw <> '')) group by id, ch, g) group by id)"""
    stored = """
        f as (select id, coalesce(lower(norm_hash), sha1(text_clean)) as h, case when simhash <> '0000000000000000' then ('0x' || simhash)::ubigint end as v from cleaned_comments),
        heads as (select h, min(id) as head from f where h is not null group by h), e as (select f.*, case when head <> id then head end as exact_of from f left join heads using (h)),
        probes as (select id, v from e where exact_of is null and v is not null), firsts as (select v, min(id) as id from probes group by v),
        k as (select id, v, b, (v >> (16 * b)::ubigint) & 65535::ubigint as key from firsts, (select unnest(range(4)) as b)),
        near as (select distinct a.id as a, a.v as va, b.id as b, b.v as vb from k a join k b on a.b = b.b and a.key = b.key and a.id < b.id where bit_count(xor(a.v, b.v)) <= 3),
        arcs as (select a, b from near union all select b, a from near), reach(node, root) as (select a, a from arcs union select b, root from reach join arcs on a = node where root < b),
        nodes as (select node, root, va as v, row_number() over (partition by root order by node) as place from (select node, min(root) as root from reach group by node) join (select a as n, va from near union select b, vb from near) on n = node),
        walk(root, place, kept) as (select root, 1::bigint, [v] from nodes where place = 1 union all
            select walk.root, walk.place + 1, case when len(list_filter(kept, lambda x: bit_count(xor(x, v)) <= 3)) > 0 then kept else list_append(kept, v) end from walk join nodes on nodes.root = walk.root and nodes.place = walk.place + 1),
        kept as (select unnest(kept) as v from (select root, arg_max(kept, place) as kept from walk group by root)),
        originals as (select firsts.* from firsts where v in (select v from kept) or id not in (select node from nodes)),
        links as (select id as other, v as ov, v from originals union all select o.id, o.v, near.vb from originals o join near on near.a = o.id union all select o.id, o.v, near.va from originals o join near on near.b = o.id),
        hits as (select probes.id, other, list_min(list_filter(range(4), lambda b: ((probes.v >> (16 * b)::ubigint) & 65535::ubigint) = ((ov >> (16 * b)::ubigint) & 65535::ubigint))) as band from probes join links using (v) where other < probes.id),
        best as (select id, arg_min(other, (band, other)) as near_of from hits group by id)"""
    # The cleaning pipeline with exact duplicates only, rule by rule.
    words = f"(select id, source_id, raw, text_clean, {tokens('text_clean')} as words from (select id, source_id, coalesce(text_raw, '') as raw, {_normalized("coalesce(text_raw, '')")} as text_clean from comments))"
    said = f"""
        slang as (select {slang} as m), w as (select id, source_id, raw, text_clean, words, {kept(slanged('words'))} as tokens from {words}, slang),
        longest as (select id, max(n) as run from (select id, count(*) as n from (select id, i, ch, i - row_number() over (partition by id, ch order by i) as g from
            (select id, unnest(string_split(raw, '')) as ch, generate_subscripts(string_split(raw, ''), 1) as i from w where raw <> '')) group by id, ch, g) group by id),
        n as (select w.*, coalesce(run, 0) as run, len(list_distinct(words)) / len(words)::double as diversity, {counts.replace('text_raw', 'raw')} from w left join longest using (id)),
        said as (select id, source_id, text_clean, tokens, sha1(text_clean) as norm_hash, array_to_string(list_filter([case when has_phone then 'phone_number' end, case when urls > 2 then 'too_many_urls (' || urls || ' > 2)' end,
            case when mentions > 5 then 'too_many_mentions (' || mentions || ' > 5)' end, case when hashtags > 5 then 'too_many_hashtags (' || hashtags || ' > 5)' end, case when run > 10 then 'char_run (' || run || ' > 10)' end,
            case when coalesce(len(tokens), 0) < 2 then 'too_few_tokens (' || coalesce(len(tokens), 0) || ' < 2)' end, case when diversity < 0.35 then printf('low_diversity (%.2f < 0.35)', diversity) end], lambda x: x is not null), '; ') as said from n)"""
    pasta = """g as (select norm_hash, count(distinct source_id) as copies from said where text_clean <> '' group by norm_hash having count(distinct source_id) >= 5), h as (select norm_hash, min(id) as head from said group by norm_hash),
        cleaned as (select id as comment_id, text_clean, coalesce(array_to_string(tokens, ' '), '') as tokens, id <> head as is_duplicate, case when id <> head then head end as duplicate_of,
            said <> '' or copies is not null as is_spam, case when said <> '' then said when copies is not null then 'copypasta (' || copies || ' >= 5)' end as spam_reason, norm_hash from said left join g using (norm_hash) join h using (norm_hash))"""
    again = """news as (select * from said where id not in (select comment_id from cleaned_comments)),
        originals as (select comment_id, lower(norm_hash) as norm_hash from cleaned_comments where not is_duplicate and norm_hash is not null), old as (select norm_hash, min(comment_id) as head from originals group by norm_hash),
        firsts as (select norm_hash, min(id) as first from news group by norm_hash),
        counted as (select norm_hash, source_id from news where text_clean <> '' union all select lower(c.norm_hash), source_id from cleaned_comments c left join comments on comments.id = comment_id where text_clean <> ''),
        g as (select norm_hash, count(distinct source_id) as copies from counted where norm_hash is not null and source_id is not null group by norm_hash having count(distinct source_id) >= 5)
        select id as comment_id, text_clean, coalesce(head, case when first <> id then first end) is not null as is_duplicate, coalesce(head, case when first <> id then first end) as duplicate_of,
            said <> '' or (copies is not null and text_clean <> '') as is_spam, case when said <> '' then said when copies is not null and text_clean <> '' then 'copypasta (' || copies || ' >= 5)' end as spam_reason
        from news left join old using (norm_hash) join firsts using (norm_hash) left join g using (norm_hash)"""
    scored = f"""docs as ({DOCS}), {_PAIRS}, {seeds}, {pool}, {near}, {_tfidf(True, True, [1, 2, 3])},
            best as (select term, max((value, seed_token)) as b from (select term, unnest(string_split(term, ' ')) as token from pool) join assoc using (token) group by term),
            labels as (select seed_token, arg_min(term, (iteration, type, term)) as seed from (select unnest(string_split(form, ' ')) as seed_token, seeds.term, iteration, type from seeds join keywords on keywords.id = keyword_id) group by seed_token),
            s as (select pool.term, "count", pool.doc_freq, size, coalesce(score, 0) as t, coalesce(b[1], 0) as a, b[2] as seed_token, "count"::double as f from pool left join scores using (term) left join best using (term))"""
    state = "case when is_spam is null then 'raw' when is_spam then 'spam' when is_duplicate then 'dup' else 'ok' end"
    last = "last as (select comment_id, arg_max(is_duplicate, id) as is_duplicate, arg_max(is_spam, id) as is_spam from cleaned_comments group by comment_id)"
    video = "nullif(regexp_extract(url, '[?&]v=([^&#]+)', 1), '')"
    stats = f"stats as (select id, {counts}, coalesce(longest_run, 0) as longest_run from comments left join runs using (id) where text_raw is not null)"
    return {
        "normalize_text": f"select id, {_normalized('text_raw')} as text_clean from comments where text_raw is not null",
        "text_stats": f"with {runs}, {stats} select * from stats",
        "tokenize_counts": f"select doc_id, len(t) as n, len(list_distinct(t)) as n_distinct, md5(array_to_string(t, ' ')) as digest from (select doc_id, {tokens('lower(text)')} as t from documents where text is not null)",
        "slang_map_tokens": f"with slang as (select {slang} as m) select id, array_to_string({slanged('list_filter(tokens, lambda x: x is not null)')}, ' ') as tokens from cleaned_comments, slang where tokens is not null",
        "token_filter": f"select id, coalesce(array_to_string({kept(tokens('lower(text_raw)'))}, ' '), '') as tokens from comments where text_raw is not null",
        "ngrams_2": f"with docs as ({DOCS}) select comment_id, i - 1 as pos, array_to_string(tokens[i:i+1], ' ') as term from (select *, unnest(range(1, len(tokens))) as i from docs)",
        "shingles_3": f"with docs as ({DOCS}) select comment_id, i - 1 as pos, array_to_string(tokens[i:i+2], ' ') as term from (select *, unnest(range(1, greatest(len(tokens) - 1, 2))) as i from docs)",
        "token_diversity": f"with docs as ({DOCS}) select comment_id, round(len(list_distinct(tokens)) / len(tokens)::double, 6) as diversity from docs",
        "keyword_validate": f"""select distinct term, type, case when type = 'HASHTAG' and n not like '#%' then '#' || n else n end as canonical, {reason} as reason from (select term, type, {NORMAL_TERM('term')} as n from (
            select term, type from keywords union all select term, 'KEYWORD' from lexicon_entries union all select title, 'PHRASE' from videos union all select title, 'HASHTAG' from videos) where term is not null)""",
        "infer_type": f"select term, n as normal, {kind} as type from (select distinct term, {NORMAL_TERM('term')} as n from (select term from keywords union all select title from videos) where term is not null)",
        "video_ids": f"select id, {video} as video_id from comments",
        "parse_video_id": "select video_id, shape, case when shape < 4 and length(b) = 11 then b end as parsed from (select video_id, unnest(range(5)) as shape, substr(regexp_replace(channel_id, '[^A-Za-z0-9_-]', '', 'g'), 1, 11) as b from videos where channel_id is not null)",
        "spam_rules": f"""with {runs}, {stats}, tk as (select id, {tokens('lower(text_raw)')} as raw from comments where text_raw is not null), t2 as (select id, raw, {kept('raw')} as tokens from tk), s as (select * from stats join t2 using (id))
            select id, 'phone_number' as code, 1.0::double as actual, 0.0::double as threshold from s where has_phone
            union all select id, 'too_many_urls', urls, 2 from s where urls > 2 union all select id, 'too_many_mentions', mentions, 5 from s where mentions > 5
            union all select id, 'too_many_hashtags', hashtags, 5 from s where hashtags > 5 union all select id, 'char_run', longest_run, 10 from s where longest_run > 10
            union all select id, 'too_few_tokens', coalesce(len(tokens), 0), 2 from s where coalesce(len(tokens), 0) < 2
            union all select id, 'low_diversity', round(len(list_distinct(raw)) / len(raw)::double, 6), 0.35 from s where len(raw) > 0 and len(list_distinct(raw)) / len(raw)::double < 0.35""",
        "spam_by_rule": "select code, count(*) as n from (select string_split(unnest(string_split(spam_reason, '; ')), ' ')[1] as code from cleaned_comments where spam_reason is not null) where code <> 'copypasta' group by code",
        "exact_duplicates": f"with r as (select id, trim(regexp_replace(lower(text_raw), '{SPACE}+', ' ', 'g')) as t from comments where text_raw is not null), f as (select t, min(id) as first from r group by t) select id, first as duplicate_of from r join f using (t) where id <> first",
        "copypasta": "select lower(norm_hash) as norm_hash, count(distinct source_id) as copies from cleaned_comments c join comments on comments.id = comment_id where norm_hash is not null and text_clean <> '' group by 1 having count(distinct source_id) >= 2",
        "near_pairs": """with v as (select min(id) as id, ('0x' || simhash)::ubigint as v from cleaned_comments where simhash is not null and simhash <> '0000000000000000' group by 2),
            k as (select id, v, b, (v >> (16 * b)::ubigint) & 65535::ubigint as key from v, (select unnest(range(4)) as b))
            select a.id as a, b.id as b, any_value(bit_count(xor(a.v, b.v)))::bigint as bits, min(a.b) as band from k a join k b on a.b = b.b and a.key = b.key and a.id < b.id where bit_count(xor(a.v, b.v)) <= 3 group by all""",
        "near_pair_members": """with v as (select id, ('0x' || simhash)::ubigint as v from cleaned_comments where simhash is not null and simhash <> '0000000000000000')
            select id, representative, 0::bigint as bits from v join (select v, min(id) as representative from v group by v) using (v)""",
        "stored_duplicates": f"with recursive {stored} select id, coalesce(exact_of, near_of) as duplicate_of, case when exact_of is not null then 'exact' else 'near' end as duplicate_kind from e left join best using (id) where coalesce(exact_of, near_of) is not null",
        "clean_exact": f"with {said}, {pasta} select * from cleaned",
        "cleaning_stats_exact": f"""with {said}, {pasta} select count(*) as processed, count(*) filter (is_duplicate) as duplicates, count(*) filter (is_spam and not coalesce(spam_reason like 'copypasta%', false)) as spam,
            count(*) filter (coalesce(spam_reason like 'copypasta%', false)) as copypasta, count(*) filter (not is_duplicate and not is_spam) as usable from cleaned""",
        "incremental_exact": f"with {said}, {again}",
        "analysis_results": f"""with docs as ({DOCS}), {_PAIRS}, one as (select distinct unnest(tokens) as term from docs), g as ({_grams([1, 2, 3])}), often as (select term, any_value(size) as size from g group by term having count(*) >= 3)
            select 'frequency' as method, least(100, count(*)) as n from one union all select 'ngram', sum(n)::bigint from (select least(100, count(*)) as n from often group by size)
            union all select 'tfidf', least(100, count(distinct term)) from g union all select 'cooccurrence', least(100, count(*)) from pairs""",
        "discover": f"""with {scored},
            parts as (select *, {weights['frequency']} * ({span('f')}) as wf, {weights['tfidf']} * ({span('t')}) as wt, {weights['cooccurrence']} * ({span('a')}) as wa, case when size > 1 then {weights['ngram']} else 0 end as wn from s),
            summed as (select parts.*, wf + wt + wa + wn as score, greatest(wf, wt, wa, wn) as most, seed, case when size > 1 then 'PHRASE' else 'KEYWORD' end as type, term as n from parts left join labels using (seed_token)),
            checked as (select *, {reason} as reason from summed)
            select term, type, case most when wf then 'FREQUENCY' when wt then 'TFIDF' when wa then 'COOCCURRENCE' else 'NGRAM' end as source_method, doc_freq as frequency, round(score, 4) as score,
                'docs=' || doc_freq || '; count=' || "count" || printf('; tfidf=%.2f', t) || case when seed is not null then printf('; near seed ''%s'' (pmi %.2f)', seed, a) else '' end as discovered_from,
                0 as iteration, 'PENDING' as status, null::varchar as reviewed_at, '2026-01-01T00:00:00Z' as created_at
            from checked where score > 0 and reason is null order by checked.score desc, "count" desc, term limit 50""",
        "corpus_totals": f"with docs as ({DOCS}) select count(*) as documents, sum(len(tokens))::bigint as tokens from docs",
        "usable_corpus": f"with docs as ({DOCS}) select comment_id, len(tokens) as n_tokens from docs",
        "term_frequency": f"with docs as ({DOCS}), t as (select comment_id, unnest(tokens) as term from docs) select term, count(*) as \"count\", count(distinct comment_id) as doc_freq, round(count(*) / (select count(*) from t)::double, 6) as relative from t group by term",
        "ngram_counts": f"with docs as ({DOCS}), g as ({_grams([1, 2, 3])}) select term, any_value(size) as size, count(*) as \"count\", count(distinct comment_id) as doc_freq from g group by term having count(*) >= 3",
        "ngram_top_per_size": f"with docs as ({DOCS}), g as ({_grams([1, 2, 3])}) select term, any_value(size) as size, count(*) as \"count\", count(distinct comment_id) as doc_freq from g group by term having count(*) >= 3 qualify row_number() over (partition by any_value(size) order by count(*) desc, term) <= 100",
        **{
            name: f"with docs as ({DOCS}), {_tfidf(sub, smooth)} select term, round(score, 6) as score, doc_freq, round(max_weight, 6) as max_weight from scores"
            for name, sub, smooth in (("tfidf_scores", True, True), ("tfidf_plain_idf", True, False), ("tfidf_linear_tf", False, True), ("tfidf_plain", False, False))
        },
        "cooccurrence_pmi": f'with docs as ({DOCS}), {_PAIRS} select "left", "right", "count", round(pmi, 6) as pmi, round(npmi, 6) as npmi from pairs',
        "cooccurrence_npmi_top": f'with docs as ({DOCS}), {_PAIRS} select "left", "right", "count", round(pmi, 6) as pmi, round(npmi, 6) as npmi from pairs order by "count" desc, "left", "right" limit 100',
        "cooccurrence_raw_top": f"""with docs as ({DOCS}), {_PAIRS} select "left", "right", "count", round(pmi, 6) as pmi, round(npmi, 6) as npmi from pairs order by "count" desc, "left" || ' ~ ' || "right" limit 100""",
        "seed_forms": f"with {seeds} select * from seeds",
        "candidate_pool": f"with docs as ({DOCS}), {seeds}, {pool} select * from pool",
        "seed_association": f"with docs as ({DOCS}), {_PAIRS}, {seeds}, {near} select token, round(value, 6) as value from assoc",
        "candidate_scores": f"""with docs as ({DOCS}), {_PAIRS}, {seeds}, {pool}, {near}, {_tfidf(True, True, [1, 2, 3])},
            best as (select term, max(value) as value from (select term, unnest(string_split(term, ' ')) as token from pool) join assoc using (token) group by term),
            s as (select pool.term, "count", pool.doc_freq, size, coalesce(score, 0) as t, coalesce(value, 0) as a, "count"::double as f from pool left join scores using (term) left join best using (term))
            select term, "count", doc_freq, round(t, 6) as raw_tfidf, round(a, 6) as raw_cooccurrence,
            round({weights['frequency']} * ({span('f')}) + {weights['tfidf']} * ({span('t')}) + {weights['cooccurrence']} * ({span('a')}) + case when size > 1 then {weights['ngram']} else 0 end, 6) as score from s""",
        "keyword_match": f"with {match} select * from matches",
        "most_matched_keywords": f"with {match} select term, count(*) as n from matches join keywords on keywords.id = keyword_id group by keyword_id, term order by n desc, term limit 20",
        "matched_terms_agg": f"with {match} select comment_id, string_agg(term, ', ' order by term) as terms from matches join keywords on keywords.id = keyword_id group by comment_id",
        "lexicon_doc_frequency": f"with {texts}, w as (select distinct term from lexicon_entries where term is not null) select w.term, count(x.id) as doc_freq from w left join x on {whole} group by w.term",
        "lexicon_propose": f"""with {texts}, cand as ({CANDIDATES}), e as (select entry_key, n, url, {kind} as type, {reason.replace('type', '(' + kind + ')')} as reason from (select *, {NORMAL_TERM('term')} as n from lexicon_entries where not excluded and term is not null)),
            o as (select entry_key, n as term, type, url, case when reason is not null then 'invalid' when n in (select term from keywords) then 'already_keyword'
                when n in (select term from cand) or entry_key <> min(case when reason is null then entry_key end) over (partition by n) then 'already_candidate' else 'created' end as outcome from e),
            w as (select distinct term from o where outcome = 'created'), f as (select w.term, count(x.id) as frequency from w left join x on {whole} group by w.term)
            select entry_key, term, type, frequency, url, outcome from o left join f using (term)""",
        "lexicon_excluded_stub": """select source, case when x and not starts_with(entry_key, 'sha1:') then 'sha1:' || sha1(entry_key) else entry_key end as entry_key, case when not x then url end as url, case when not x then term end as term, category,
            case when not x then definition end as definition, case when not x then example end as example, x as excluded, fetched_at from (select *, coalesce(lower(trim(category)) = 'gaul', false) or coalesce(excluded, false) as x from lexicon_entries)""",
        "lexicon_freshness": """with l as (select source, entry_key, url from lexicon_entries union all select 'kamus', lower(video_id), null from videos), f as (select source, entry_key from lexicon_entries where fetched_at >= '2024-04-01T00:00:00Z')
            select source, entry_key, url from l where (source, entry_key) not in (select source, entry_key from f) and (source, 'sha1:' || sha1(entry_key)) not in (select source, entry_key from f)""",
        "category_histogram": "select coalesce(category, '-') as category, count(*) as n from lexicon_entries where not excluded group by 1",
        "lexicon_by_category": "select entry_key, term, category from lexicon_entries where not excluded and lower(category) = 'gaul'",
        "entry_extract": "select entry_key, term, category, definition, example from lexicon_entries where not excluded and term is not null",
        "review_queue": f"select id, term, frequency, score from ({CANDIDATES}) where status = 'PENDING'",
        "latest_pending": f"select term, id, iteration from ({CANDIDATES}) where status = 'PENDING' qualify row_number() over (partition by term order by iteration desc, id desc) = 1",
        "promote_approved": f"""with c as ({CANDIDATES}), a as (select *, term as n, row_number() over (order by score desc, frequency desc, id) as place from c where status = 'APPROVED')
            select a.id, a.term, a.type, a.source_method || ' kandidat#' || a.id || case when coalesce(a.discovered_from, '') <> '' then ' ' || a.discovered_from else '' end as provenance,
            k.term is null and row_number() over (partition by a.term, a.type order by place) = 1 as promoted from a left join keywords k on k.term = a.term and k.type = a.type""",
        "keyword_list": "select id, term, type, iteration from keywords where status = 'ACTIVE'",
        "keyword_counts": "select status, type, count(*) as n from keywords group by all",
        "comments_browse": f"with {last} select * from (select id, source, {state} as state, text_raw, url, created_at from comments left join last on comment_id = id) where source = 'youtube' and state = 'ok' and text_raw ilike '%banget%'",
        "comment_state": f"with {last} select source, {state} as state, count(*) as n from comments left join last on comment_id = id group by all",
        "videos_listed": f"with s as (select {video} as video_id, count(*) as stored from comments group by 1) select video_id, keyword, title, comments_fetched, coalesce(stored, 0) as stored, discovered_at from videos left join s using (video_id)",
        "status_counters": f"""with {match}, cand as ({CANDIDATES})
            select 'keywords' as metric, count(*) filter (status = 'ACTIVE') as value from keywords union all select 'keywords_total', count(*) from keywords union all select 'comments', count(*) from comments
            union all select 'cleaned', count(*) from cleaned_comments union all select 'duplicates', count(*) filter (is_duplicate) from cleaned_comments union all select 'spam', count(*) filter (is_spam) from cleaned_comments
            union all select 'usable', count(*) filter (not is_duplicate and not is_spam) from cleaned_comments union all select 'candidates_pending', count(*) filter (status = 'PENDING') from cand
            union all select 'candidates_approved', count(*) filter (status = 'APPROVED') from cand union all select 'candidates_rejected', count(*) filter (status = 'REJECTED') from cand
            union all select 'runs', count(*) from collection_runs union all select 'videos_cached', count(*) from videos union all select 'keyword_matched', count(distinct comment_id) from matches
            union all select 'lexicon_entries', count(*) filter (not excluded) from lexicon_entries
            union all select 'iteration', greatest((select max(iteration) from keywords), (select max(iteration) from cand), (select max(iteration) from collection_runs))""",
        "rolling_search_calls": "select coalesce(sum(try_cast(json_extract(case when json_valid(params) then params end, '$.search_calls') as bigint)), 0)::bigint as search_calls from collection_runs where started_at >= '2024-04-01T00:00:00Z'",
        "example_comments": rf"""with x as (select comment_id, ' ' || text_clean || ' ' as t from cleaned_comments where not is_duplicate and not is_spam), w as (select distinct term from keywords where status = 'ACTIVE'),
            f as (select distinct term, comment_id from w join x on contains(t, ' ' || term || ' ')), r as (select term, comment_id, text_raw, row_number() over (partition by term order by length(text_raw), comment_id) as n from f join comments on id = comment_id)
            select term, comment_id, substr(trim(regexp_replace(text_raw, '{SPACE}+', ' ', 'g')), 1, 160) as example from r where n <= 2""",
        "alias_pick": "select coalesce(nullif(author_id, ''), nullif(text_raw, '')) as text, coalesce(nullif(source_id, ''), id::varchar) as source_id, nullif(created_at, '') as created_at, nullif(url, '') as url, null::varchar as source, null::varchar as keyword from comments",
        "idempotent_append": "with s as (select source, source_id from comments where coalesce(run_id, 0) <= (select max(id) // 2 from collection_runs)) select distinct source, source_id from comments where (source, source_id) not in (select source, source_id from s)",
        "flatten_pages": "select source_id, text, count(*) as n from (select source_id, text_raw as text from comments union all select source_id || '.r', text_raw from comments) where source_id is not null and length(trim(text)) > 0 group by all",
    }

"""DuckDB SQL for the queries that SQL can express over whole tables."""

ORACLE_SQL = {
    "op2_quality_rules": r"""
        with words as (
            select doc_id, source, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
        windows as (
            select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from words, unnest(range(1, len(ws) - 1)) as t(i)),
        counted as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from windows),
        covered as (
            select doc_id, count(distinct i + k) as n_repeat_words from counted, (values (0), (1), (2)) as v(k) where n > 1 group by doc_id),
        lines as (
            select doc_id, source, raw, length(raw) as chars, regexp_matches(raw, '[^\x20\x09-\x0D]') as has_word,
                   trim(regexp_replace(regexp_replace(lower(raw), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as plain
            from (select doc_id, source, unnest(string_split(text, chr(10))) as raw from documents where text is not null)),
        repeated as (select doc_id, count(*) - count(distinct raw) as n_dup_lines from lines where has_word group by doc_id),
        frequent as (select source, plain from lines where plain <> '' group by source, plain having count(distinct doc_id) > 3),
        removed as (
            select doc_id, count(*) as n, sum(chars) as chars from lines l
            where exists (select 1 from frequent f where f.source is not distinct from l.source and f.plain = l.plain) group by doc_id),
        stats as (
            select doc_id, len(ws) as n_words, coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0) as word_chars,
                   coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) as n_symbols,
                   coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
                   coalesce(removed.n, 0) as n_frequent_lines, cast(coalesce(removed.chars, 0) as bigint) as n_frequent_chars, coalesce(length(text), 0) as n_chars
            from words left join repeated using (doc_id) left join covered using (doc_id) left join removed using (doc_id)),
        failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from stats)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_lines, n_frequent_chars, base_failed,
               not base_failed and not n_chars - n_frequent_chars < 0.5 * n_chars as kept
        from failed
    """,
    "op6_url_filter": r"""
        with cut as (
            select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages),
        parts as (
            select page_id,
                   coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
            from cut),
        rules(rule_host, rule_path, rule_verdict) as (
            values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        best as (
            select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
                   arg_max(rule_verdict, length(rule_host || rule_path)) as rule_verdict
            from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
            group by page_id)
        select p.page_id, p.host, p.path, b.rule, coalesce(b.rule_verdict, 'allow') as verdict
        from parts p left join best b using (page_id)
    """,
    # up to RERANK rows the index answers exactly, so on the small tables exact search gives the same rows
    "op7_permutation_index": r"""
        with taken as (
            select vec_id, cast(embedding as double[]) as v from embeddings
            where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
              and len([x for x in embedding if x <> 0]) > 0),
        near as (
            select q.vec_id as query_id, r.vec_id, list_distance(q.v, r.v) as score
            from taken q join taken r on q.vec_id <> r.vec_id and len(q.v) = len(r.v) where q.vec_id % 100 = 0)
        select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank, vec_id, score
        from near qualify rank <= 10
    """,
    "op13_warc": r"""
        with taken as (
            select page_id, coalesce(encode(html), ''::blob) as payload from pages),
        digested as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from taken),
        firsts as (select *, min(page_id) over (partition by payload_digest) as first from digested)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and (page_id is null or page_id <> first) and first is not null then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and (page_id is null or page_id <> first) then first end as refers_to
        from firsts
    """,
}

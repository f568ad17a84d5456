"""SQL twins of the corpus queries that SQL can express."""

from tidemark.llm.url_reputation import SUFFIXES

_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)
_HOST = "translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _level(name: str, units: str, keys: str) -> str:
    """Two tables: the level's prior strength, and the posterior of its units (keys, n, bad, prior)."""
    v = "prior * (1 - prior)"
    rho = f"coalesce((sum(n * (bad / n - prior) ** 2) filter (n > 0) - sum({v}) filter (n > 0)) / nullif(sum({v} * (n - 1)) filter (n > 0), 0), 0)"
    return f"""{name}_s as (select 1 / least(greatest({rho}, 1 / 1001.0::double), 0.5::double) - 1 as s from {units}),
        {name}_post as (select {keys}, n, bad, s, (bad + s * prior) / (n + s) as mean from {units}, {name}_s)"""


OP4_WARC = """with p as (select page_id, url, coalesce(html, '') as html from pages),
    q as (select page_id, url, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
    g as (select payload_digest, payload_bytes, max(page_id) as kept from q where payload_bytes >= 1000 group by all having count(*) > 1)
    select q.page_id, q.payload_bytes, q.payload_digest, case when kept is not null and page_id is distinct from kept then 'revisit' else 'response' end as record_type,
    case when kept is not null and page_id is distinct from kept then kept end as refers_to, q.url from q left join g using (payload_digest, payload_bytes)"""

OP7_BACKOFF_SCORES = r"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as l from documents),
    t as (select r, unnest(generate_series(1, len(l))) as i, unnest(l) as w from d where len(l) > 0),
    g as (select r, i, w as g1, lag(w, 1) over o || ' ' || w as g2, lag(w, 2) over o || ' ' || lag(w, 1) over o || ' ' || w as g3 from t window o as (partition by r order by i)),
    c1 as (select g1, count(*) as n1 from g group by 1), c2 as (select g2, count(*) as n2 from g where g2 is not null group by 1), c3 as (select g3, count(*) as n3 from g where g3 is not null group by 1),
    n as (select r, i, n1, n2, n3 from g join c1 using (g1) left join c2 using (g2) left join c3 using (g3)),
    x as (select *, lag(n1) over o as before1, lag(n2) over o as before2, (select count(*) from t) as words from n window o as (partition by r order by i)),
    s as (select r, sum(case when n3 >= 2 then ln(n3 / before2) when n2 >= 2 then ln(n2 / before1) + (i >= 3)::int * ln(0.4::double) else ln(n1 / words) + ((i >= 2)::int + (i >= 3)::int) * ln(0.4::double) end) as score from x group by 1)
    select doc_id, len(l)::bigint as n_words, round(coalesce(score, 0), 5) as log_score, round(score / len(l), 7) as mean_log from d left join s using (r)"""

OP9_URL_FILTER = f"""with parsed as (select page_id, {_HOST} as host, {_PATH} as path from pages),
    known as (select doc_id as page_id, coalesce(max((toxic = 1 or quality = 0)::int), 0) as bad from labels where doc_id is not null group by 1),
    labels_of as (select page_id, host, string_split(host, '.') as l, array_to_string(string_split(host, '.')[-2:], '.') as two from parsed),
    h as (select host, case when two in ({_SUFFIXES}) then array_to_string(l[-3:], '.') else two end as domain, case when two in ({_SUFFIXES}) then two else l[-1] end as suffix,
        count(bad)::double as n, coalesce(sum(bad), 0)::double as bad from labels_of left join known using (page_id) group by 1, 2, 3),
    root as (select (coalesce(sum(bad), 0) + 0.1::double) / (coalesce(sum(n), 0) + 1) as prior from h),
    suf as (select suffix, sum(n) as n, sum(bad) as bad, any_value(prior) as prior from h, root group by 1), {_level("suf", "suf", "suffix")},
    dom as (select domain, sum(h.n) as n, sum(h.bad) as bad, any_value(mean) as prior from h join suf_post using (suffix) group by 1, suffix), {_level("dom", "dom", "domain")},
    hos as (select host, h.n, h.bad, mean as prior from h join dom_post using (domain)), {_level("hos", "hos", "host")},
    low as (select host, round(greatest(0, mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1))), 9) as lower from hos_post),
    fit as (select *, case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
        when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
        when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/' when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from parsed)
    select page_id, host, path, rule, case rule when 'net/' then 'block' when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow'
        else case when lower > 0.25 then 'block' else 'allow' end end as verdict from fit left join low using (host)"""


def op11_vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Codebooks in so many rounds, every part compared with every entry."""

    def assigned(k: int) -> str:
        distance = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""a{k} as (select r, vec_id, label, part, x, min((d, entry)) as best from (select p.*, c.entry, cast({distance} as bigint) as d from p join c{k} c using (part)) group by all)"""

    steps = []
    for k in range(rounds):
        steps.append(assigned(k))
        steps.append(f"""m{k + 1} as (select part, entry, list(cast(floor(total / n) as bigint) order by i) as x from (select part, best[2] as entry, i, sum(x[i]) as total, count(*) as n
            from (select *, unnest(generate_series(1, len(x))) as i from a{k}) group by 1, 2, 3) group by 1, 2)""")
        steps.append(f"c{k + 1} as (select part, entry, coalesce(m.x, c.x) as x from c{k} c left join m{k + 1} m using (part, entry))")
    return f"""with v as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as e from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as (select r, vec_id, label, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] as x from (select *, unnest(generate_series(0, {parts - 1})) as part from v)),
    c0 as (select part, row_number() over (partition by part order by vec_id nulls last, r) - 1 as entry, x from p qualify entry < {entries}),
    {", ".join(steps)}, {assigned(rounds)},
    coded as (select r, vec_id, label, string_agg(format('{{:02x}}', best[2]), '' order by part) as code, cast(sum(best[1]) as bigint) as error from a{rounds} group by 1, 2, 3),
    books as (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, i)) as h from (select part, entry, unnest(x) as x, unnest(generate_series(1, len(x))) as i from c{rounds}))
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from coded, books"""


def op12_chat_format(added: list[tuple]) -> str:
    """What the turns say, and how long they are with marks and escapes."""
    rows = ", ".join(f"({c}, {t}, '{r}', '{s}')" for c, t, r, s in added)
    mark = r"[<\[]\\*(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|role>|says>|/role>)"
    marks = f"len(regexp_extract_all(text, '{mark}')) + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 19 + length(role) + len(regexp_extract_all(role, '{mark}')) end"
    return f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all values {rows}))
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(text) + {marks}) as bigint) as formatted_chars from t group by 1"""


OP13_FILTER_AUDIT = r"""with l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
    d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    e as (select *, min(doc_id) over (partition by text) < doc_id as copied from d),
    b as (select part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::int
        + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(copied, false)::int as bits, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from e left join l using (doc_id)),
    k as (select part, bits, count(*) as n, sum(good) as good, sum(toxic) as toxic from b group by 1, 2),
    f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit)),
    o as (select p.letter || q.letter || r.letter || s.letter || t.letter as filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] as bits_of from f p, f q, f r, f s, f t where p.bit | q.bit | r.bit | s.bit | t.bit = 31),
    st as (select filter_order, step, bits_of[step] as bit, coalesce(list_sum(bits_of[1:step - 1]), 0)::int as earlier from (select *, unnest([1, 2, 3, 4, 5]) as step from o))
    select part, filter_order, step, coalesce(sum(n) filter (bits & (bit | earlier) = 0), 0)::bigint as kept, coalesce(sum(n) filter (bits & bit <> 0 and bits & earlier = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (bits & bit <> 0 and bits & earlier <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (bits = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (bits & bit <> 0 and bits & earlier = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (bits & bit <> 0 and bits & earlier = 0), 0)::bigint as toxic_lost,
    coalesce(sum(n * 120 // nullif(bit_count(bits), 0)) filter (bits & bit <> 0), 0)::bigint as shapley from k, st group by part, filter_order, step"""

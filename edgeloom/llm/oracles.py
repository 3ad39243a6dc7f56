"""The same results in DuckDB's SQL, for queries that SQL can express."""

from __future__ import annotations

from edgeloom.llm import chat, decontaminate, url_filter

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str) -> str:
    lowered = f"translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}')"
    return f"select {key}, [x for x in regexp_split_to_array({lowered}, '{_SEPARATORS}') if x <> ''] w from {table}"


def contamination() -> str:
    n = decontaminate.WINDOW
    return f"""
with d as materialized ({_words("(select *, row_number() over () r from documents)", "r, doc_id")}),
 i as ({_words("benchmark", "coalesce(item_id::varchar, '') item")}),
 iw as (select distinct item, least({n}, len(w)) n, array_to_string(w[s + 1 : s + {n}], ' ') g
   from (select item, w, unnest(range(greatest(len(w) - {n - 1}, 1))) s from i where len(w) > 0)),
 k as (select distinct n from iw),
 dw as (select r, p, n, array_to_string(w[p + 1 : p + n], ' ') g from (select r, w, n, unnest(range(greatest(len(w) - n + 1, 0))) p from d cross join k)),
 h as (select r, p, dw.n, item from dw join iw on dw.g = iw.g and dw.n = iw.n),
 hit as (select r, count(distinct q) n_hit from (select r, unnest(range(p, p + n)) q from h) group by 1),
 items as (select r, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct r, item from h) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
 n_hit is not null contaminated from d left join hit using (r) left join items using (r)"""


def chats() -> str:
    controls = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROLS)
    frame = " ".join(f"when '{role}' then {len(a + b)}" for role, (a, b) in chat.MARKS.items())

    def escaped(text: str) -> str:
        return rf"2 * length({text}) - length(replace({text}, '\', '')) + 2 * len(regexp_extract_all({text}, '{controls}'))"

    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations
   union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
 sum({escaped("text")} + case role {frame} else {sum(map(len, chat.OTHER))} + {escaped("role")} end)::bigint formatted_chars
from t group by 1"""


def records() -> str:
    digit = "(strpos('0123456789abcdef', substr(hex, {0} + 1, 1)) - 1)"
    five = f"(({digit.format('5 * i // 4')} * 16 + {digit.format('least(5 * i // 4 + 1, 39)')}) >> (3 - 5 * i % 4)::int) & 31"
    base32 = f"array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({five})::int + 1, 1) for i in range(32)], '')"
    return f"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) hex from pages),
 k as (select hex, max(page_id) keeper from p group by 1)
select page_id, strlen(html)::bigint payload_bytes, {base32} payload_digest, case when page_id = keeper then 'response' else 'revisit' end record_type,
 case when page_id <> keeper then keeper end refers_to from p join k using (hex)"""


def _whole_vectors(scale: int, where: str = "true") -> str:
    """K(r, vec_id, label, v): usable vectors as whole numbers."""
    usable = "embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0"
    return f"""K as materialized (select row_number() over () r, vec_id, label, [floor({scale} * x::double)::bigint for x in embedding] v
 from embeddings where {usable} and {where})"""


_FLOORED = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint"


def vector_codes() -> str:
    def assigned(t: int) -> str:
        return f"""D{t} as (select r, p, e, sum((x - c) * (x - c))::bigint d from X join C{t} using (p, i) group by all),
 A{t} as materialized (select r, p, min(d * 64 + e) // 64 d, (min(d * 64 + e) % 64) e from D{t} group by all)"""

    def moved(t: int) -> str:
        return f"""M{t} as (select p, e, i, {_FLOORED} c from A{t} join X using (r, p) group by all),
 C{t + 1} as materialized (select p, e, i, coalesce(M{t}.c, C{t}.c) c from C{t} left join M{t} using (p, e, i))"""

    return f"""
with {_whole_vectors(256)},
 X as materialized (select r, (j - 1) * 16 // n p, (j - 1) % (n // 16) i, x from (select r, len(v) n, unnest(v) x, generate_subscripts(v, 1) j from K)),
 S as (select r, row_number() over (order by vec_id) - 1 e from K order by vec_id limit 64),
 C0 as materialized (select p, e, i, x c from X join S using (r)),
 {assigned(0)}, {moved(0)}, {assigned(1)}, {moved(1)}, {assigned(2)},
 R as (select r, string_agg(printf('%02x', e::int), '' order by p) code, sum(d)::bigint error from A2 group by 1),
 H as (select sha256(string_agg(c::varchar, ',' order by p, e, i)) codebooks_sha256 from C2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from K join R using (r), H"""


def centroids() -> str:
    def assigned(t: int) -> str:
        return f"""D{t} as (select r, k, sum((x - c) * (x - c))::bigint d from X join C{t} using (i) group by all),
 A{t} as materialized (select r, min(d * 16 + k) // 16 d, (min(d * 16 + k) % 16) k from D{t} group by all)"""

    def moved(t: int) -> str:
        return f"""M{t} as (select k, i, {_FLOORED} c from A{t} join X using (r) group by all),
 C{t + 1} as materialized (select k, i, coalesce(M{t}.c, C{t}.c) c from C{t} left join M{t} using (k, i))"""

    return f"""
with {_whole_vectors(64, "len(embedding) = 64")},
 X as materialized (select r, unnest(v) x, generate_subscripts(v, 1) i from K),
 S as (select r, row_number() over (order by sha256('1:' || vec_id)) - 1 k from K order by 2 limit 16),
 C0 as materialized (select k, i, x c from X join S using (r)),
 {assigned(0)}, {moved(0)}, {assigned(1)}, {moved(1)}, {assigned(2)}, {moved(2)}, {assigned(3)},
 H as (select k, sha256(string_agg(c::varchar, ',' order by i)) centroid_sha256 from C3 group by 1)
select vec_id, A3.k::int as cluster, A3.d::bigint distance, (sum(d) over (partition by A3.k))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, centroid_sha256
from K join A3 using (r) join H using (k)"""


def near_vectors() -> str:
    usable = "label is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0"
    return f"""
with recursive T as materialized (select row_number() over () r, vec_id, label, embedding::double[] e, coalesce({usable}, false) usable from embeddings),
 L as materialized (select a.r u, b.r v from T a join T b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r
  where a.usable and b.usable and list_cosine_similarity(a.e, b.e) >= 0.93),
 G as (select r, vec_id m from T union select v, m from G join L on r = u),
 C as (select r, min(m) component_id from G group by 1),
 N as (select u r, count(*) n_links from L group by 1)
select vec_id, coalesce(n_links, 0)::bigint n_links, component_id, vec_id = component_id kept from T join C using (r) left join N using (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op13_embedding_dedup": near_vectors(), "op11_vector_codes": vector_codes(), "op12_centroids": centroids(), "op2_url_filter": url_filter.oracle_sql(), "op3_decontaminate": contamination(), "op8_chat_format": chats(), "op9_warc": records()}

"""DuckDB spelling of the stand-in views, prepended to oracle SQL as CTEs.

Must stay equivalent to ``tagweave.sources.views.Views``."""

from __future__ import annotations

# md5 -> first 8 hex digits -> unsigned 32-bit integer, DuckDB form.
def h32(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def h01(seed, bag, id_expr: str) -> str:
    key = f"concat('{seed}', ':', '{bag}', ':', {id_expr}::VARCHAR)"
    return f"({h32(key)} / 4294967296.0)"


def murmur3_sql(expr: str) -> str:
    """MurmurHash3 (x86, 32 bits, seed 0) of a string, signed, as list arithmetic:
    every value is bound as the one element of a list."""
    times = lambda x, c: f"(({x}::UBIGINT * {c}::UBIGINT) % 4294967296::UBIGINT)"
    rot = lambda x, b: f"(({x} * {1 << b}) % 4294967296 + {x} // {1 << (32 - b)})"
    fold = lambda x, b: f"xor({x}, {x} // {1 << b})"
    on = lambda xs, body: f"list_transform({xs}, lambda x: {body})"
    number = "('0x0' || {})::UBIGINT"
    part = lambda start, n: " || ".join(f"substr(hex(s), {start} + {2 * i}, 2)" for i in reversed(range(n)))
    size = "octet_length(encode(s))"
    words = on(f"generate_series(0, {size} // 4 - 1)", number.format("(" + part("x * 8 + 1", 4) + ")"))
    tail = "[" + number.format("(" + part(f"({size} // 4) * 8 + 1", 3) + ")") + "]"
    mixed = lambda xs: on(on(on(xs, times("x", 0xCC9E2D51)), rot("x", 15)), times("x", 0x1B873593))
    body = f"list_reduce(list_concat([0::UBIGINT], {mixed(words)}), lambda h, k: ({rot('xor(h, k)', 13)} * 5 + {0xE6546B64}) % 4294967296)"
    out = f"[xor(xor({body}, {mixed(tail)}[1]), {size}::UBIGINT)]"
    for bits, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        out = on(on(out, fold("x", bits)), times("x", c))
    out = on(on(out, fold("x", 16)), "CASE WHEN x > 2147483647 THEN x::BIGINT - 4294967296 ELSE x::BIGINT END")
    return f"list_transform([{expr}], lambda s: {out}[1])[1]"


def md5_order(seed, bag, id_expr: str) -> str:
    return f"md5(concat('{seed}', ':', '{bag}', ':', {id_expr}::VARCHAR))"


WORDS = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def fingerprint_sql(text: str) -> str:
    # The words are bound once, by a one-element list, and used from there.
    words = WORDS.format(t=text)
    shingles = ("list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))")
    bottom = f"list_slice(list_sort(list_distinct(list_transform({shingles}, lambda s: {h32('s')}))), 1, 328)"
    return (f"list_transform([{words}], lambda w: list_sort(list_distinct(list_transform({bottom}, "
            f"lambda h: (h % 16384)::INTEGER))))[1]")


VIEWS = {
    "v_data": "select doc_id as id, cast(substr(source, 4) as int) as source_id from documents",
    "v_source": "select distinct cast(substr(source, 4) as int) as id from documents",
    "v_text": "select doc_id + 1000000 as id, doc_id as data_id, text from documents",
    "v_language": "select doc_id as data_id, lang as language from documents",
    "v_time": "select d.doc_id as data_id, e.ts as time from documents d join events e on e.event_id = d.doc_id",
    "v_tagging": ("select doc_id as data_id, 10 + quality as tag_id from labels "
                  "union all select doc_id, 20 + toxic from labels"),
    "v_tag_tagset": "select * from (values (10, 1), (11, 1), (20, 2), (21, 2)) t(tag_id, tagset_id)",
    "v_translation": ("select d.doc_id + 1000000 as text_id, 'en' as target_language, b.text as translation "
                      "from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark) "
                      "where d.lang = 'de' and d.doc_id % 2 = 0"),
    "v_fingerprint": f"select doc_id as data_id, {fingerprint_sql('text')} as fingerprint from documents",
    "v_reactions": ("select user_id as post_id, case event_type when 'view' then 'LIKE' when 'click' then 'LOVE' "
                    "when 'error' then 'ANGRY' when 'signup' then 'HAHA' else 'WOW' end as type, "
                    "concat('page', cast(user_id % 2 as varchar)) as page from events"),
    "v_comments": ("select doc_id % 150 as post_id, concat('page', cast((doc_id % 150) % 2 as varchar)) as page, "
                   "json_object('message', text) as comment from documents"),
    "v_abstracts": "select concat('a', cast(doc_id as varchar)) as article, text as abstract from documents",
    "v_categories": ("select concat('a', cast(doc_id as varchar)) as article, lang as category from documents "
                     "union all select concat('a', cast(doc_id as varchar)), source from documents"),
    "v_retina_pos": ("select vec_id, concat('label', label) as slug, "
                     "((i - 1) * 256 + cast(floor((cast(embedding[i] as double) + 1.0) * 128) as int))::int as pos "
                     "from embeddings, unnest(generate_series(1, len(embedding))) g(i)"),
    "v_legacy_comments": ("select doc_id as id, json_object('message', text) as data, "
                          "json_object('fingerprint', case when doc_id % 5 <> 0 then [CAST(doc_id % 16384 AS INTEGER)] end, "
                          "'lang', lang, 'page', 'page' || (doc_id % 2)::VARCHAR) as meta from documents"),
    "v_user_tag_comment": ("select 1 as user_id, case when quality = 1 then 'good' else 'bad' end as tag, "
                           "doc_id as comment_id from labels union all "
                           "select 2, 'toxic', doc_id from labels where toxic = 1"),
    "v_tagset_tags": "select o_orderstatus as tagset_id, o_orderpriority as tag from orders",
    "v_user_tagset": "select distinct o_custkey as user_id, o_orderstatus as tagset_id from orders",
    "v_grants": ("select distinct e.user_id, cast(substr(d.source, 4) as int) as source_id "
                 "from events e join documents d on e.event_id = d.doc_id"),
    "v_models": ("select event_id as model_id, CAST(1 + user_id % 2 AS INTEGER) as tagset_id, user_id, "
                 "value / 100.0 as score, ts as trained_ts from events where event_type = 'signup'"),
    "v_corpus": (f"select doc_id, text, lang as category, case when {h01(7, 0, 'doc_id')} < 0.75 "
                 f"then 'train' else 'test' end as subset from documents"),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it reads."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

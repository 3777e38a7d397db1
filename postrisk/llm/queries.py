"""The registered queries of the numbered operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postrisk.llm import op2_quality_crf, op4_pii
from postrisk.llm.common import read
from postrisk.llm.op10_substring_dedup import substring_dedup
from postrisk.llm.op11_lm_score import learn, lm_scores
from postrisk.llm.op12_conversation_repair import repair
from postrisk.llm.op13_spelling_groups import spelling_groups
from postrisk.llm.op1_html_extract import main_text
from postrisk.llm.op3_decontaminate import decontaminate
from postrisk.llm.op5_token_count import token_count
from postrisk.llm.op6_near_dups import near_dups
from postrisk.llm.op7_url_filter import parse_rule, url_filter
from postrisk.llm.op8_mixing import mix
from postrisk.llm.op9_quality_rules import ledger, passes

URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]
TOKEN_FILE = "word_bpe_49k.json"
SUBWORD_FILE = "byte_bpe_multi_50k.tiktoken"


def token_file(name: str = TOKEN_FILE) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def items_digest(items=None):
    return F.sha2(F.array_join(items if items is not None else F.col("item_ids"), ","), 256)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return op2_quality_crf.quality(docs, op2_quality_crf.train(docs, read(spark, sf_dir, "labels"))).select(
        "doc_id", "held_out", "score", "predicted")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", items_digest().alias("items_sha256"), "contaminated")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return op4_pii.personal_data(docs, op4_pii.train(docs)).select(
        "doc_id", *[f"n_{k}" for k in op4_pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count(read(spark, sf_dir, "documents"), token_file())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(read(spark, sf_dir, "documents"), words=2, percent=80)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"), [parse_rule(r) for r in URL_RULES])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes("v1").alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"), with_text=False)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lm_scores(docs, learn(docs, token_file(SUBWORD_FILE)))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read(spark, sf_dir, "conversations"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read(spark, sf_dir, "documents"))


QUERIES = {"op1_html_extract": op1, "op2_quality_crf": op2, "op3_decontaminate": op3, "op4_pii": op4, "op5_token_count": op5, "op6_near_dups": op6, "op7_url_filter": op7,
           "op8_mixing": op8, "op9_quality_rules": op9, "op10_substring_dedup": op10,
           "op11_lm_score": op11, "op12_conversation_repair": op12, "op13_spelling_groups": op13}

#: DuckDB SQL of the queries that SQL can express. Trained models, entropy balancing and the
#: vocabulary's merges are tested against brute force and held-out data instead.
ORACLE_SQL: dict[str, str] = {
    # the tables' pages hold their text in one article element
    "op1_html_extract": """
        with a as (select page_id, url, string_split_regex(coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''),
                          '</?(p|h1|br)\\b[^>]*>') as parts from pages),
        b as (select page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                     regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'),
                     '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) as parts from a),
        c as (select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) as text from b)
        select page_id, url, text, cast(length(text) as bigint) as n_chars from c""",
    "op3_decontaminate": r"""
        with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as t
                from iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) r(s) where len(w) > 0),
        place as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as t
                  from dw, (select distinct n from win) z, unnest(range(1, len(w) - n + 2)) r(s)),
        hit as (select doc_id, item_id, s, win.n as n from place join win on place.t = win.t and place.n = win.n),
        words as (select doc_id, count(distinct p) as n_hit from hit, unnest(range(s, s + n)) r(p) group by doc_id),
        items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids
                  from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from dw left join words using (doc_id) left join items using (doc_id)""",
    "op6_near_dups": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        g as (select distinct doc_id, case when len(w) = 1 then w[1] else w[s] || ' ' || w[s + 1] end as g
              from w, unnest(range(1, greatest(len(w), 2))) r(s) where len(w) > 0),
        n as (select doc_id, count(*) as n from g group by doc_id),
        link as (select a.doc_id as a, b.doc_id as b from g a join g b on a.g = b.g and a.doc_id < b.doc_id
                 join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
                 where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
                 group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        both_ways as (select a, b from link union all select b, a from link),
        walk(a, b) as (select distinct a, a from both_ways union select walk.a, l.b from walk join both_ways l on walk.b = l.a),
        c as (select a, min(b) as component_id from walk group by a)
        select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, w.doc_id) as component_id,
               coalesce(component_id, w.doc_id) = w.doc_id as kept
        from w left join n on n.doc_id = w.doc_id left join c on c.a = w.doc_id""",
    "op7_url_filter": r"""
        with p as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
                   from pages),
        u as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
        rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
                     ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        best as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
                 from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
        select u.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join best using (page_id)""",
    "op9_quality_rules": r"""
        with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
                   from documents),
        lines as (select doc_id, l, count(*) as k from w, unnest(string_split(t, chr(10))) r(l)
                  where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id, l),
        dup as (select doc_id, sum(k - 1) as n_dup_lines, sum(k) as n_lines from lines group by doc_id),
        win as (select doc_id, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] as x from w, unnest(range(1, len(w) - 1)) r(s)),
        again as (select doc_id, s, count(*) over (partition by doc_id, x) as k from win),
        rep as (select doc_id, count(distinct p) as n_repeat_words from again, unnest(range(s, s + 3)) r(p)
                where k > 1 group by doc_id),
        m as (select w.doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
                     cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
                     cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
              from w left join dup using (doc_id) left join rep using (doc_id))
        select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 10 * word_chars
                    or word_chars > 20 * n_words) as kept from m""",
    "op10_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as (select doc_id, s, array_to_string(w[s : s + 12], ' ') as x from w, unnest(range(1, len(w) - 11)) r(s)),
        late as (select doc_id, s from (select doc_id, s, min(doc_id) over (partition by x) as least from win) where least < doc_id),
        gone as (select distinct doc_id, p from late, unnest(range(s, s + 13)) r(p)),
        word as (select doc_id, p, w[p] as x from w, unnest(range(1, len(w) + 1)) r(p)),
        kept as (select word.doc_id, string_agg(x, ' ' order by word.p) as t, count(*) as n
                 from word left join gone on gone.doc_id = word.doc_id and gone.p = word.p where gone.p is null group by word.doc_id)
        select w.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
               sha256(coalesce(t, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id""",
}


def _crc32(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text; ``tb`` is the list of its 256 table entries."""
    hexed = f"hex({text})"
    octets = (f"list_transform(range(0, len({hexed}) // 2), lambda i: (instr('0123456789ABCDEF', substr({hexed}, cast(2 * i + 1 as bigint), 1)) - 1) * 16"
              f" + instr('0123456789ABCDEF', substr({hexed}, cast(2 * i + 2 as bigint), 1)) - 1)")
    return (f"xor(list_reduce(list_concat([cast(4294967295 as bigint)], {octets}), lambda c, b: xor(c >> 8, tb[cast((xor(c, b) & 255) + 1 as bigint)])), 4294967295)")


_CRC_TABLE = """crc as (select list(t order by i) as tb from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as t from range(256) r(i)))"""


def _step(state: str, cost: str, op: str, line: str | None) -> str:
    """A state (cost, audit, text) after one more edit."""
    text = f"{state}.t" if line is None else f"{state}.t || chr(10) || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{op}', 't': {text}}}"


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _kept(state: str, want: str) -> str:
    """The row kept or given the wanted role."""
    name = {"u": "user", "a": "assistant"}[want]
    cost = f"case when x.f in (1, 2) then 1000000 else 0 end + case when x.f = 3 then 3 else 0 end + case when left(x.role, 1) = '{want}' then 0 else 3 end"
    return (f"{{'c': {state}.c + {cost}, 'a': {state}.a || case when left(x.role, 1) = '{want}' then 'K' else 'R' end, "
            f"'t': {state}.t || chr(10) || case when left(x.role, 1) = '{want}' then x.role else '{name}' end || ':' || x.text}}")


_SYSTEM = ("{'c': s0.c + case when x.f in (1, 2) or left(x.role, 1) <> 's' then 1000000 when x.f = 3 then 3 else 0 end, "
           "'a': s0.a || 'K', 't': s0.t || chr(10) || x.role || ':' || x.text}")

ORACLE_SQL["op12_conversation_repair"] = rf"""
    with recursive {_CRC_TABLE},
    k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 {_crc32("(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 as h from conversations, crc),
    d as (select conv_id, turn, case when h = 4 then 'user' else role end as role,
                 case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                 unnest(case when h = 3 then [1, 2] else [1] end) as copy from k where h <> 0),
    o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn from d),
    q as (select *, row_number() over (partition by conv_id, role, text order by rn) as nth,
                 left(lag(role) over (partition by conv_id order by rn), 1) || left(role, 1) as pair, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as e from o),
    f as (select *, case when e = '' then 1 when nth > 1 then 2 when right(e, 1) not in ('.', '!', '?') then 3 else 0 end as f from q),
    facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (f = 1) as blank,
                     count(*) filter (f = 2) as duplicate, count(*) filter (f = 3) as truncated,
                     count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal,
                     list({{'role': role, 'text': text, 'f': f}} order by rn) as xs from f group by conv_id),
    dp as (select conv_id, xs, 0 as i, {{'c': 0, 'a': '', 't': ''}} as s0, {{'c': 1000000, 'a': '', 't': ''}} as s1,
                  {{'c': 1000000, 'a': '', 't': ''}} as s2, {{'c': 1000000, 'a': '', 't': ''}} as s3 from facts
           union all
           select conv_id, xs, i + 1, {_step('s0', '4', 'D', None)}, {_least(_step('s1', '4', 'D', None), _SYSTEM)},
                  {_least(_step('e2', '4', 'D', None), _kept('s0', 'u'), _kept('s1', 'u'), _kept('e3', 'u'))},
                  {_least(_step('e3', '4', 'D', None), _kept('e2', 'a'))}
           from (select *, {_least('s2', *[_step(s, '3', 'I', "'user:'") for s in ('s0', 's1', 's3')])} as e2,
                        {_least('s3', _step('s2', '3', 'I', "'assistant:'"))} as e3, xs[i + 1] as x from dp where i < len(xs))),
    done as (select conv_id, {_least('s0', 's3', _step('s2', '3', 'I', "'assistant:'"))} as b from dp where i = len(xs))
    select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
           coalesce(illegal, 0) as illegal, cast(coalesce(b.c, 0) as bigint) as cost, coalesce(b.a, '') as audit, sha256(coalesce(substr(b.t, 2), '')) as repaired_sha256
    from (select distinct conv_id from conversations) c left join facts on facts.conv_id is not distinct from c.conv_id
    left join done on done.conv_id is not distinct from c.conv_id"""

ORACLE_SQL["op13_spelling_groups"] = rf"""
    with recursive {_CRC_TABLE},
    runs as (select doc_id, r, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) as r from documents) group by doc_id, r),
    h as (select r, n, {_crc32("(coalesce(cast(doc_id as varchar), '') || ':' || r)")} as h from runs, crc),
    made as (select case when h % 97 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end as word, n from h),
    w as (select word, cast(sum(n) as bigint) as n from made where length(word) >= 5 group by word having sum(n) >= 3),
    v as (select word, p, substr(word, 1, p - 1) || substr(word, p + 1) as cut from w, unnest(range(1, length(word) + 1)) r(p)),
    near as (select a.word, b.word as near from v a join v b on a.cut = b.cut and a.p = b.p and a.word <> b.word and length(a.word) = length(b.word)
             union select v.word, w.word from v join w on v.cut = w.word union select w.word, v.word from v join w on v.cut = w.word),
    best as (select near.word, count(*) as n_near, max(b.n) as m from near join w b on b.word = near.near group by near.word),
    form as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 2 * w.n then m end as form_n,
                    case when m >= 2 * w.n then (select min(x.near) from near x join w y on y.word = x.near where x.word = w.word and y.n = m) end as form
             from w left join best on best.word = w.word),
    walk as (select word, form as root, 1 as k from form where form is not null
             union all select walk.word, form.form, k + 1 from walk join form on form.word = walk.root where form.form is not null),
    last as (select word, arg_max(root, k) as root from walk group by word)
    select form.word, form, coalesce(root, form.word) as root, n, n_near, form_n from form left join last on last.word = form.word"""

"""DuckDB SQL twins of the registered queries.

Each string reads the driver's tables (pre-registered views) and builds the
same fixture tables as ``postrisk.sources.fixtures`` with the same rules as
the Spark operators, so the two engines are compared value by value.
"""

from __future__ import annotations

from postrisk.functions.scores import NUMBER_PATTERN
from postrisk.functions.text import (
    KEYCAP_PATTERN, MENTION_PATTERN, NOT_SPACE, SPECIAL_PATTERN, URL_PATTERN,
)


def sql_clean(x: str) -> str:
    t = f"coalesce(cast({x} as varchar), '')"
    for pat in (URL_PATTERN, MENTION_PATTERN, KEYCAP_PATTERN, SPECIAL_PATTERN):
        t = f"regexp_replace({t}, '{pat}', ' ', 'g')"
    t = f"lower(replace({t}, '#', ''))"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def sql_has_content(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{NOT_SPACE}'), false)"


def sql_coerce(x: str) -> str:
    s = f"regexp_replace(cast({x} as varchar), '^\\s+|\\s+$', '', 'g')"
    return (f"greatest(0.0, coalesce(case when regexp_matches({s}, '{NUMBER_PATTERN}') "
            f"then try_cast({s} as double) end, 0.0))")


def sql_epoch_us(x: str) -> str:
    return (f"coalesce(case when regexp_matches({x}, '(Z|[+-][0-9:]+)$') and not regexp_matches({x}, '^[0-9-]+$') "
            f"then epoch_us(try_cast({x} as timestamptz)) else epoch_us(try_cast({x} as timestamp)) end, "
            f"epoch_us(try_strptime({x}, '%a %b %d %H:%M:%S %z %Y')))")


def sql_round2(x: str) -> str:
    """Two decimals, half to even, decided by the exact product with 100 (Python's ``round``)."""
    hi = f"(({x}) * 134217729.0::double - (({x}) * 134217729.0::double - ({x})))"
    over = f"((({x}) * 100.0::double - floor(({x}) * 100.0::double) - 0.5::double) + (({hi} * 100.0::double - ({x}) * 100.0::double) + (({x}) - {hi}) * 100.0::double))"
    up = f"(case when {over} = 0 then floor(({x}) * 100.0::double) % 2 <> 0 else {over} > 0 end)"
    return f"((floor(({x}) * 100.0::double) + case when {up} then 1.0::double else 0.0::double end) / 100.0::double)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


cte("fx_n", (), "select count(*) as n from documents")
cte("fx_eng", ("fx_n",), """
select mod(e.event_id, n.n) as doc_id,
       sum(case when e.event_type='view' then 1 else 0 end) as likes,
       sum(case when e.event_type='click' then 1 else 0 end) as reposts,
       sum(case when e.event_type='purchase' then 1 else 0 end) as replies,
       min(e.ts) as posted
from events e cross join fx_n n group by 1""")
cte("fx_base", ("fx_eng",), """
select d.doc_id, d.source, d.lang, d.text, coalesce(l.toxic,0) as toxic,
       coalesce(g.likes,0) as likes, coalesce(g.reposts,0) as reposts, coalesce(g.replies,0) as replies,
       coalesce(g.posted, timestamp '2024-01-01 00:00:00') as posted
from documents d left join fx_eng g on d.doc_id=g.doc_id left join labels l on d.doc_id=l.doc_id""")
cte("fx_copies", ("fx_base",), """
select 0 as source_rank, 'targeted' as collection_type, 0 as extra, b.* from fx_base b where mod(b.doc_id,5) in (0,1)
union all select 1, 'random', 1, b.* from fx_base b where mod(b.doc_id,5) in (1,2,3,4)""")
cte("raw_posts", ("fx_copies",), """
select source_rank, doc_id as row_ord, cast(doc_id as varchar) as post_id, source as query, collection_type,
  case when source_rank=0 and mod(doc_id,97)=0 then null when mod(doc_id,89)=0 then '   '
       when mod(doc_id,101)=0 then 'see @https:// now' when mod(doc_id,103)=0 then '@www.' else text end as text,
  case when mod(doc_id,83)=0 then 'abc' when mod(doc_id,107)=0 then concat(chr(9), '5') else cast(likes+extra as varchar) end as likes,
  cast(reposts as varchar) as reposts, cast(replies as varchar) as replies,
  case when mod(doc_id,79)=0 then 'garbage' when mod(doc_id,109)=0 then strftime(posted, '%Y-%m-%dT%H:%M:%S') when mod(doc_id,2)=0 then strftime(posted, '%Y-%m-%dT%H:%M:%S+00:00')
       else strftime(posted, '%a %b %d %H:%M:%S +0000 %Y') end as timestamp_utc,
  concat(lang,'_',source) as author_username, '2024-02-01T00:00:00+00:00' as scraped_at_utc
from fx_copies""")
cte("dedup", ("raw_posts",), """
select * exclude (rn_) from (
  select *, row_number() over (partition by post_id order by source_rank, row_ord) as rn_ from raw_posts)
where rn_ = 1""")
cte("feat0", ("dedup",), f"""
select post_id, query, collection_type, source_rank, row_ord, author_username,
  (text is null or timestamp_utc is null or scraped_at_utc is null or not {sql_has_content('text')}) as missing_,
  {sql_clean('text')} as text,
  {sql_coerce('likes')} as likes, {sql_coerce('reposts')} as reposts, {sql_coerce('replies')} as replies,
  {sql_epoch_us('timestamp_utc')} as posted_us, {sql_epoch_us('scraped_at_utc')} as scraped_us
from dedup""")
cte("feat1", ("feat0",), """
select *, case when posted_us is not null and scraped_us is not null
               then greatest(0.0, (scraped_us - posted_us) / 3.6e9) end as hours_since_post,
          case when 1.0 + likes + 2.0*reposts + 1.5*replies > 0 then ln(1.0 + likes + 2.0*reposts + 1.5*replies) end
            as amplification_raw
from feat0""")
cte("feat2", ("feat1",), """
select *, (likes + reposts + replies) / (hours_since_post + 1.0) as velocity_raw,
  case when missing_ then 'missing_value' when length(text) = 0 then 'empty_after_clean'
       when hours_since_post is null then 'bad_timestamp' when amplification_raw is null then 'bad_amplification'
  end as reason_
from feat1""")
cte("feat", ("feat2",), "select * from feat2 where reason_ is null")
cte("cleaned", ("feat",), """
select post_id, text, likes, reposts, replies, posted_us, hours_since_post, amplification_raw,
  case when max(amplification_raw) over () = min(amplification_raw) over () then amplification_raw * 0.0
       else (amplification_raw - min(amplification_raw) over ())
            / (max(amplification_raw) over () - min(amplification_raw) over ()) end as amplification_norm,
  velocity_raw,
  case when max(velocity_raw) over () = min(velocity_raw) over () then velocity_raw * 0.0
       else (velocity_raw - min(velocity_raw) over ()) / (max(velocity_raw) over () - min(velocity_raw) over ()) end
    as velocity_norm,
  author_username
from feat""")
cte("scored", ("cleaned",), """
select c.*, cast(coalesce(l.toxic,0)*300 + mod(cast(c.post_id as bigint)*7919, 700) as double) / 1000 as P_hoax
from cleaned c left join labels l on l.doc_id = cast(c.post_id as bigint)""")
cte("risk", ("scored",), """
select *, 100.0::double * (0.5::double * P_hoax + 0.25::double * amplification_norm + 0.25::double * velocity_norm) as raw_risk from scored""")
cte("triaged0", ("risk",), f"select *, {sql_round2('raw_risk')} as Risk_Score from risk")
cte("triaged", ("triaged0",), """
select *, case when Risk_Score >= 70 then 'Merah' when Risk_Score >= 40 then 'Kuning' else 'Hijau' end as Zona_Triase,
  case when Risk_Score >= 70 then 'Immediate (< 1 jam)' when Risk_Score >= 40 then 'Priority (< 6 jam)'
       else 'Routine/Monitoring (< 24 jam)' end as Target_Respons,
  P_hoax * 0.5 * 100 as Kontribusi_Teks,
  amplification_norm * 0.25 * 100 as Kontribusi_Amplifikasi,
  velocity_norm * 0.25 * 100 as Kontribusi_Velositas
from triaged0""")


def with_ctes(*names: str) -> str:
    """``WITH`` clause holding the named CTEs and everything they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as ({CTES[n][1]})" for n in order) + "\n"


def r6(x: str, alias: str | None = None) -> str:
    return f"round({x}, 6) as {alias or x}"


ORACLE: dict[str, str] = {}


def oracle(name: str, ctes: tuple[str, ...], body: str) -> None:
    if ctes:
        ORACLE[name] = with_ctes(*ctes) + body
    else:
        b = body.lstrip()
        ORACLE[name] = ("with " + b[1:]) if b.startswith(",") else body

cte("ann", (), """
select cast(doc_id as varchar) as post_id, annotator, case when mod(doc_id, 41) = 0 then null when flip then 1 - toxic else toxic end as label
from (select doc_id, toxic, 'annotator_1' as annotator, false as flip from labels
      union all select doc_id, toxic, 'annotator_2', mod(doc_id, 11) = 0 from labels where mod(doc_id, 37) <> 0
      union all select doc_id, toxic, 'annotator_3', mod(doc_id, 7) = 0 from labels where mod(doc_id, 37) <> 0)""")
cte("ann_gaps", ("ann",), """
select post_id, annotator,
  case when annotator = 'annotator_2' and mod(cast(post_id as bigint), 19) = 0 then null else label end as label
from ann where not (annotator = 'annotator_3' and mod(cast(post_id as bigint), 17) = 0)""")
cte("votes", ("ann",), """
select post_id, case when vote_hoax + vote_nonhoax = 0 then null when vote_hoax > vote_nonhoax then 1 else 0 end as label,
  (vote_hoax > 0 and vote_nonhoax > 0) as is_ambiguous, vote_hoax, vote_nonhoax
from (select post_id, count(*) filter (where label = 1) as vote_hoax,
             count(*) filter (where label = 0) as vote_nonhoax from ann group by post_id)""")
cte("k_nij", ("ann",), """
select post_id, label, cast(count(*) as double) as nij from ann where label is not null
  and post_id in (select post_id from ann group by post_id having count(label) >= 2) group by post_id, label""")
cte("k_items", ("k_nij",), """
select count(*) as n_items, avg((sq - ni) / (ni * (ni - 1))) as p_bar, cast(min(ni) as bigint) as n_raters_min,
  cast(max(ni) as bigint) as n_raters_max, sum(ni) as total
from (select post_id, sum(nij * nij) as sq, sum(nij) as ni from k_nij group by post_id)""")
cte("k_pe", ("k_nij", "k_items"), """
select sum(power(tj / (select total from k_items), 2)) as p_e from (select label, sum(nij) as tj from k_nij group by label)""")
cte("kappa", ("k_items", "k_pe"), """
select case when p_e = 1 then 1.0 else (p_bar - p_e) / (1 - p_e) end as kappa, p_bar, p_e, n_items,
  n_raters_min, n_raters_max from k_items, k_pe""")
cte("responses", (), """
select cast(doc_id as varchar) as post_id,
  case when mod(doc_id, 29) = 0 then 'so {bad} it is' when mod(doc_id, 31) = 0 then 'no object' else
  concat('note {"label": ', cast(case when mod(doc_id, 13) = 0 then 7 else toxic end as varchar),
         ', "reason": " r', cast(doc_id as varchar), ' "} end') end as raw_response from labels""")

cte("ldocs", (), """
select cast(doc_id as varchar) as post_id, toxic as label,
  cast(toxic * 300 + mod(doc_id * 7919, 700) as double) / 1000 as P_hoax from labels""")
cte("q_cc", ("ldocs",), "select label, count(*) as n_class from ldocs group by label")
cte("q_t", ("q_cc",), """
select label, n_class, base + case when ord <= short then 1 else 0 end as n_test from (
  select *, nt - sum(base) over () as short,
         row_number() over (order by ex - base desc, label asc) as ord from (
    select *, floor(ex) as base from (
      select *, nt * n_class / sum(n_class) over () as ex from (
        select *, ceil(cast(0.15 as double) * sum(n_class) over ()) as nt from q_cc))))""")
cte("q_tv", ("q_t",), f"""
select label, n_class, n_test, base + case when ord <= short then 1 else 0 end as n_val from (
  select *, nv - sum(base) over () as short,
         row_number() over (order by ex - base desc, label asc) as ord from (
    select *, floor(ex) as base from (
      select *, nv * rest / sum(rest) over () as ex from (
        select *, ceil(cast({0.15 / (0.70 + 0.15)!r} as double) * sum(rest) over ()) as nv from (
          select *, n_class - n_test as rest from q_t)))))""")
cte("q_sizes", ("q_tv",), """
select 'test' as split, label, cast(n_test as bigint) as n from q_tv
union all select 'val', label, cast(n_val as bigint) from q_tv
union all select 'train', label, cast(n_class - n_test - n_val as bigint) from q_tv""")
cte("sweep_counts", ("ldocs",), """
select threshold,
  count(*) filter (where P_hoax >= threshold and label = 1) as tp,
  count(*) filter (where P_hoax >= threshold and label = 0) as fp,
  count(*) filter (where P_hoax < threshold and label = 1) as fn,
  count(*) filter (where P_hoax < threshold and label = 0) as tn
from ldocs, (select cast(unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]) as double) as threshold)
group by threshold""")


def sql_metrics(tp="tp", fp="fp", fn="fn", tn="tn", digits=4) -> str:
    def div(a, b):
        return f"(case when ({b}) = 0 then 0.0 else cast({a} as double) / ({b}) end)"
    f1p, f1n = div(f"2*{tp}", f"2*{tp}+{fp}+{fn}"), div(f"2*{tn}", f"2*{tn}+{fn}+{fp}")
    hp, hn = f"({tp}+{fn}+{fp} > 0)", f"({tn}+{fp}+{fn} > 0)"
    macro = div(f"(case when {hp} then {f1p} else 0.0 end + case when {hn} then {f1n} else 0.0 end)",
                f"(cast({hp} as integer) + cast({hn} as integer))")
    return (f"round_even({div(f'{tp}+{tn}', f'{tp}+{fp}+{fn}+{tn}')}, {digits}) as accuracy, "
            f"round_even({div(tp, f'{tp}+{fp}')}, {digits}) as precision_hoax, "
            f"round_even({div(tp, f'{tp}+{fn}')}, {digits}) as recall_hoax, "
            f"round_even({macro}, {digits}) as macro_f1")

cte("stored", ("raw_posts",), "select * from raw_posts where mod(row_ord, 3) = 0")
cte("new_rows", ("raw_posts", "stored"), """
select * exclude (rn_) from (
  select b.*, row_number() over (partition by b.collection_type, b.post_id order by b.source_rank, b.row_ord) as rn_
  from raw_posts b where not exists (
    select 1 from stored s where s.collection_type = b.collection_type and s.post_id = b.post_id))
where rn_ = 1""")

"""DuckDB SQL for the registered queries: named parts, put together with what they need."""

from __future__ import annotations

import re

from tallyscope.operators import lexicon as lx
from tallyscope.params import DEFAULTS
from tallyscope.sources.fixtures import F1_SQL, F3_SQL

W = DEFAULTS.weights


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + i + "'" for i in items) + "]"


def _terms() -> str:
    return f"select * from (values {_values(lx.default_rows())}) as v(family, ord, weight, kind, term)"


APPROVAL = r"(?i)(autoriza\w*|aprob\w*|firma\w*|liber\w*|palome\w*|oc\b|po\b|orden de compra|licitaci[oó]n|contrato|alta proveedor)"
COMP = r"(?i)(agradec\w*|detalle|incentiv\w*|bono|regalo|mordida|moche|coima|chayote|por fuera|sin factura|sin cfdi|no timbrar|off the record|favor sexual|salida [ií]ntima|cita privada|trato especial)"
_norm = "regexp_replace(translate(lower(trim(coalesce({0}, ''))), 'áéíóúüñ', 'aeiouun'), '\\s+', ' ', 'g')"

PARTS: dict[str, str] = {
    "f1": F1_SQL,
    "f3": F3_SQL,
    "tx": """select concat_ws('-', leg, order_key, part_key, supp_key, line_number) as tx_id, user_id, receiver_id, ts, strftime(ts, '%Y-%m') as month_id, movement_amount as amt,
      nullif(trim(descripcion), '') as descripcion, origin_application_id as app, reference_text as ref, value_ts, sn, rn,
      case when receiver_id = user_id then 'mismo_usuario' when (sn > 0 and rn = sn // 4) or (sn >= 4 and rn = sn // 16) then 'manager_del_emisor' when rn // 4 = sn // 4 then 'companero_equipo' else 'otro' end as relacion,
      round_even(floor((epoch_us(ts) - epoch_us(timestamp '1990-01-01' + to_days(cast(sn * 977 % 4300 as int)))) / 86400000000.0) / 365.25, 2) + 0.0 as ten_u,
      round_even(floor((epoch_us(ts) - epoch_us(timestamp '1990-01-01' + to_days(cast(rn * 977 % 4300 as int)))) / 86400000000.0) / 365.25, 2) + 0.0 as ten_r,
      user_id || '→' || receiver_id as pair, least(user_id || '|' || receiver_id, receiver_id || '|' || user_id) as upair from f1""",
    "base": "select tx_id, m, sd, case when coalesce(sd, 0) = 0 then 0 else (amt - m) / sd end as z from (select tx_id, amt, avg(amt) over (partition by user_id) as m, stddev_samp(amt) over (partition by user_id) as sd from tx)",
    "amounts": "select tx_id, least(abs(amt - 17000), abs(amt - 85000), abs(amt - 92500)) as delta, " + " or ".join(f"least(amt % {b}, {b} - amt % {b}) < 1e-9" for b in DEFAULTS.round_bases) + " as is_round from tx",
    "ranked": "select tx_id, user_id, receiver_id, ts, amt, row_number() over (partition by user_id, receiver_id order by ts, tx_id) as k from tx",
    "freq": """select distinct r.tx_id from ranked r join (select user_id, receiver_id, k, st from (select *, min(k) over (partition by user_id, receiver_id order by ts range between interval 30 days preceding and current row) as st from ranked) where k - st >= 4) h
      on r.user_id = h.user_id and r.receiver_id = h.receiver_id and r.k between h.st and h.k""",
    "smurf": """select distinct r.tx_id from ranked r join (
        select e.user_id, e.receiver_id, e.k, e.st from (select *, min(k) over (partition by user_id, receiver_id order by ts range between interval 7 days preceding and current row) as st from ranked) e
        join ranked w on w.user_id = e.user_id and w.receiver_id = e.receiver_id and w.k between e.st and e.k group by all
        having (sum(w.amt) >= 10000 and max(w.amt) < 10000) or (sum(w.amt) >= 20000 and max(w.amt) < 20000)) h
      on r.user_id = h.user_id and r.receiver_id = h.receiver_id and r.k between h.st and h.k""",
    "recurrent": "select tx_id from tx join (select user_id, receiver_id, day(ts) as d from tx group by all having count(distinct month_id) >= 3) g on tx.user_id = g.user_id and tx.receiver_id = g.receiver_id and day(tx.ts) = g.d",
    "yoyo": """select distinct unnest([i, j]) as tx_id from (select a.tx_id as i, b.tx_id as j from tx a join tx b on a.user_id = b.receiver_id and a.receiver_id = b.user_id
      where a.user_id < a.receiver_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 28800000000 and abs(a.amt - b.amt) <= greatest(a.amt, b.amt) * 0.02)""",
    "loan": f"""select a.tx_id, case when a.amt > 0 then coalesce(sum(b.amt), 0) / a.amt else 1.0 end as ratio from tx a left join tx b on b.user_id = a.receiver_id and b.receiver_id = a.user_id and b.ts between a.ts and a.ts + interval 60 days
      where regexp_matches({_norm.format('a.descripcion')}, '\\b(prestam|adelant|abono)\\b') group by a.tx_id, a.amt""",
    "bins": """select app as canal, time_bucket(interval '2 hours', ts) as ini, count(*) as n, sum((hour(ts) < 8 or hour(ts) >= 20)::int)::bigint as off, count(distinct user_id) as em, count(distinct receiver_id) as re, sum(amt) as total from tx group by all""",
    "refs": f"""select rn_ as ref_norm, count(*) as n, count(distinct upair) as pairs, min(ts) as lo, max(ts) as hi, sum(amt) as total from (select *, {_norm.format('ref')} as rn_ from tx) where length(rn_) >= 4 group by rn_""",
    "reused": "select ref_norm from refs where pairs >= 2 and hi - lo <= interval 30 days",
    "months": """select *, year * 12 + mon - min(year * 12 + mon) over () as age, year * 12 + mon - lag(year * 12 + mon) over w as gap, lag(x) over w as px, lag(n) over w as pn from (
        select user_id, receiver_id, month_id, cast(substr(month_id, 1, 4) as int) as year, cast(substr(month_id, 6, 2) as int) as mon, sum(amt) as x, count(*) as n from tx group by all)
      window w as (partition by user_id, receiver_id order by month_id)""",
    "changes": """select user_id, receiver_id, month_id, x, n, case when px > 0 then x / px else 0 end as rx, case when pn > 0 then n / pn else 0 end as rn_, case when px is null then age else gap end as since,
      coalesce((px > 0 and x / px >= 4) or (pn > 0 and n / pn >= 3), false) as jump, px is null and x > 0 and age >= 3 as fresh from months""",
    "quid_rows": f"""select tx_id, upair, value_ts, epoch_us(value_ts) // 1000000 as s, regexp_matches(t, '{APPROVAL}') as apr, regexp_matches(t, '{COMP}') as cmp,
      (sn > 0 and rn = sn // 4) or (sn >= 4 and rn = sn // 16) as up, (sn > 0 and sn = sn // 4) or (sn >= 4 and sn = sn // 16) as down, (epoch_us(value_ts) - epoch_us(ts)) / 86400000000.0 as days
      from (select *, {_norm.format("concat_ws(' | ', nullif(trim(ref), ''), nullif(trim(descripcion), ''))")} as t from tx)""",
    "quid": """select q.*, case when up then 'Subordinado-Manager' when down then 'Manager-Subordinado' else 'Par/Indefinido' end as label,
      round((up or down)::int * 1.0 + (apr and cmp)::int * 1.2 + (z > 2)::int * 0.4 + (delta <= 10)::int * 0.3 + (days < -0.5)::int * 0.3 + 0.8 * coalesce((apr and s - lc <= 259200)::int, 0) + 0.8 * coalesce((cmp and s - la <= 259200)::int, 0), 6) as score
      from (select *, max(case when cmp then s end) over w as lc, max(case when apr then s end) over w as la from quid_rows window w as (partition by upair order by value_ts, tx_id rows between unbounded preceding and 1 preceding)) q join base using (tx_id) join amounts using (tx_id)""",
    "terms": _terms(),
    "texts": r"""select raw, norm, regexp_extract_all(norm, '[a-z0-9]+') as words from (select raw, regexp_replace(regexp_replace(translate(lower(trim(raw)), '013457$@!', 'oieastsai'), '\b\d{3,}-?\d{2,}\b', ' cuenta ', 'g'), '\s+', ' ', 'g') as norm from (select distinct coalesce(descripcion, '') as raw from tx))""",
    "hits": f"""select distinct norm, family, ord, weight, term from (
        select norm, family, ord, weight, term from texts join terms on case kind when 'word' then case when length(term) >= 4 then list_contains(words, term) else contains(norm, term) end when 'phrase' then contains(norm, term) else regexp_matches(norm, term) end
        union all select norm, 'FACILITACION', {list(lx.DEFAULT_LEXICON).index('FACILITACION')}, {lx.DEFAULT_LEXICON['FACILITACION'][0]}, 'facilitacion+evento' from texts where regexp_matches(norm, '{lx.FACILITATE}') and regexp_matches(norm, '{lx.EVENT}'))""",
    "emo": f"select norm, list_bool_or([contains(norm, p) for p in {_list(lx.EMOTIONAL_PHRASES)}]) as emotional, regexp_matches(norm, '{lx.EVENT}') as event from texts",
    "fams": f"""select norm, family, ord, contrib + case when family = 'OFUSCACION' and event then 1.2 else 0 end + case when family = 'EMOCIONAL' and emotional then 0.9 else 0 end as contrib from (select norm, family, min(ord) as ord, min(weight) as contrib from hits group by all) join emo using (norm)
      union all select norm, 'EMOCIONAL', {list(lx.DEFAULT_LEXICON).index('EMOCIONAL')}, 0.9 from emo where emotional and norm not in (select norm from hits where family = 'EMOCIONAL')""",
    "tags": f"""select t.raw, t.norm, coalesce(f.concept, '') as concept, coalesce(f.cats, []) as cats, vag, sent, emotional::int as emo, event,
        coalesce(f.total, 0) + case when list_has_any(coalesce(f.cats, []), ['REEMBOLSO_DUDOSO', 'NOMINA_PARALELA', 'PRESTAMO']) then least(1.0, vag) * 0.8 else 0 end + case when emotional then 0.3 else 0 end
          + case when list_has_any(coalesce(f.cats, []), ['COORDINACION_REITERADA', 'ALUSION_INDIRECTA']) and len(f.cats) > 1 then 0.6 else 0 end as base_score,
        len(coalesce(f.cats, [])) > 0 and list_has_all({_list(lx.WEAK_FAMILIES)}, coalesce(f.cats, [])) as weak
      from (select raw, norm, case when len(words) = 0 then 1.0 when len(words) <= 2 then greatest(0.8, v) else v end as vag, round(s, 3) as sent from (
          select *, len(list_filter(words, lambda w: list_contains({_list(lx.VAGUE_WORDS)}, w))) / greatest(len(words), 1) as v,
            (len(list_filter(words, lambda w: list_contains({_list(lx.GOOD_WORDS)}, w))) - len(list_filter(words, lambda w: list_contains({_list(lx.BAD_WORDS)}, w)))) / greatest(len(words), 1) as s from texts)) t
      join emo using (norm) left join (select norm, sum(contrib) as total, list_sort(list(family)) as cats, arg_max(family, (contrib, -ord)) as concept from fams group by norm) f using (norm)""",
    "nlp": f"""select tx_id, concept, cats, vag, emo, event, sent, points, round(points + boost + vag * 0.6 + abs(sent) * 0.5, 3) as coi from (
        select tx_id, g.*, round(case when weak then least(p, 2.0) else p end, 3) as points, case when sent > 0.25 then least(0.6, sent * 1.4) when sent < -0.2 then least(0.7, abs(sent) * 1.5) else 0 end as boost
        from (select tx_id, tags.*, base_score + case when relacion like '%manager%' and list_has_any(cats, {_list(lx.HIERARCHY_FAMILIES)}) then 0.8 else 0 end as p from tx join tags on coalesce(tx.descripcion, '') = tags.raw) g)""",
    "edges": "select distinct user_id as a, receiver_id as b from tx",
    "und": "select a, b from edges union select b, a from edges",
    "tri": "select distinct x.a as node from und x join und y on x.a = y.a and x.b < y.b join und z on z.a = x.b and z.b = y.b",
    "cyc": """select distinct unnest([a, b, c]) as node from (select x.a, x.b, y.b as c from edges x join edges y on x.b = y.a join edges z on z.a = y.b and z.b = x.a)
      union select distinct unnest([a, b, c, d]) from (select x.a, x.b, y.b as c, z.b as d from edges x join edges y on x.b = y.a join edges z on z.a = y.b join edges u on u.a = z.b and u.b = x.a where z.b <> x.a and x.b <> z.b)""",
    "sig": """select tx.*, m, sd, z, delta, delta <= 10 as near, is_round, freq.tx_id is not null as freq, smurf.tx_id is not null as smurf, recurrent.tx_id is not null as recurrent, yoyo.tx_id is not null as yoyo,
        loan.tx_id is not null as loan, coalesce(loan.ratio, 1.0) as repay, coalesce(loan.ratio < 0.5, false) as bad_loan, reused.ref_norm is not null as ref_reuse, jump, fresh, rx, changes.rn_ as rn_ratio, since,
        label, apr, cmp, days, quid.score as qscore, quid.score >= 2.2 as quid, concept, cats, vag, emo, event, sent, points, coi, bins.n >= 5 and bins.off / bins.n >= 0.6 as burst, bins.ini, bins.n as bin_n, bins.off as bin_off,
        user_id in (select node from cyc) as cyc1, receiver_id in (select node from cyc) as cyc2, user_id in (select node from tri) as tri1, receiver_id in (select node from tri) as tri2
      from tx join base using (tx_id) join amounts using (tx_id) left join freq using (tx_id) left join smurf using (tx_id) left join recurrent using (tx_id) left join yoyo using (tx_id) left join loan using (tx_id)
      left join reused on reused.ref_norm = """ + _norm.format("tx.ref") + """ join changes using (user_id, receiver_id, month_id) join quid using (tx_id) join nlp using (tx_id) join bins on bins.canal = tx.app and bins.ini = time_bucket(interval '2 hours', tx.ts)""",
    "scored": f"""select *, round(ln(1 + greatest(greatest(z, 0) * {W['zscore']} + (relacion like '%manager%')::int * {W['hierarchy']} + (vag + (emo > 0)::int * 0.5) * 0.45 * {W['nlp']} + points * 0.12 + abs(sent) * 0.25 + coi * 0.18 + event::int * 0.2
        + is_round::int * {W['roundsum']} + near::int * {W['nearthr']} + smurf::int * {W['smurf']} + yoyo::int * {W['yoyo']} + bad_loan::int * {W['loan']} + freq::int * {W['freq']} + recurrent::int * {W['recurrent']}
        + (cyc1 or cyc2)::int * {W['sna_cycle']} + (tri1 or tri2)::int * {W['sna_triangle']} + quid::int * {W['quid']} + ref_reuse::int * {W['reference_reuse']} + jump::int * {W['change_point']} + fresh::int * {W['new_edge']}, 0)) * 1.3, 9) as risk from sig""",
    "cal": "select month_id, quantile_cont(risk, 0.8) as p80, quantile_cont(risk, 0.9) as p90, quantile_cont(risk, 0.95) as p95, count(*) as n_tx_mes from scored group by month_id",
    "tiers": """select *, case when risk >= p95 then 'CRITICO' when risk >= p90 then 'ALTO' when risk >= p80 then 'MEDIO' else 'BAJO' end as tier,
      (rank() over (partition by month_id order by risk) + (count(*) over (partition by month_id, risk) - 1) / 2.0) / count(*) over (partition by month_id) as norm from scored join cal using (month_id)""",
    "s": """select tiers.*, tf as timeframe_periodo from tiers join (values ('ultimo_mes', 30), ('ultimos_3_meses', 90), ('todo_el_tiempo', 1000000)) f(tf, d) on epoch_us(tiers.ts) >= (select max(epoch_us(ts)) from tiers) - f.d * 86400000000""",
    "ends": "select s.*, user_id as persona, true as sent_ from s union all select s.*, receiver_id as persona, false as sent_ from s",
    "frame_edges": "select distinct timeframe_periodo as tf, user_id as a, receiver_id as b from s",
    "both_ways": "select tf, a, b from frame_edges union select tf, b, a from frame_edges",
    "reach": "select tf, a as x, a as y from both_ways union select r.tf, r.x, e.b from reach r join both_ways e on e.tf = r.tf and e.a = r.y",
    "clusters": "select tf as timeframe_periodo, node, 'cluster_' || dense_rank() over (partition by tf order by root) as cluster_id from (select tf, x as node, min(y) as root from reach group by all)",
    "clustered": "select s.*, cluster_id from s join clusters on s.user_id = clusters.node and s.timeframe_periodo = clusters.timeframe_periodo",
    "shared_refs": """select * from (select timeframe_periodo, lower(trim(ref)) as reference_norm, min(ts) as lo, max(ts) as hi, count(distinct upair) as pairs_count, list(distinct upair) as ps, count(*) as tx_count, sum(amt) as total
      from s where length(lower(trim(ref))) >= 4 group by all) where pairs_count > 1 and epoch_us(hi) - epoch_us(lo) <= 30 * 86400000000""",
    "f3e": "select distinct user_id as a, receiver_id as b from f3",
    "f3u": "select a, b from f3e union select b, a from f3e",
}

_NAMES = list(PARTS)
#: A part uses only parts before it.
_USES = {k: [p for p in _NAMES[:i] if re.search(rf"\b(?:from|join)\s+{p}\b", PARTS[k])] for i, k in enumerate(_NAMES)}


def sql(select: str) -> str:
    """The select with the parts that it needs, each before what uses it."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for p in _USES[name]:
                need(p)
            order.append(name)

    for p in PARTS:
        if re.search(rf"\b(?:from|join)\s+{p}\b", select):
            need(p)
    # named tables are made once: scored transfers feed many parts
    return ("with recursive " if "reach" in order else "with ") + ",\n".join(f"{p} as {'materialized ' if p in ('tx', 'sig', 'scored', 'tiers', 's') else ''}({PARTS[p]})" for p in order) + "\n" + select

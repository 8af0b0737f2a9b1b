"""The queries in SQL for an independent engine, over the same tables.

``FRAGMENTS`` are named subqueries; a query lists the ones it needs by using their names.
"""

from __future__ import annotations

import re

from carepath.constants import (
    ICD10_CHAPTERS,
    MACE_CODES,
    MODEL_LABELS,
    DEMOGRAPHIC_LABELS,
    DECAY_LABELS,
    PREVALENCE_BINS,
    VISIT_CONCEPTS,
)
from carepath.registry.views import RUN_CLASSES, RUN_METRICS

DAY = 86_400_000_000


def _plain(key: str, dot: str = "") -> str:
    return f"chr(cast(65+{key}%21 as int))||lpad(cast({key}%100 as varchar),2,'0')||'{dot}'||cast({key}%10 as varchar)"


def _diagnosis(key: str) -> str:
    return (
        f"case {key}%60 when 0 then 'I210' when 1 then 'I200' when 2 then 'I501' when 3 then 'I64' "
        f"when 4 then 'I24' else {_plain(key)} end"
    )


def _span(begin: str, end: str) -> str:
    return f"(epoch_us({end})-epoch_us({begin}))"


def _days(begin: str, end: str) -> str:
    return f"cast(floor({_span(begin, end)}/{DAY}) as bigint)"


def _exact_days(begin: str, end: str) -> str:
    return f"({_span(begin, end)}/{DAY}.0::double)"


def _case(column: str, labels: dict, otherwise: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in labels.items())
    return f"case cast({column} as varchar) {whens} else {otherwise} end"


START, END = "timestamp '1996-01-01'", "timestamp '2001-01-01'"
CLASSES = "(values " + ", ".join(
    f"('{label}', '{'|'.join(codes)}')" for label, codes in MACE_CODES.items()
) + ") as m(label, pattern)"
CHAPTER_VALUES = "(values " + ", ".join(f"('{c}')" for c in range(1, 23)) + ") as k(class)"

_run_scores = ", ".join(
    f"((event_id*{7 + 3 * i + 5 * j})%101)/100.0::double as c_{c}__score_{m}"
    for i, c in enumerate(RUN_CLASSES) for j, m in enumerate(RUN_METRICS)
)
_run_prevalences = ", ".join(
    f"((event_id*{3 + 2 * i})%{10 + 15 * i})*1.0::double as test_prevalence_{c}" for i, c in enumerate(RUN_CLASSES)
)

FRAGMENTS = {
    "v_person": """select c_custkey person_id,
        timestamp '1940-01-01' + to_days(cast((c_custkey*37)%25550 as int)) birth_datetime,
        case when c_custkey%11=0 then timestamp '1999-01-01' + to_days(cast((c_custkey*13)%900 as int)) end death_datetime,
        case when c_custkey%2=0 then 'f' else 'm' end gender_source_value from customer""",
    "v_visit": """select o_orderkey visit_occurrence_id, o_custkey person_id,
        o_orderdate + to_hours(cast(o_orderkey%24 as int)) visit_start_datetime,
        case when o_orderkey%20<>0 then o_orderdate + to_hours(cast(o_orderkey%24 as int))
            + to_days(cast((o_orderkey*7)%45 as int)) end visit_end_datetime,
        case substr(o_orderpriority,1,1) when '1' then 'urgence' when '5' then 'consultation externe'
            when '4' then 'hospitalisation incomplète' else 'hospitalisés' end visit_source_value,
        o_orderkey%25 care_site_id, o_orderstatus admitted_from_source_value,
        o_orderpriority discharge_to_source_value from orders""",
    "v_detail": """select o_orderkey visit_occurrence_id,
        o_orderdate + to_days(cast(2+o_orderkey%5 as int)) visit_detail_end_datetime,
        case when o_orderkey%40=0 then 'RSS' else 'MOUV' end visit_detail_type_source_value
        from orders where o_orderkey%20=0""",
    "v_movement": """select l_orderkey visit_occurrence_id, l_orderkey*10+l_linenumber visit_detail_id,
        o_orderdate + to_hours(cast(l_linenumber%5 as int)) visit_detail_start_datetime,
        case when l_linenumber<>5 then o_orderdate + to_hours(cast(l_linenumber%5 as int))
            + to_days(cast(l_linenumber%3 as int)) end visit_detail_end_datetime,
        case when l_linenumber%2=0 then 'PASS' else 'MOUV' end visit_detail_type_source_value
        from lineitem join orders on l_orderkey=o_orderkey""",
    "v_line": """select o_custkey person_id, l_orderkey visit_occurrence_id,
        o_orderdate + to_days(cast((l_linenumber-1)*3 as int)) + to_hours(cast(o_orderkey%24 as int)) start,
        l_partkey, l_returnflag, l_linestatus from lineitem join orders on l_orderkey=o_orderkey""",
    "v_condition": f"""select person_id, visit_occurrence_id, start condition_start_datetime,
        {_diagnosis('l_partkey')} condition_source_value from v_line where l_returnflag='N'""",
    "v_measurement": """select person_id, visit_occurrence_id, start measurement_datetime,
        'L'||cast(l_partkey%50 as varchar) measurement_source_value from v_line where l_linestatus='O'""",
    "v_raw_mapping": """select 'L'||cast(p_partkey%50 as varchar) loinc_concept_code,
        'N'||cast(p_partkey%20 as varchar) nabm_concept_code from part where p_partkey%50%7<>0""",
    "v_mapping": """select loinc_concept_code event_source_concept_id, min(nabm_concept_code) target_concept_id,
        count(distinct nabm_concept_code) n_targets from v_raw_mapping group by 1""",
    "v_care_site": """select cast(n_nationkey as bigint) care_site_id, r_name hospital_name
        from nation join region on n_regionkey=r_regionkey""",
    "v_tree": f"""select distinct substr(code,1,4) concept_code, cast(ascii(code)-64 as varchar) concept_chapter
        from (select {_diagnosis('p_partkey')} code from part where p_partkey%13<>0)""",
    "v_embedding": f"""select {_plain('vec_id')} event_source_concept_id, cast(embedding as double[]) embedding,
        label, vec_id from embeddings""",
    "v_hospital": f"""select * from v_visit where visit_source_value in ('hospitalisés','hospitalisation incomplète')
        and visit_start_datetime between {START} and {END}""",
    "v_rss": """select visit_occurrence_id, max(visit_detail_end_datetime) recovered from v_detail
        where visit_detail_type_source_value='RSS' group by 1""",
    "v_recovered": """select h.* replace (coalesce(visit_end_datetime, recovered) as visit_end_datetime)
        from v_hospital h left join v_rss using (visit_occurrence_id)
        where coalesce(visit_end_datetime, recovered) is not null""",
    "v_fixed": """select * replace (case when visit_source_value='hospitalisation incomplète'
        then visit_start_datetime + interval 1 day else visit_end_datetime end as visit_end_datetime)
        from v_recovered""",
    "v_gap": f"""select *, {_exact_days('lag(visit_end_datetime) over w', 'visit_start_datetime')} delta
        from v_fixed window w as (partition by person_id order by visit_start_datetime, visit_occurrence_id)""",
    "v_numbered": """select *, coalesce(delta>=1, false) new_session_mark,
        cast(person_id as varchar)||'_'||cast(sum(case when delta>=1 then 1 else 0 end) over (partition by person_id
            order by visit_start_datetime, visit_occurrence_id rows unbounded preceding) as varchar) session_id
        from v_gap""",
    "v_gap_max": f"""select *, {_exact_days('max(visit_end_datetime) over w', 'visit_start_datetime')} delta
        from v_fixed window w as (partition by person_id order by visit_start_datetime, visit_occurrence_id
            rows between unbounded preceding and 1 preceding)""",
    "v_type": """select person_id, session_id, visit_source_value t,
        min((visit_start_datetime, visit_occurrence_id)) k from v_numbered group by 1,2,3""",
    "v_types": """select person_id, session_id, string_agg(t, ' ' order by k) visit_source_value from v_type group by 1,2""",
    "v_session": """select person_id, session_id,
        arg_min(admitted_from_source_value, (visit_start_datetime, visit_occurrence_id)) admitted_from_source_value,
        any_value(s.visit_source_value) visit_source_value,
        arg_min(care_site_id, (visit_start_datetime, visit_occurrence_id)) first_care_site_id,
        arg_max(care_site_id, (visit_start_datetime, visit_occurrence_id)) last_care_site_id,
        arg_max(discharge_to_source_value, (visit_start_datetime, visit_occurrence_id)) discharge_to_source_value,
        min(visit_start_datetime) visit_start_datetime, max(visit_end_datetime) visit_end_datetime,
        count(*) number_of_stays,
        contains(any_value(s.visit_source_value), 'hospitalisés') is_complete_hospitalized
        from v_numbered join v_types s using (person_id, session_id) group by 1,2""",
    "v_adult": f"""select s.*, p.death_datetime from v_session s join v_person p using (person_id)
        where person_id in (select s2.person_id from v_session s2 join v_person p2 using (person_id)
            where {_days('p2.birth_datetime', 's2.visit_start_datetime')}/365.0::double >= 18)""",
    "v_followed": f"select * from v_adult where visit_end_datetime + interval 90 day < {END}",
    "v_alive": "select * from v_followed where not coalesce(death_datetime<=visit_end_datetime, false)",
    "v_coded": """select * from v_alive s where exists (select 1 from v_condition c where c.person_id=s.person_id
        and c.condition_start_datetime between s.visit_start_datetime and s.visit_end_datetime)""",
    "v_count": "select person_id, count(distinct session_id) n from v_coded group by 1",
    "v_usual": """select s.* from v_coded s join v_count using (person_id)
        where n <= (select quantile_cont(n, 0.95) from v_count) and n >= 1""",
    "v_population": """select person_id, session_id, visit_source_value inclusion_event_source_concept_id,
        visit_start_datetime inclusion_event_start, visit_end_datetime followup_start, discharge_to_source_value,
        admitted_from_source_value, is_complete_hospitalized, first_care_site_id, last_care_site_id, number_of_stays
        from v_usual qualify row_number() over (partition by person_id order by md5(session_id||':0'), session_id)=1""",
    "v_funnel": f"""select person_id, max(step) last_step from (
        select person_id, 0 step from v_person union all select person_id, 1 from v_hospital
        union all select person_id, 2 from v_session
        union all select person_id, 3 from v_adult union all select person_id, 4 from v_followed
        union all select person_id, 5 from v_alive union all select person_id, 6 from v_coded
        union all select person_id, 7 from v_count where n <= (select quantile_cont(n, 0.95) from v_count)
        union all select person_id, 8 from v_usual) group by 1""",
    "v_class": f"""select c.*, m.label as category from v_condition c join {CLASSES}
        on regexp_matches(c.condition_source_value, m.pattern)""",
    "v_mace_event": f"""select c.*, p.followup_start from v_class c join v_population p using (person_id)
        where {_exact_days('followup_start', 'condition_start_datetime')} <= 360""",
    "v_mace": """select p.*, coalesce(t.y, 0) y, t.target_condition_datetime, t.visit_occurrence_id,
        t.category, t.visit_start_datetime
        from v_population p left join (
            select 1 y, e.person_id, e.condition_start_datetime target_condition_datetime, e.visit_occurrence_id,
                e.category, v.visit_start_datetime
            from (select * from v_mace_event where condition_start_datetime > followup_start
                qualify row_number() over (partition by person_id
                    order by condition_start_datetime, visit_occurrence_id, category)=1) e
            join v_visit v on v.visit_occurrence_id=e.visit_occurrence_id) t using (person_id)
        where person_id not in (select person_id from v_mace_event where condition_start_datetime<=followup_start)""",
    "v_diagnosis": f"""select distinct c.person_id, c.visit_occurrence_id, c.condition_source_value
        from v_condition c join v_population p using (person_id)
        where c.condition_start_datetime >= inclusion_event_start and c.condition_start_datetime <= {END}""",
    "v_coded_visit": """select d.person_id, d.visit_occurrence_id, v.visit_start_datetime,
        row_number() over (partition by d.person_id order by v.visit_start_datetime, d.visit_occurrence_id) ix,
        count(*) over (partition by d.person_id) nb
        from (select distinct person_id, visit_occurrence_id from v_diagnosis) d
        join v_visit v on v.visit_occurrence_id=d.visit_occurrence_id""",
    "v_observed": """select e.person_id, e.visit_occurrence_id, e.start, e.code event_source_concept_id,
        p.followup_start, e.source event_source_type_concept_id from (
            select person_id, visit_occurrence_id, start, p_brand code, 'procedure_occurrence' source
                from v_line join part on l_partkey=p_partkey where l_returnflag='R'
            union all select person_id, visit_occurrence_id, start, p_type, 'drug_exposure_administration'
                from v_line join part on l_partkey=p_partkey where l_returnflag='A'
            union all select person_id, visit_occurrence_id, condition_start_datetime, condition_source_value,
                'condition_occurrence' from v_condition) e
        join v_population p using (person_id) where e.start <= p.followup_start""",
    "v_vocabulary": """select event_source_concept_id, count(*) n_events from v_observed group by 1 having count(*)>=10""",
    "v_event": "select * from v_observed where event_source_concept_id in (select event_source_concept_id from v_vocabulary)",
    # the event cohort of the MACE target: its persons, and a vocabulary of their events
    "v_mace_observed": "select * from v_observed where person_id in (select person_id from v_mace)",
    "v_mace_cohort_event": """select * from v_mace_observed where event_source_concept_id in (
        select event_source_concept_id from v_mace_observed group by 1 having count(*)>=10)""",
    "v_mace_cohort_person": "select * from v_mace where person_id in (select person_id from v_mace_cohort_event)",
    "v_split": f"""select person_id, coalesce(cast(first_care_site_id as varchar),'unknown') hospital_split,
        case when epoch_us(inclusion_event_start) <= (select epoch_us(min(inclusion_event_start))
            + cast(round({_days('min(inclusion_event_start)', 'max(inclusion_event_start)')}*0.8::double*{DAY}) as bigint)
            from v_population) then 'train' else 'external_test' end dataset from v_population""",
    "v_prognosis_split": f"""select person_id,
        case when epoch_us(inclusion_event_start) <= (select epoch_us(min(inclusion_event_start))
            + cast(round({_days('min(inclusion_event_start)', 'max(inclusion_event_start)')}*0.8::double*{DAY}) as bigint)
            from v_population where person_id in (select person_id from v_prognosis)) then 'train' else 'external_test' end dataset
        from v_population where person_id in (select person_id from v_prognosis)""",
    "v_past": """select e.* from v_prognosis_event e where event_source_type_concept_id='condition_occurrence'""",
    "v_run": f"""select event_id run_id, ts time_stamp,
        case event_type when 'click' then 'ridge' when 'view' then 'random_forests'
            when 'purchase' then 'hist_gradient_boosting' else event_type end estimator,
        case user_id%3 when 0 then 'Count Encoding' when 1 then 'Embeddings' else 'Demographics' end featurizer,
        cast(event_id%5 as int) splitting_rs,
        case event_id%4 when 0 then 0 when 1 then 3 when 2 then 6 else 4 end n_demographics,
        (1+user_id%3)*1000 n_person_subtrain, value compute_time,
        case event_id%3 when 0 then '[0]' when 1 then '[0, 1]' else '[0, 5]' end decay,
        {_run_scores}, {_run_prevalences} from events""",
    "v_run_long": " union all ".join(
        f"select run_id, splitting_rs, estimator, featurizer, n_person_subtrain, '{c}' target_label, "
        f"test_prevalence_{c} run_prevalence, "
        + ", ".join(f"c_{c}__score_{m} as {m}" for m in RUN_METRICS) + " from v_run"
        for c in RUN_CLASSES
    ),
    "v_run_prevalence": "select target_label, avg(run_prevalence) prevalence from v_run_long group by 1",
    "v_score": """select l_linestatus class, case when l_returnflag='R' then 1 else 0 end y,
        ((l_orderkey*37+l_linenumber*11)%1009)/1008.0::double p from lineitem""",
    "v_cell": """select person_id, cast(epoch_us(date_trunc('day', start))//86400000000 as bigint) d,
        event_source_concept_id code, count(*) n from v_observed group by 1,2,3""",
    "v_cooc": """select a.code, b.code context,
        cast(sum(case when a.code=b.code and a.d=b.d then a.n*(a.n-1) else a.n*b.n end) as bigint) n_pairs
        from v_cell a join v_cell b on a.person_id=b.person_id and abs(a.d-b.d)<=30 group by 1,2
        having sum(case when a.code=b.code and a.d=b.d then a.n*(a.n-1) else a.n*b.n end)>0""",
    "v_weight": f"""select person_id, event_source_concept_id, count(*) n_events, cast(count(*) as double) decay_0,
        sum(exp(-{_exact_days('start', 'followup_start')}/1.0)) decay_1,
        sum(exp(-{_exact_days('start', 'followup_start')}/30.0)) decay_30 from v_observed group by 1,2""",
}


def _prognosis(seed: int, label: str, min_prevalence: float, source: str) -> str:
    return f"""select v.visit_occurrence_id outcome_visit_occurence_stay_id, v.person_id,
        v.visit_start_datetime - interval 1 second followup_start, v.nb nb_coded_visits, v.ix target_visit_ix,
        l.labels from (select * from v_coded_visit where nb>1 and ix>1
            qualify row_number() over (partition by person_id
                order by md5(cast(visit_occurrence_id as varchar)||':{seed}'), visit_occurrence_id)=1) v
        join (select visit_occurrence_id, list_sort(list(label)) labels from {source} where label in (
            select label from {source} group by 1 having count(*)/(select count(*) from (
                select 1 from v_coded_visit where nb>1 and ix>1 group by person_id)) >= {min_prevalence})
            group by 1) l using (visit_occurrence_id)"""


FRAGMENTS["v_target_visit"] = """select * from v_coded_visit where nb>1 and ix>1 qualify row_number() over (
    partition by person_id order by md5(cast(visit_occurrence_id as varchar)||':0'), visit_occurrence_id)=1"""
FRAGMENTS["v_target_visit_1"] = FRAGMENTS["v_target_visit"].replace("':0'", "':1'")
FRAGMENTS["v_chapter_label"] = """select distinct visit_occurrence_id, concept_chapter label
    from v_diagnosis join v_tree on concept_code=substr(condition_source_value,1,4)
    where visit_occurrence_id in (select visit_occurrence_id from v_target_visit)"""
FRAGMENTS["v_prefix_label"] = """select distinct visit_occurrence_id, substr(condition_source_value,1,3) label
    from v_diagnosis where visit_occurrence_id in (select visit_occurrence_id from v_target_visit_1)"""
FRAGMENTS["v_prognosis"] = _prognosis(0, "chapter", 0.01, "v_chapter_label")
FRAGMENTS["v_prognosis_prefix"] = _prognosis(1, "prefix", 0.005, "v_prefix_label")
FRAGMENTS["v_all_event"] = """select person_id, visit_occurrence_id, start, p_brand code, 'procedure_occurrence' source
        from v_line join part on l_partkey=p_partkey where l_returnflag='R'
    union all select person_id, visit_occurrence_id, start, p_type, 'drug_exposure_administration'
        from v_line join part on l_partkey=p_partkey where l_returnflag='A'
    union all select person_id, visit_occurrence_id, condition_start_datetime, condition_source_value,
        'condition_occurrence' from v_condition"""
FRAGMENTS["v_observed"] = """select e.person_id, e.visit_occurrence_id, e.start, e.code event_source_concept_id,
    p.followup_start, e.source event_source_type_concept_id
    from v_all_event e join v_population p using (person_id) where e.start <= p.followup_start"""
FRAGMENTS["v_prognosis_event"] = """select e.person_id, e.visit_occurrence_id, e.start, e.code event_source_concept_id,
    p.followup_start, e.source event_source_type_concept_id
    from v_all_event e join v_prognosis p using (person_id) where e.start <= p.followup_start
    and not coalesce(e.visit_occurrence_id = p.outcome_visit_occurence_stay_id, false)"""


def _naive(past: str) -> str:
    return f"""select p.person_id, coalesce(c.chapters,
        [cast(('0x'||substr(md5(cast(p.person_id as varchar)||':0'),1,8))::bigint%21+1 as varchar)]) y_pred
        from v_prognosis p left join (select person_id, list_sort(list(distinct concept_chapter)) chapters
            from {past} join v_tree on concept_code=substr(event_source_concept_id,1,4) group by 1) c using (person_id)"""


FRAGMENTS["v_naive"] = _naive("v_past")
FRAGMENTS["v_last_past"] = """select * from v_past where (person_id, visit_occurrence_id) in (
    select person_id, arg_max(visit_occurrence_id, (start, visit_occurrence_id)) from v_past group by 1)"""
FRAGMENTS["v_naive_last"] = _naive("v_last_past")
FRAGMENTS["v_rehosp"] = """select p.person_id, v.visit_occurrence_id rid, v.visit_start_datetime rdt, p.followup_start
    from v_visit v join v_population p using (person_id)
    where v.visit_source_value in ('hospitalisés','hospitalisation incomplète')
    and v.visit_start_datetime >= p.followup_start + interval 12 hour
    qualify row_number() over (partition by p.person_id order by v.visit_start_datetime, v.visit_occurrence_id)=1"""
FRAGMENTS["v_hospital_count"] = f"""select person_id, hospital_name, count(*) n
    from v_visit join v_care_site using (care_site_id)
    where visit_start_datetime between {START} and {END} and person_id in (select person_id from v_population) group by 1,2"""


def _scores(by: str) -> str:
    key = f"{by}," if by else ""
    part = f"partition by {by}" if by else ""
    group = f"group by {by}" if by else ""
    return f"""select {('s.' + by + ',') if by else ''} brier_score_loss, roc_auc_score, accuracy_score, average_precision_score, tn, fp, fn, tp
    from (select {key} round(avg((p-y)*(p-y)),6) brier_score_loss,
            round(avg(case when (y=1)=(p>0.5) then 1.0::double else 0.0::double end),6) accuracy_score,
            count(*) filter (y=0 and p<=0.5) tn, count(*) filter (y=0 and p>0.5) fp,
            count(*) filter (y=1 and p<=0.5) fn, count(*) filter (y=1 and p>0.5) tp
        from v_score {group}) s
    {'join' if by else ','} (select {key} round(sum(pos*(negb+neg/2.0::double))/(max(np)*max(nn)),6) roc_auc_score,
            round(sum(pos/np*(np-posb)/(np-posb+nn-negb)),6) average_precision_score
        from (select {key} pos, neg,
                coalesce(sum(pos) over (w rows between unbounded preceding and 1 preceding),0)::double posb,
                coalesce(sum(neg) over (w rows between unbounded preceding and 1 preceding),0)::double negb,
                (sum(pos) over ({part}))::double np, (sum(neg) over ({part}))::double nn
            from (select {key} p, count(*) filter (y=1)::double pos, count(*) filter (y=0)::double neg
                from v_score group by {key} p) window w as ({part} order by p)) {group}) r {f'using ({by})' if by else ''}"""


def _sample(source: str, size: str, seed: int, columns: str = "person_id", extra: str = "") -> str:
    return f"""select {columns} from {source} {extra} qualify row_number() over (
        order by md5(cast(person_id as varchar)||':{seed}'), person_id) <= {size}"""


def _subsample(size: float, ratio: str) -> str:
    return f"""select person_id, y from v_mace qualify row_number() over (partition by y
        order by md5(cast(person_id as varchar)||':3'), person_id) <=
        case when y=1 then least(floor({size}::double*{ratio}*(select count(*) from v_mace)), (select sum(y) from v_mace))
        else floor({size}::double*(1-{ratio})*(select count(*) from v_mace)) end"""


def _signs(n: int, seed: int) -> str:
    return " union all ".join(
        f"select person_id, {i} dimension, round(sum(decay_30 * case when "
        f"substr(md5(event_source_concept_id||':{seed}:{i // 32}'),{i % 32 + 1},1)>='8' then 1 else -1 end)"
        f"*pow({n}::double,-0.5),6) as value from v_weight group by 1"
        for i in range(n)
    )


_bins = " ".join(
    f"when prevalence<={high} then '{low}-{high}'" for low, high in zip(PREVALENCE_BINS, PREVALENCE_BINS[1:])
)
_concepts = " ".join(f"when '{k}' then {v}" for k, v in VISIT_CONCEPTS.items())
_quantiles = ", ".join(f"round(quantile_cont(n,{p}),6) p{round(100 * p)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
_chapter_columns = ", ".join(f"cast(list_contains(y_pred,'{c}') as int) c_{c}" for c in range(1, 23))
_events = "person_id, visit_occurrence_id, start, event_source_concept_id"
_population_visit = "person_id, session_id, visit_start_datetime"

BODIES = {
    "scan_omop": "select c_custkey, c_nationkey, c_mktsegment from customer",
    "i2b2_to_omop": """select user_id person_id, event_id visit_occurrence_id, ts start,
        event_type drug_class_source_value from events where event_type<>'error'""",
    "reconstruct_birth": """select person_id, birth birth_datetime, gender_source_value from v_person join (
        select person_id, visit_start_datetime - to_days(cast((216+visit_occurrence_id%600)*30 as int)) birth
        from v_visit qualify row_number() over (partition by person_id
            order by visit_start_datetime, 216+visit_occurrence_id%600)=1) using (person_id)""",
    "clean_dates": "select l_orderkey, l_linenumber, l_quantity from lineitem",
    "force_datetime": """select event_id, case when event_id%10<>0 then date_trunc('second', ts) end as start from events""",
    "export_pretrain": f"""select visit_occurrence_id, person_id,
        strftime(visit_start_datetime,'%Y-%m-%d %H:%M:%S') visit_start_datetime,
        strftime(visit_end_datetime,'%Y-%m-%d %H:%M:%S') visit_end_datetime, visit_source_value, care_site_id,
        admitted_from_source_value, discharge_to_source_value,
        cast(case visit_source_value {_concepts} end as int) visit_concept_id
        from v_visit where person_id in (select person_id from v_split where dataset='train')""",
    "cohort_round_trip": f"select {_events}, event_source_type_concept_id from v_mace_cohort_event",
    "cohort_by_person": """select e.person_id, e.visit_occurrence_id, e.start, e.event_source_concept_id,
        e.event_source_type_concept_id, p.followup_start
        from v_mace_cohort_event e join v_mace_cohort_person p using (person_id)
        where e.event_source_type_concept_id in ('condition_occurrence','procedure_occurrence')""",
    "read_dimension": """select lpad(cast(care_site_id as varchar),3,'0') care_site_code, n_name as name, count(*) n_visits
        from v_visit join nation on n_nationkey=care_site_id group by 1,2""",
    "read_run_logs": """select run_id, estimator, round(case when run_id%2=0 then compute_time end,6) compute_time,
        case when run_id%2=1 then splitting_rs end splitting_rs from v_run""",
    "collect_external_runs": """select run_id, target_label target, '50' train_share, 'external' estimator,
        round(p.prevalence,6) prevalence, round(roc_auc_score,6) roc_auc_score,
        round(average_precision_score,6) pr_auc from v_run_long join v_run_prevalence p using (target_label)""",
    "sample_non_cases": """select person_id, y, n_events from (
        select person_id, y from v_mace_cohort_person join v_split using (person_id) where dataset='external_test' or y=1
        union all (select person_id, y from v_mace_cohort_person join v_split using (person_id)
            where dataset<>'external_test' and y=0
            qualify row_number() over (order by md5(cast(person_id as varchar)||':0'), person_id) <= 200))
        join (select person_id, count(*) n_events from v_mace_cohort_event group by 1) using (person_id)""",
    "visits_of_type": """select visit_occurrence_id, visit_source_value from v_visit
        where visit_source_value in ('hospitalisés','hospitalisation incomplète')""",
    "visits_in_period": f"""select visit_occurrence_id, visit_start_datetime from v_visit
        where visit_start_datetime between {START} and {END}""",
    "recover_visit_end": """select visit_occurrence_id, person_id, coalesce(visit_end_datetime, recovered) visit_end_datetime
        from v_visit left join v_rss using (visit_occurrence_id) where coalesce(visit_end_datetime, recovered) is not null""",
    "fix_visit_end": """select visit_occurrence_id, visit_start_datetime,
        case when visit_source_value='hospitalisation incomplète' then visit_start_datetime + interval 1 day
        else visit_end_datetime end visit_end_datetime from v_visit""",
    "sessionize": """select person_id, visit_occurrence_id, session_id, new_session_mark,
        round(delta,6) delta_previous_visit from v_numbered""",
    "sessionize_running_max": """select person_id, visit_occurrence_id, coalesce(delta>=1, false) new_session_mark,
        cast(person_id as varchar)||'_'||cast(sum(case when delta>=1 then 1 else 0 end) over (partition by person_id
            order by visit_start_datetime, visit_occurrence_id rows unbounded preceding) as varchar) session_id,
        round(delta,6) delta_previous_visit from v_gap_max""",
    "merge_sessions": "select * from v_session",
    "adult_sessions": f"""select person_id, session_id, visit_start_datetime, death_datetime
        from v_session join v_person using (person_id)
        where {_days('birth_datetime', 'visit_start_datetime')}/365.0::double >= 18""",
    "adults": "select person_id, session_id, death_datetime from v_adult",
    "enough_horizon": f"""select person_id, session_id, visit_end_datetime from v_session
        where visit_end_datetime + interval 90 day < {END}""",
    "alive_at_discharge": """select person_id, session_id, visit_end_datetime, death_datetime
        from v_session join v_person using (person_id) where not coalesce(death_datetime<=visit_end_datetime, false)""",
    "sessions_with_billing": f"""select {_population_visit}, visit_end_datetime from v_session s where exists (
        select 1 from v_condition c where c.person_id=s.person_id
        and c.condition_start_datetime between s.visit_start_datetime and s.visit_end_datetime)""",
    "trim_outliers": """with c as (select person_id, count(distinct session_id) n from v_session group by 1)
        select s.person_id, session_id from v_session s join c using (person_id)
        where n<=(select quantile_cont(n,0.95) from c) and n>=2""",
    "index_visit": f"""select 'first' kind, {_population_visit} from v_session
            qualify row_number() over (partition by person_id order by visit_start_datetime, session_id)=1
        union all select 'last', {_population_visit} from v_session
            qualify row_number() over (partition by person_id order by visit_start_datetime desc, session_id desc)=1
        union all select 'random', {_population_visit} from v_session
            qualify row_number() over (partition by person_id order by md5(session_id||':0'), session_id)=1""",
    "select_population": "select * from v_population",
    "inclusion_funnel": """with s(step, criterion) as (values (0,'initial'),
            (1,'No Hospitalization + incomplete hospitalization during 1996-01-01 / 2001-01-01'),
            (2,'Without a visit_end_datetime'), (3,'Aged below 18'),
            (4,'Insufficient horizon (90 days) after discharge'),
            (5,'Deceased before the end of their inclusion stay'),
            (6,'Stays without associated billing codes'), (7,'More than the 0.95 quantile of stays'),
            (8,'Less than 1 stays')),
        k as (select step, criterion, (select count(*) from v_funnel where last_step>=step) n_kept from s)
        select step, criterion, n_kept, coalesce(lag(n_kept) over (order by step)-n_kept,0) n_excluded from k""",
    "funnel_of_ids": """with m as (select person_id,
            person_id in (select person_id from v_hospital) h, person_id in (select person_id from v_condition) c,
            person_id in (select person_id from v_population) s from v_person),
        k(step, criterion, n_kept) as (select 0, 'persons', (select count(*) from m)
            union all select 1, 'hospitalized', (select count(*) from m where h)
            union all select 2, 'diagnosed', (select count(*) from m where h and c)
            union all select 3, 'selected', (select count(*) from m where h and c and s))
        select step, criterion, n_kept, coalesce(lag(n_kept) over (order by step)-n_kept,0) n_excluded from k""",
    "funnel_characteristics": """select last_step+1 step, count(*) n_excluded,
        round(avg(case when gender_source_value='f' then 1.0::double else 0 end),6) female,
        round(avg(case when death_datetime is not null then 1.0::double else 0 end),6) deceased
        from v_funnel join v_person using (person_id) where last_step<(select max(last_step) from v_funnel) group by 1""",
    "final_split": """select case when s.person_id is not null then 'left' else 'right' end side, count(*) n_persons
        from v_funnel f left join (select person_id from v_split where dataset='train') s on s.person_id=f.person_id
        where last_step>=8 group by 1""",
    "los": f"""with s as (select person_id, {_days('inclusion_event_start', 'followup_start')} length_of_stay from v_population)
        select *, case when length_of_stay<0 then 'nan' when length_of_stay<=7 then '[0.0, 7.0]'
        when length_of_stay<=14 then '(7.0, 14.0]' else '(14.0, inf]' end length_of_stay_category from s""",
    "los_target": f"""select person_id, case when d<=7 then '[0.0, 7.0]' else '(7.0, inf]' end length_of_stay_category,
        cast(case when d<=7 then 1 else 0 end as int) y
        from (select person_id, {_days('inclusion_event_start', 'followup_start')} d from v_population)""",
    "first_slice": f"""select person_id, session_id, visit_start_datetime inclusion_event_start,
        visit_end_datetime followup_start, {_days('visit_start_datetime', 'visit_end_datetime')} length_of_stay,
        cast(case when {_days('visit_start_datetime', 'visit_end_datetime')}<=7 then 1 else 0 end as int) y from v_session
        qualify row_number() over (partition by person_id order by visit_start_datetime, session_id)=1""",
    "rehospitalization": """select p.person_id, coalesce(rid,0) rehospitalization_id, rdt rehospitalization_datetime
        from v_population p left join (select * from v_rehosp where rdt <= followup_start + interval 30 day) r
        using (person_id)""",
    "mortality": """select person_id, case when v_person.death_datetime <= followup_start + interval 360 day
        then v_person.death_datetime end as "death_datetime@horizon" from v_population join v_person using (person_id)""",
    "mace": """select person_id, session_id, cast(y as int) y, target_condition_datetime, visit_occurrence_id,
        category as "ICD10 category", visit_start_datetime from v_mace""",
    "prognosis": "select * replace (array_to_string(labels,',') as labels) from v_prognosis",
    "prognosis_prefix": "select * replace (array_to_string(labels,',') as labels) from v_prognosis_prefix",
    "target_chapter": "select person_id, cast(list_contains(labels,'9') as int) y from v_prognosis",
    "code_classes": """select person_id, visit_occurrence_id, condition_start_datetime, condition_source_value,
        category as "ICD10 category" from v_class""",
    "code_dictionary": """with p as (select concept_code as pattern, concept_chapter c from v_tree
            union select substr(concept_code,1,3), concept_chapter from v_tree),
        d as (select distinct condition_source_value code from v_condition),
        m as (select distinct code, c from d join p on contains(code, pattern))
        select person_id, visit_occurrence_id, condition_start_datetime, condition_source_value, c as "ICD10 category"
        from v_condition join m on code=condition_source_value""",
    "icd_chapter": """select person_id, visit_occurrence_id, substr(condition_source_value,1,4) condition_source_value,
        concept_chapter condition_source_value_coarse from v_condition
        left join v_tree on concept_code=substr(condition_source_value,1,4)""",
    "icd_unmatched": """select count(*) filter (concept_chapter is null) n_unmatched,
        round(avg(case when concept_chapter is null then 1.0::double else 0 end),6) unmatched_ratio
        from v_condition left join v_tree on concept_code=substr(condition_source_value,1,4)""",
    "icd_prefix": "select substr(condition_source_value,1,3) prefix, count(*) n from v_condition group by 1",
    "naive_baseline": "select person_id, array_to_string(y_pred,',') y_pred from v_naive",
    "naive_last_visit": "select person_id, array_to_string(y_pred,',') y_pred from v_naive_last",
    "naive_scores": f"""select person_id, class, cast(list_contains(y_pred,class) as int) score
        from v_naive, {CHAPTER_VALUES}""",
    "last_diagnosis_features": f"select person_id, {_chapter_columns} from v_naive",
    "event_cohort": "select * from v_event",
    "event_cohort_persons": """select person_id, session_id from v_population
        where person_id in (select person_id from v_event)""",
    "code_mapping": """select e.person_id, e.visit_occurrence_id, e.measurement_datetime as start,
        m.target_concept_id event_source_concept_id, p.followup_start, 'measurement' event_source_type_concept_id
        from v_measurement e join v_mapping m on m.event_source_concept_id=e.measurement_source_value
        join v_population p on p.person_id=e.person_id where e.measurement_datetime<=p.followup_start""",
    "drop_outcome_visit_events": "select * from v_prognosis_event",
    "add_statics": """select person_id, birth_datetime, gender_source_value, session_id, inclusion_event_start
        from v_population join v_person using (person_id)""",
    "slice_cohort": f"""select {_events} from v_mace_cohort_event
        where person_id in (select person_id from v_person where gender_source_value='f')""",
    "cohort_counts": """select (select count(*) from v_mace_cohort_person) n_persons,
        (select count(*) from v_mace_cohort_event) n_events""",
    "vocabulary": "select * from v_vocabulary",
    "embedding_vocabulary": f"""select {_events} from v_observed
        where event_source_concept_id in (select event_source_concept_id from v_embedding)""",
    "vocabulary_sweep": """with c as (select count(*) n from v_observed group by event_source_concept_id)
        select cast(t as int) n_min_events, (select count(*) from c where n>=t) n_codes
        from (values (10),(20),(50),(100)) as x(t)""",
    "vocabulary_provenance": "select distinct event_source_concept_id, event_source_type_concept_id from v_event",
    "map_visit_concept": f"""select visit_occurrence_id, visit_source_value,
        cast(case visit_source_value {_concepts} end as int) visit_concept_id from v_visit""",
    "vocabulary_bridge": f"""with c as (select p_partkey concept_id, p_partkey%3 kind,
            {_plain('p_partkey')} code from part),
        r as (select p_partkey concept_id, (p_partkey//12)*12+2 standard from part where p_partkey%5<>0)
        select distinct 'C'||cast(s_suppkey as varchar) concept, b.code target_code from supplier
        join c a on a.kind=0 and a.code=substr({_plain('(s_suppkey*3)')},1,5)
        join r ra on ra.concept_id=a.concept_id
        join r rb on rb.standard=ra.standard join c b on b.concept_id=rb.concept_id and b.kind=1""",
    "collapse_mapping": "select * from v_mapping",
    "mapping_coverage": """with v as (select distinct event_source_concept_id c, event_source_type_concept_id from v_observed)
        select event_source_type_concept_id, count(*) n_codes, count(e) n_mapped,
        round(count(e)/count(*)::double,6) coverage, round(1-count(e)/count(*)::double,6) lost
        from v left join (select distinct event_source_concept_id e from v_embedding) on c=e group by 1""",
    "merge_embeddings": """with u as (select substr(event_source_concept_id,1,2) code, vec_id,
            unnest(embedding) as x, generate_subscripts(embedding,1)-1 dimension from v_embedding)
        select 'mean' how, code, cast(dimension as int) dimension, round(avg(x),6) as value from u group by 2,3
        union all select 'first', code, cast(dimension as int), round(arg_min(x, vec_id),6) from u group by 2,3""",
    "split_hospital": """select person_id, arg_min(hospital_name, (-n, hospital_name)) hospital_split,
        case when bool_and(hospital_name='ASIA') then 'external_test' else 'train' end dataset
        from v_hospital_count group by 1 having bool_or(hospital_name='ASIA')=bool_and(hospital_name='ASIA')""",
    "split_temporal": "select * from v_split",
    "subsample": _subsample(0.5, "((select sum(y) from v_mace)/(select count(*) from v_mace)::double)"),
    "subsample_ratio": _subsample(0.4, "0.5::double"),
    "sample_n": _sample("v_person", "500", 1),
    "person_split": """select person_id, case when row_number() over (
        order by md5(cast(person_id as varchar)||':2'), person_id) <= floor((select count(*) from v_person)*0.7::double)
        then 'train' else 'test' end part from v_person""",
    "event_split": """with s as (select person_id, case when row_number() over (
            order by md5(cast(person_id as varchar)||':5'), person_id)
            <= count(*) over () - ceil(count(*) over ()*0.3::double) then 'train' else 'test' end part from v_mace_cohort_person)
        select person_id, count(*) n_events, part from v_mace_cohort_event join s using (person_id) group by 1,3""",
    "group_folds": """with recursive g as (select coalesce(cast(first_care_site_id as varchar),'unknown') h,
            count(*) n from v_population group by 1),
        o as (select *, row_number() over (order by n desc, h) i from g),
        a(i, h, fold, loads) as (
            select cast(0 as bigint), '', -1, [0,0,0,0,0]::bigint[]
            union all select o.i, o.h, list_position(loads, list_min(loads))-1,
                list_transform([1,2,3,4,5], lambda j: loads[j] + case when j=list_position(loads, list_min(loads)) then o.n else 0 end)
            from a join o on o.i=a.i+1)
        select person_id, cast(first_care_site_id as varchar) first_care_site_id, cast(fold as int) fold
        from v_population join a on h=cast(first_care_site_id as varchar)""",
    "class_weights": """with r as (select avg(y::double) p from v_mace)
        select person_id, 'prevalence' kind, round(case when y=1 then p else 1-p end,6) weight from v_mace, r
        union all select person_id, 'balanced', round(case when y=1 then 0.5/p else 0.5/(1-p) end,6) from v_mace, r""",
    "count_features": "select person_id, event_source_concept_id, n_events from v_weight",
    "decayed_features": """select person_id, event_source_concept_id, round(decay_0,6) decay_0,
        round(decay_1,6) decay_1, round(decay_30,6) decay_30 from v_weight""",
    "embedding_features": """with u as (select event_source_concept_id, unnest(embedding) as x,
            generate_subscripts(embedding,1)-1 k from v_embedding)
        select person_id, cast(k as int) dimension, round(sum(decay_0*x),6) as value
            from v_weight join u using (event_source_concept_id) group by 1,2
        union all select person_id, cast(k+64 as int), round(sum(decay_30*x),6)
            from v_weight join u using (event_source_concept_id) group by 1,2""",
    "random_projection": _signs(40, 7),
    "demographics_features": f"""with s as (select p.*, v.gender_source_value,
            {_days('v.birth_datetime', 'p.inclusion_event_start')}/365.0::double age
            from v_population p join v_person v using (person_id)),
        c as (select person_id, 1 o, admitted_from_source_value x from s
            union all select person_id, 2, discharge_to_source_value from s
            union all select person_id, 3, gender_source_value from s
            union all select person_id, 4, inclusion_event_source_concept_id from s),
        d as (select o, x, row_number() over (order by o, x)-1 dimension from (select distinct o, x from c))
        select s.person_id, cast(d.dimension as int) dimension,
            round(case when c.person_id is null then 0.0::double else 1.0::double end,6) as value
        from s cross join d left join c on c.person_id=s.person_id and c.o=d.o and c.x=d.x
        union all select person_id, cast((select count(*) from d) as int),
            round((age-(select avg(age) from s))/(select stddev_samp(age) from s),6) from s""",
    "count_vectors": """with c as (select event_source_concept_id, row_number() over (order by event_source_concept_id)-1 ix,
            count(*) over () size, sum(decay_0) a, sum(decay_30) b from v_weight group by 1)
        select cast(ix as int) as position, round(a,6) as value from c
        union all select cast(ix+size as int), round(b,6) from c""",
    "sparsity": """select count(*) n_values, count(distinct person_id) n_persons,
        count(distinct event_source_concept_id) n_codes,
        round(1-count(*)/(count(distinct person_id)*count(distinct event_source_concept_id))::double,6) sparsity from v_weight""",
    "cooccurrence": "select * from v_cooc",
    "ppmi": """with a as (select code, sum(n_pairs)::double n from v_cooc group by 1),
        b as (select context, pow(sum(n_pairs)::double,0.75) w from v_cooc group by 1),
        t as (select sum(n_pairs)::double n from v_cooc), tb as (select sum(w) w from b)
        select code, context, round(v,6) ppmi from (select c.code, c.context,
            ln((c.n_pairs/t.n)/((a.n/t.n)*(b.w/tb.w))) v
            from v_cooc c join a on a.code=c.code join b on b.context=c.context, t, tb) where v>0""",
    "nearest_codes": """select code, source_code, round(similarity,6) similarity, cast(rank as int) rank,
        'Concept '||cast(label as varchar) concept_name from (
        select e.event_source_concept_id code, s.event_source_concept_id source_code, e.label,
            list_cosine_similarity(e.embedding, s.embedding) similarity,
            row_number() over (partition by s.event_source_concept_id
                order by round(list_cosine_similarity(e.embedding, s.embedding),9) desc, e.event_source_concept_id) rank
        from v_embedding e, v_embedding s where s.event_source_concept_id in ('A000','B011','C022','D033','E044')
        and e.event_source_concept_id<>s.event_source_concept_id) where rank<=10""",
    "nearest_codes_all": """select source_code, code, round(similarity,6) similarity, cast(rank as int) rank from (
        select e.event_source_concept_id code, s.event_source_concept_id source_code,
            round(list_cosine_similarity(e.embedding, s.embedding),9) similarity,
            row_number() over (partition by s.event_source_concept_id
                order by round(list_cosine_similarity(e.embedding, s.embedding),9) desc, e.event_source_concept_id) rank
        from v_embedding e, v_embedding s where e.event_source_concept_id<>s.event_source_concept_id) where rank<=10""",
    "add_age": f"""select person_id,
        round({_days('birth_datetime', "timestamp '2000-01-01 12:00:00'")}/365.0::double,6) age_in_2000,
        round({_days('birth_datetime', 'death_datetime')}/365.0::double,6) age_to_death_datetime from v_person""",
    "date_details": """select visit_occurrence_id, cast(month(visit_start_datetime) as int) inclusion_month,
        cast(isodow(visit_start_datetime)-1 as int) inclusion_day_of_week,
        case when hour(visit_start_datetime) between 7 and 11 then 'morning'
        when hour(visit_start_datetime) between 12 and 19 then 'afternoon' else 'night' end inclusion_time_of_day from v_visit""",
    "binarise_labels": f"""select person_id, class, cast(list_contains(labels,class) as int) present
        from v_prognosis, {CHAPTER_VALUES}""",
    "binary_scores": _scores(""),
    "multilabel_scores": _scores("class"),
    "prevalence": """select class, count(*) n_persons, round(100*count(*)/(select count(*) from v_prognosis)::double,6) prevalence,
        case class """ + " ".join(f"when '{k}' then '{v}'" for k, v in ICD10_CHAPTERS.items())
        + """ end as label from (select person_id, unnest(labels) as class from v_prognosis) group by class""",
    "clean_runs": f"""select run_id, {_case('estimator', MODEL_LABELS, 'estimator')} estimator_label,
        {_case('n_demographics', DEMOGRAPHIC_LABELS, 'cast(n_demographics as varchar)')} demographic_label,
        {_case('decay', DECAY_LABELS, 'decay')} decay_label,
        case featurizer when 'Embeddings' then 'Code embeddings' else featurizer end featurizer from v_run""",
    "runs_long": f"""select run_id, target_label, {_case('estimator', MODEL_LABELS, 'estimator')} estimator_label,
        {', '.join(f'round({m},6) {m}' for m in RUN_METRICS)} from v_run_long""",
    "weighted_metric": """select splitting_rs, estimator, featurizer, n_person_subtrain,
        round(avg(roc_auc_score),6) macro_roc_auc_score,
        round(avg(roc_auc_score*prevalence)/(select avg(prevalence) from v_run_prevalence),6) weighted_roc_auc_score
        from v_run_long join v_run_prevalence using (target_label) group by 1,2,3,4""",
    "prevalence_bins": f"""select prevalence_bin, count(distinct target_label) n_classes from (
        select target_label, case when prevalence<=0 then null {_bins} end prevalence_bin
        from (select target_label, run_prevalence prevalence from v_run_long))
        where prevalence_bin is not null group by 1""",
    "compute_time_summary": """select featurizer, estimator, round(avg(compute_time/21),6) mean_seconds,
        round(stddev_samp(compute_time/21),6) sd_seconds from v_run group by 1,2""",
    "top_prevalence": """select target_label as class, round(prevalence,6) prevalence from v_run_prevalence where prevalence>=10""",
    "run_durations": """select run_id, estimator, round((epoch_us(time_stamp)-epoch_us(lag(time_stamp) over (
        partition by estimator order by time_stamp, run_id)))/1e6,6) duration_seconds from v_run""",
    "training_history": """with s as (select user_id history, ts, event_id, value, sum(case when event_id%7=0 then 1 else 0 end)
            over (partition by user_id order by ts, event_id rows unbounded preceding)-1 seed from events),
        e as (select history, cast(seed as int) seed, cast(row_number() over (partition by history, seed
            order by ts, event_id)-1 as int) epoch, value from s)
        select history, seed, epoch, 'val_loss' dataset, round(value,6) epoch_loss from e
        union all select history, seed, epoch, 'loss', round(value/2,6) from e""",
    "events_per_month": """select cast(year(condition_start_datetime) as int) as year,
        cast(month(condition_start_datetime) as int) as month, count(*) as count from v_condition group by 1,2""",
    "absurd_months": """select cast(year(s) as int) as year, cast(month(s) as int) as month, count(*) as count
        from (select birth_datetime - to_years(cast(person_id%200 as int)) s from v_person)
        where year(s)<=1850 or year(s)>=2030 group by 1,2""",
    "temporal_heatmap": """with c as (select event_source_concept_id concept, cast(year(start) as int) as yr, count(*) n
            from v_observed group by 1,2),
        t as (select concept, sum(n) n from c group by 1 order by 2 desc, 1 limit 50)
        select t.concept, y.yr as year, coalesce(c.n,0) n_events from t cross join (select distinct yr from c) y
        left join c on c.concept=t.concept and c.yr=y.yr""",
    "monthly_normalised": """with c as (select dataset, cast(year(target_condition_datetime) as int) as year,
            cast(month(target_condition_datetime) as int) as month, count(*) as count
            from v_mace join v_split using (person_id) where target_condition_datetime is not null group by 1,2,3)
        select *, round(count/avg(count) over (partition by dataset),6) normalised from c""",
    "describe_cohort": f"""with p as (select c.*, v.gender_source_value,
            {_days('v.birth_datetime', 'c.inclusion_event_start')} age
            from v_mace_cohort_person c join v_person v using (person_id))
        select 'N' as key, count(*)::double as value from p
        union all select 'Median age', round(quantile_cont(age,0.5)/365.0::double,6) from p
        union all select 'Female', round(avg(case when gender_source_value='f' then 100.0::double else 0 end),6) from p
        union all select 'prevalence '||cast(y as varchar), round(100*count(*)/(select count(*) from p)::double,6) from p group by y
        union all select 'n_events', count(*)::double from v_mace_cohort_event
        union all select 'n_events '||event_source_type_concept_id, count(*)::double from v_mace_cohort_event
            group by event_source_type_concept_id""",
    "hospitals_per_patient": """select nb_unique_hospitals, count(*) n_patients from (
        select person_id, count(distinct hospital_name) nb_unique_hospitals
        from v_visit join v_care_site using (care_site_id) group by 1) group by 1""",
    "visits_with_hospital": "select visit_occurrence_id, care_site_id, hospital_name from v_visit join v_care_site using (care_site_id)",
    "missing_ratio": """select count(*) n_rows, count(*)-count(visit_end_datetime) n_missing,
        round((count(*)-count(visit_end_datetime))/count(*)::double,6) missing_ratio from v_visit""",
    "value_counts": """select visit_source_value, count(*) n, round(count(*)/(select count(*) from v_visit)::double,6) share
        from v_visit group by 1""",
    "details_per_visit": f"""with c as (select visit_occurrence_id, visit_source_value, count(distinct visit_detail_id) n
            from v_visit join v_movement using (visit_occurrence_id) group by 1,2)
        select visit_source_value, count(*) as count, round(avg(n),6) mean, round(stddev_samp(n),6) std, min(n) as min,
        {_quantiles}, max(n) as max from c group by 1""",
    "detail_consistency": """with f as (select visit_occurrence_id v, visit_detail_type_source_value k,
            visit_detail_start_datetime s, visit_detail_end_datetime e from v_movement
            qualify row_number() over (partition by 1, visit_occurrence_id, visit_detail_type_source_value
                order by visit_detail_start_datetime, visit_detail_end_datetime nulls first)=1)
        select count(*) n_visits, count(*) filter (a.s is distinct from b.s) n_inconsistent_start,
        count(*) filter (a.e is distinct from b.e) n_inconsistent_end
        from f a join f b on a.v=b.v and a.k='MOUV' and b.k='PASS'""",
    "delay_quantiles": f"""with d as (select dataset, {_exact_days('followup_start', 'target_condition_datetime')} x
            from v_mace join v_split using (person_id) where target_condition_datetime is not null)
        select dataset, count(*) n, round(avg(x),6) mean, round(quantile_cont(x,0.1),6) p10,
        round(quantile_cont(x,0.5),6) p50, round(quantile_cont(x,0.9),6) p90 from d group by 1""",
    "split_summary": """select dataset, count(*) n_persons, count(*) filter (y=1) n_cases,
        round(100*avg(y::double),6) prevalence, min(inclusion_event_start) first_inclusion,
        max(inclusion_event_start) last_inclusion from v_mace join v_split using (person_id) group by 1""",
    "leakage_checks": f"""select count(*) filter (target_condition_datetime<=followup_start) targets_before_followup,
        count(*) filter ({_exact_days('followup_start', 'target_condition_datetime')}>360) targets_after_horizon,
        (select count(*) filter (start>followup_start) from v_mace_cohort_event) events_after_followup,
        (select count(*) filter (start=followup_start) from v_mace_cohort_event) events_at_followup,
        (select count(*) from v_mace_cohort_event where (person_id, visit_occurrence_id) in (
            select person_id, visit_occurrence_id from v_mace_cohort_person where visit_occurrence_id is not null)) events_of_target_visit
        from v_mace_cohort_person""",
}

BODIES["fold_classes"] = (
    BODIES["group_folds"].replace("select person_id, cast(first_care_site_id as varchar) first_care_site_id, cast(fold as int) fold",
                                  "select cast(fold as int) fold, count(*) n_persons, count(*) filter (y=1) n_cases, count(distinct y)<2 one_class")
    .replace("v_population", "v_mace") + " group by 1"
)


_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
_MISSING = ["concept", "care_site", "visit_detail", "procedure_occurrence", "drug_exposure"]
_TEST = "select person_id from v_split where dataset='external_test'"
_EMBEDDED = "select person_id from v_observed where event_source_concept_id in (select event_source_concept_id from v_embedding)"
_CHAPTERS_22 = "(select cast(unnest(range(1, 23)) as varchar) as class)"


def _held_out(persons: str) -> str:
    return f"select person_id, cast(y as int) y, true in_range from v_mace where person_id in ({_TEST}) and person_id in ({persons})"


def _exported(table: str, rows: str) -> str:
    return f"""select '{table}' table_name, count(*) n_rows, count(distinct person_id) n_persons
        from {rows} where person_id in (select person_id from v_split where dataset='train')"""


def _norm(matrix: str, column: str) -> str:
    return f"""select count(distinct {column}) n_columns, least(30, count(distinct {column})) n_values, true orthogonal,
        true within_norm, round(sum(x*x), 3) norm from ({matrix})"""


BODIES |= {
    "scan_catalog": " union all ".join(f"select '{t}' table_name, count(*) n_rows from {t}" for t in _TABLES),
    "i2b2_folder": """select 'visit_occurrence' table_name, count(*) n_rows from v_visit
        union all select 'person', count(*) from v_person union all select 'condition_occurrence', count(*) from v_condition
        union all """ + " union all ".join(f"select '{t}', null" for t in _MISSING),
    "export_pretrain_tables": " union all ".join([
        _exported("person", "v_person"), _exported("visit_occurrence", "v_visit"),
        _exported("condition_occurrence", "v_condition"),
        _exported("procedure_occurrence", "(select * from v_all_event where source='procedure_occurrence')"),
        _exported("drug_exposure", "(select * from v_all_event where source='drug_exposure_administration')"),
    ]),
    "code_embeddings": _norm("""with a as (select code, sum(n_pairs)::double n from v_cooc group by 1),
        b as (select context, pow(sum(n_pairs)::double,0.75) w from v_cooc group by 1),
        t as (select sum(n_pairs)::double n from v_cooc), tb as (select sum(w) w from b)
        select c.context k, ln((c.n_pairs/t.n)/((a.n/t.n)*(b.w/tb.w))) x
        from v_cooc c join a on a.code=c.code join b on b.context=c.context, t, tb
        where ln((c.n_pairs/t.n)/((a.n/t.n)*(b.w/tb.w)))>0""", "k"),
    "count_svd": _norm("""select 'a' || event_source_concept_id k, decay_0 x from v_weight
        union all select 'b' || event_source_concept_id, decay_30 from v_weight""", "k"),
    "fit_logistic": _held_out("select person_id from v_observed"),
    "fit_forest": _held_out(_EMBEDDED),
    "fit_boosting": _held_out(_EMBEDDED),
    "fit_one_feature": f"""with r as (select person_id, cast(y as double) y, gender_source_value, dataset,
            cast(('0x'||substr(md5(cast(person_id as varchar)||':0'),1,8)) as bigint)%1000 < 100 held
            from v_mace join v_split using (person_id) join v_person using (person_id)),
        n as (select gender_source_value, count(*) n from r where dataset<>'train' group by 1),
        m as (select gender_source_value, avg(y) m, avg(y) filter (not held) b from r where dataset='train' group by 1)
        select gender_source_value, estimator, n, round(p, 3) p from n join (
            select gender_source_value, 'ridge' estimator, m p from m
            union all select gender_source_value, 'random_forests', case when (select max(m) from m) <= 0.5
                or (select min(m) from m) > 0.5 then (select avg(y) from r where dataset='train') else m end from m
            union all select gender_source_value, 'hist_gradient_boosting',
                1/(1+exp(-(ln(t/(1-t)) + (b-t)/(t*(1-t))))) from m, (select avg(y) t from r where dataset='train' and not held))
        using (gender_source_value)""",
    "fit_multilabel": f"""with s as (select person_id, dataset from v_prognosis_split
            where person_id in (select person_id from v_prognosis_event
            where event_source_concept_id in (select event_source_concept_id from v_embedding))),
        r as (select person_id, dataset, class, cast(list_contains(labels, class) as int) y
            from v_prognosis join s using (person_id), {_CHAPTERS_22}),
        m as (select class, count(*) n_persons, count(*) filter (y = 1) n_cases, round(avg(y::double), 4) mean_p
            from r where dataset='train' group by class)
        select person_id, dataset, class, y, true in_range, n_persons, n_cases, mean_p from r join m using (class)""",
    "resumed_grid": """select 'ridge' estimator, featurizer, p.n n_person_raw, e.n n_event_raw, e.c n_codes_raw, 1::bigint n_runs, 1::bigint n_keys
        from (select count(*) n from v_mace) p, (select count(*) n, count(distinct event_source_concept_id) c from v_observed) e,
        (select unnest(['Demographics', 'Embeddings']) featurizer)""",
    "random_search": " union all ".join(
        f"select '{{''regParam'': {p}}}' parameters, true in_range, true not_above_best" for p in (0.001, 0.01, 0.1, 0.5, 1.0)
    ),
    "run_grid": """select 'Logistic regression' estimator_label, featurizer, p.n n_person_raw, e.n n_event_raw, e.c n_codes_raw,
        5 n_demographics, true scored from (select count(*) n from v_mace) p,
        (select count(*) n, count(distinct event_source_concept_id) c from v_observed) e,
        (select unnest(['Demographics', 'Count Encoding', 'Count Encoding + SVD', 'Count Encoding + random projection',
        'Local Embeddings', 'Embeddings']) featurizer)""",
    "run_multilabel_grid": f"""with s as (select labels from v_prognosis where person_id in (select person_id
            from v_prognosis_split where dataset='external_test') and person_id in (select person_id from v_prognosis_event))
        select estimator, class, round(100.0::double*(select count(*) from s where list_contains(labels, class))
            /(select count(*) from s), 6) prevalence
        from {_CHAPTERS_22}, (select unnest(['ridge', 'naive_baseline']) estimator)""",
    "grid_report": """select unnest(['Logistic regression', 'naive_baseline']) estimator_label, 22 n_classes, true in_range""",
}


_NAME = re.compile(r"\bv_[a-z0-9_]+\b")


def _needed(sql: str) -> list[str]:
    """Fragments a text needs, each after those it is made of."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in FRAGMENTS and name not in ordered:
                visit(FRAGMENTS[name])
                ordered.append(name)

    visit(sql)
    return ordered


def sql(name: str) -> str:
    body = BODIES[name].strip()
    names = _needed(body)
    if not names:
        return body
    parts = ", ".join(f"{n} as ({FRAGMENTS[n]})" for n in names)
    if body.startswith("with recursive "):
        return f"with recursive {parts}, {body[len('with recursive '):]}"
    if body.startswith("with "):
        return f"with {parts}, {body[len('with '):]}"
    return f"with {parts} {body}"


def all_sql() -> dict[str, str]:
    return {name: sql(name) for name in BODIES}

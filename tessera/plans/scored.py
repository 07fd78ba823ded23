"""Metrics, inference, policies, dataset building and run logs over stand-ins made from the driver tables.

``scores`` has a row for each labelled document and tier: correct is its quality, flipped for some by hash;
gate holds for most that are not toxic; conf has two digits, so that ties occur. Every window has a full order.
"""

SCORES = """tiers as (select * from (values (0), (1), (2)) v(tier)),
raw as (select d.doc_id as task_id, d.lang as domain, d.source as cluster, v.tier, l.quality, l.toxic, d.n_chars,
  concat(cast(d.doc_id as string), '|', cast(v.tier as string)) as k from documents d join labels l on l.doc_id = d.doc_id cross join tiers v),
graded as (select *, case when @h8[concat('c|', k)] % 10 < 3 - tier then 1 - quality else quality end as correct from raw),
scores as (select task_id, domain, cluster, tier, correct, case when toxic = 0 and @h8[concat('g|', k)] % 10 < 7 then 1 else 0 end as gate,
  cast(@h8[concat('p|', k)] % 60 + 40 * correct as double) / 1e2 as conf, cast(n_chars * (tier + 1) as double) / 1e3 as cost from graded)"""

RANKED = SCORES + """,
ranked as (select *, row_number() over (partition by tier order by conf desc, correct, task_id) as r, count(*) over (partition by tier) as n,
  sum(1 - correct) over (partition by tier order by conf desc, correct, task_id rows between unbounded preceding and current row) as wrong from scores),
curve as (select *, cast(wrong as double) / r as risk, cast(r as double) / n as cov from ranked)"""

LOG = """log as (select event_id, user_id as model, event_type as arm, value as gpu_s, row_number() over (order by event_id) as ord from events)"""

ROUTED = SCORES + """,
wide as (select task_id, domain, max(case when tier = 0 then gate end) as g0, max(case when tier = 1 then gate end) as g1, max(case when tier = 2 then gate end) as g2,
  max(case when tier = 0 then correct end) as c0, max(case when tier = 1 then correct end) as c1, max(case when tier = 2 then correct end) as c2,
  max(case when tier = 0 then cost end) as k0, max(case when tier = 1 then cost end) as k1, max(case when tier = 2 then cost end) as k2,
  max(case when tier = 0 then conf end) as p0, max(case when tier = 1 then conf end) as p1, max(case when tier = 2 then conf end) as p2 from scores group by task_id, domain),
cascade as (select *, case when g0 = 1 then 0 when g1 = 1 then 1 else 2 end as final_tier, case when g0 + g1 + g2 > 0 then 1 else 0 end as answered from wide),
played as (select *, case final_tier when 0 then c0 when 1 then c1 else c2 end as correct, k0 + case when final_tier >= 1 then k1 else 0 end + case when final_tier >= 2 then k2 else 0 end as cost from cascade)"""

CANDIDATES = """cands as (select conv_id as task_id, turn as call_index, text, length(text) as size, @h8[text] as norm_hash,
  case when @h8[concat('v|', text)] % 3 = 0 then 'wrong' when @h8[concat('v|', text)] % 3 = 1 then 'confident_wrong' else 'VERIFIED' end as status
  from conversations where role = 'assistant')"""

SQL: dict[str, str] = {}


def add(name: str, body: str, *parts: str) -> None:
    SQL[name] = ("with " + ",\n".join(parts) + "\n" if parts else "") + body


# ---- sources and filters
add("src03_parquet", "select doc_id, lang, source, n_chars from documents")
add("fl01_license", "select doc_id, case when contains(text, 'NC 4.0') then 'excluded' when contains(text, 'Licensed under') or contains(text, 'License') then 'marked' else 'missing' end as reason from documents")
add("fl06_folds", """select fold, split, count(*) as n from (select @h8[concat('0|', source, '|', cast(doc_id as string))] % 5 as fold,
 case when @h8[concat(source, '|', cast(doc_id as string))] % 10 < 6 then 'train' when @h8[concat(source, '|', cast(doc_id as string))] % 10 = 6 then 'cal' else 'test' end as split from documents) t group by fold, split""")
add("fl07_duplicate_ids", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
add("fl08_first_n", "select domain, task_id from (select lang as domain, doc_id as task_id, row_number() over (partition by lang order by doc_id) as r from documents) t where r <= 20")
add("fl09_slices", """select slice, count(*) as n, sum(n_chars) as chars from (select 'all' as slice, n_chars from documents union all select concat('lang:', lang), n_chars from documents
 union all select concat('long:', cast(n_chars > 2000 as string)), n_chars from documents) t group by slice""")
SQL["fl09_slices"] = SQL["fl09_slices"].replace("sum(n_chars)", "cast(sum(n_chars) as bigint)")
add("fl10_provenance", "select conv_id, min(case when role is not null and text is not null and turn is not null then 1 else 0 end) as complete from conversations group by conv_id")
add("fl12_gate_visible", "select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")

# ---- joins
add("jn01_paired_arms", "select a.task_id, a.correct as correct_a, b.correct as correct_b from scores a join scores b on a.task_id = b.task_id where a.tier = 0 and b.tier = 2", SCORES)
add("jn01_unpaired", "select count(*) as dropped_unpaired from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
add("jn04_clusters", "select d.doc_id, coalesce(cast(l.quality as string), concat(d.lang, ':', cast(d.doc_id as string))) as cluster from documents d left join labels l on l.doc_id = d.doc_id")
add("jn05_overlay", "select model, arm, gpu_s, event_id from (select *, row_number() over (partition by model, arm order by ord desc) as r from log) t where r = 1", LOG)
add("jn06_corrections", "select a.event_id as before_id, b.event_id as after_id, a.gpu_s as before_s, b.gpu_s as after_s from log a join log b on a.model = b.model and a.arm = b.arm and b.event_id > a.event_id and b.event_id <= a.event_id + 200 where a.gpu_s <> b.gpu_s", LOG)
# each event that changes its key's value, beside the event of the key before it, however far apart: the reference holds one score a key
add("jn06_all_corrections", """select before_id, event_id as after_id, before_s, after_s from (select event_id, value as after_s, lag(event_id) over (partition by user_id, event_type order by event_id) as before_id,
 lag(value) over (partition by user_id, event_type order by event_id) as before_s from events) t where before_id is not null and before_s is distinct from after_s""")
add("jn07_first_wins", "select model, arm, event_id from (select *, row_number() over (partition by model, arm order by ord) as r from log) t where r = 1", LOG)
add("jn08_task_tier", "select v.tier, count(*) as tasks, count(l.doc_id) as labelled, count_if(l.doc_id is null) as missing from documents d cross join (select * from (values (0), (1), (2)) v(tier)) v left join labels l on l.doc_id = d.doc_id group by v.tier")
add("jn09_feedback", "select d.doc_id, case when l.quality is null then 'unmatched' else 'human' end as origin from documents d left join labels l on l.doc_id = d.doc_id")
add("jn10_resume", "select d.doc_id from documents d left anti join labels l on l.doc_id = d.doc_id".replace("left anti join", "anti join"))
add("jn13_partner_agreement", "select a.task_id, a.tier, avg(case when a.correct = b.correct then 1e0 else 0e0 end) as agree from scores a join scores b on a.task_id = b.task_id and a.tier <> b.tier group by a.task_id, a.tier", SCORES)
add("jn14_quant_pairs", "select domain, count_if(x = 1 and y = 0) as lost, count_if(x = 0 and y = 1) as gained, count(*) as n from (select task_id, domain, max(case when tier = 1 then correct end) as x, max(case when tier = 2 then correct end) as y from scores group by task_id, domain) t group by domain", SCORES)

# ---- aggregates
add("ag01_accuracy", "select tier, domain, round(avg(cast(correct as double)), 9) as acc from scores group by tier, domain", SCORES)
add("ag02_cwr", "select tier, round(avg(case when gate = 1 and correct = 0 then 1e0 else 0e0 end), 9) as cwr from scores group by tier", SCORES)
add("ag03_answered_accuracy", "select tier, domain, round(sum(gate * correct) / nullif(cast(sum(gate) as double), 0), 9) as answered_acc from scores group by tier, domain", SCORES)
add("ag04_cost_per_correct", "select tier, round(sum(cost) / nullif(sum(gate * correct), 0), 6) as cost_per_correct from scores group by tier", SCORES)
add("ag05_selective_summary", """select tier, round(avg(cast(gate as double)), 9) as coverage, round(sum(gate * correct) / nullif(cast(sum(gate) as double), 0), 9) as answered_accuracy,
 round(sum(gate * (1 - correct)) / cast(count(*) as double), 9) as cwr, round(avg(cast(correct as double)) / nullif(sum(cost), 0), 12) as acc_per_gpu_s, round(sum(cost) / nullif(sum(gate * correct), 0), 6) as gpu_s_per_correct,
 round(avg(case when tier > 0 then 1e0 else 0e0 end), 9) as escalation_rate from scores group by tier""", SCORES)
add("ag06_run_cells", """select tier, domain, count(*) as n, cast(sum(correct) as bigint) as correct, cast(sum(gate) as bigint) as answered, cast(sum(gate * correct) as bigint) as answered_correct,
 cast(sum(gate * (1 - correct)) as bigint) as confident_wrong, round(sum(cost), 6) as cost from scores group by tier, domain""", SCORES)
add("ag07_throughput", "select arm, round(sum(case when model % 7 <> 0 then 1e2 else 0e0 end) / nullif(sum(case when model % 7 <> 0 then gpu_s end), 0), 6) as tok_s from log group by arm", LOG)
add("ag08_descriptives", "select event_type, case when value < 1 then '?' else 'stop' end as finish, count(*) as n, round(avg(value), 6) as mean_value, round(min(value), 6) as lo, round(max(value), 6) as hi from events group by 1, 2")
add("ag09_ledger", "select count(value) as known, count_if(value is null) as missing, round(sum(value), 3) as total, case when sum(value) <= 40 then 'ok' when sum(value) <= 50 then 'warn' else 'over' end as verdict from events")
add("ag10_outcomes", "select domain, count_if(gate = 1 and correct = 1) as verified_right, count_if(gate = 1 and correct = 0) as verified_wrong, count_if(gate = 0) as unanswered from scores where tier = 1 group by domain", SCORES)
add("ag11_gate_block", """select tier, slice, count(*) as n, round(avg(cast(gate as double)), 9) as coverage, round(sum(gate * correct) / nullif(cast(sum(gate) as double), 0), 9) as prec,
 round(sum(gate * correct) / nullif(cast(sum(correct) as double), 0), 9) as recall, round(sum(gate * (1 - correct)) / nullif(cast(sum(1 - correct) as double), 0), 9) as false_accept
 from (select tier, 'all' as slice, gate, correct from scores union all select tier, domain, gate, correct from scores) t group by tier, slice""", SCORES)
add("ag12_paired", "select count_if(c0 = 0 and c2 = 1) as gained, count_if(c0 = 1 and c2 = 0) as lost, count(*) as n from played", ROUTED)
add("ag13_arm_summary", "select tier, count(*) as n, round(percentile_cont(0.5) within group (order by cost), 6) as median_cost, round(avg(case when gate = 1 and correct = 0 then 1e0 else 0e0 end), 9) as hallucination from scores group by tier", SCORES)
add("ag14_confusion_p95", """select c.tier, count_if(gate = 1 and correct = 1) as tp, count_if(gate = 1 and correct = 0) as fp, count_if(gate = 0 and correct = 1) as fn, count_if(gate = 0 and correct = 0) as tn,
 max(case when r - 1 = cast(floor(0.95 * (n - 1) + 0.5) as bigint) then cost end) as p95 from (select *, row_number() over (partition by tier order by cost, task_id) as r, count(*) over (partition by tier) as n from scores) c group by c.tier""", SCORES)
add("ag15_compare_runs", "select a.domain, round(b.acc - a.acc, 9) as delta, case when b.acc >= 0.5 then 'PASS' else 'FAIL' end as rule from (select domain, avg(cast(correct as double)) as acc from scores where tier = 0 group by domain) a join (select domain, avg(cast(correct as double)) as acc from scores where tier = 2 group by domain) b on a.domain = b.domain", SCORES)
add("ag16_length_stats", "select round(avg(x), 4) as mean, round(percentile_cont(0.5) within group (order by x), 4) as median, round(max(case when r - 1 = least(n - 1, cast(floor(0.9 * n) as bigint)) then x end), 4) as p90, round(avg(case when x > 1 then 1e0 else 0e0 end), 4) as above from (select n_chars / 1e3 as x, row_number() over (order by n_chars, doc_id) as r, count(*) over () as n from documents) t")
add("ag17_attribution", "select event_id, round(36e2 * value / nullif(sum(value) over (partition by user_id), 0), 6) as seconds from events")
add("ag18_histogram", "select coalesce(cast(l.quality as string), 'none') as bucket, count(*) as n from documents d left join labels l on l.doc_id = d.doc_id group by 1")
add("ag19_pass_rates", "select tier, count(*) as n, round(sum(gate * correct) / nullif(cast(sum(gate) as double), 0), 9) as gate_precision, round(avg(cast(correct as double)), 9) as pass_rate from scores group by tier", SCORES)
add("ag20_vote", """select user_id, event_type as answer, n, round(n / cast(total as double), 9) as share from (select *, row_number() over (partition by user_id order by n desc, first_id) as r, sum(n) over (partition by user_id) as total
 from (select user_id, event_type, count(*) as n, min(event_id) as first_id from events group by user_id, event_type) g) t where r = 1""")
add("ag21_overlaps", "select count_if(a = 1 and b = 1) as both_, count_if(a = 1 or b = 1) as any_, count_if(a = 1 and b = 0) as only_a from (select max(case when tier = 0 then gate end) as a, max(case when tier = 2 then gate end) as b from scores group by task_id) t", SCORES)
add("ag22_grouping_sets", "select domain, tier, count(*) as n, round(avg(cast(correct as double)), 9) as acc from scores group by grouping sets ((domain, tier), (tier), ())", SCORES)

# ---- windows
add("wn01_auroc", """select tier, round((sum(case when correct = 1 then rk end) - sum(correct) * (sum(correct) + 1) / 2e0) / nullif(cast(sum(correct) as double) * sum(1 - correct), 0), 9) as auroc
 from (select tier, correct, rank() over (partition by tier order by conf) + (count(*) over (partition by tier, conf) - 1) / 2e0 as rk from scores) t group by tier""", SCORES)
add("wn02_risk_coverage", "select tier, r, round(risk, 9) as risk, round(cov, 9) as cov from curve", RANKED)
add("wn03_aurc", """select c.tier, round(avg(c.risk), 9) as aurc, round(avg(c.risk) - avg(o.risk), 9) as e_aurc from curve c join (select tier, r, greatest(0, r - good) / cast(r as double) as risk
 from (select tier, r, sum(correct) over (partition by tier) as good from ranked) q) o on o.tier = c.tier and o.r = c.r group by c.tier""", RANKED)
add("wn04_risk_at_coverage", "select tier, round(sum(1 - correct) / cast(count(*) as double), 9) as risk from ranked where r <= ceil(0.8e0 * n - 1e-12) group by tier", RANKED)
add("wn05_coverage_at_risk", "select tier, round(max(case when risk <= 0.3e0 + 1e-12 then cov else 0e0 end), 9) as cov from curve group by tier", RANKED)
add("wn06_ece_equal_mass", """select tier, round(sum(abs(gap)) / max(n), 9) as ece from (select tier, bin, sum(conf - correct) as gap, max(n) as n from (select *, floor((r1 * least(15, n) - 1) / cast(n as double)) as bin
 from (select *, row_number() over (partition by tier order by conf, task_id) as r1, count(*) over (partition by tier) as n from scores) a) b group by tier, bin) c group by tier""", SCORES)
add("wn07_ece_equal_width", "select tier, round(sum(abs(gap)) / sum(m), 9) as ece from (select tier, least(floor(conf * 10 + 1e-9), 9) as bin, sum(conf - correct) as gap, count(*) as m from scores group by 1, 2) t group by tier", SCORES)
add("wn08_brier_logloss", "select tier, round(avg(power(conf - correct, 2)), 9) as brier, round(avg(-ln(greatest(1e-12, case when correct = 1 then conf else 1 - conf end))), 9) as logloss from scores group by tier", SCORES)
add("wn09_matched_cwr", "select tier, round(sum(case when r <= k then 1 - correct else 0 end) / cast(count(*) as double), 9) as matched_cwr from (select *, sum(gate) over (partition by tier) as k from ranked) t group by tier", RANKED)
add("wn10_topk_risk", "select tier, round(avg(1e0 - correct), 9) as risk from ranked where r <= 50 group by tier", RANKED)
add("wn12_precision_at_coverage", "select tier, round(avg(cast(correct as double)), 9) as prec from ranked where r <= ceil(0.5e0 * n) group by tier", RANKED)
WIL = "((p + 1.9208e0 / r) - 1.96e0 * sqrt((p * (1 - p) + 0.9604e0 / r) / r)) / (1 + 3.8416e0 / r)"
add("wn13_largest_certified", f"select tier, max(r) as size from (select tier, r, 1 - risk as p from curve) t where r >= 20 and p >= 0.84 and {WIL} >= 0.80 group by tier", RANKED)
add("wn14_pick_threshold", f"select tier, coalesce(max(case when {WIL} >= 0.7 then r end), max(case when p >= 0.7 then r end), max(cast(floor(n / 2e0) as bigint))) as pick from (select tier, r, n, 1 - risk as p from curve where r >= ceil(0.05e0 * n)) t group by tier", RANKED)
add("wn17_balanced_threshold", "select tier, max(round((tp / cast(p as double) + 1 - fp / cast(q as double)) / 2, 9)) as balanced from (select tier, sum(correct) over (partition by tier order by conf desc) as tp, sum(1 - correct) over (partition by tier order by conf desc) as fp, sum(correct) over (partition by tier) as p, sum(1 - correct) over (partition by tier) as q from scores) t group by tier", SCORES)
add("wn18_stratified_sample", """select stratum, doc_id from (select s.source as stratum, d.doc_id, a.take, row_number() over (partition by s.source order by @h8[concat('7|', s.source, '|', cast(d.doc_id as string))], d.doc_id) as r from documents d join
 (select source from documents group by source) s on s.source = d.source join (select source, base + case when row_number() over (order by rest desc, source desc) <= 200 - sum(base) over () then 1 else 0 end as take from
 (select source, cast(floor(200e0 * m / t) as bigint) as base, 200e0 * m / t - floor(200e0 * m / t) as rest from (select source, count(*) as m, sum(count(*)) over () as t from documents group by source) x) y) a on a.source = d.source) z where r <= take""")
add("wn19_interleave", "select doc_id, lang, row_number() over (order by pos, lang, doc_id) as place from (select doc_id, lang, (row_number() over (partition by lang order by doc_id) - 0.5e0) / count(*) over (partition by lang) as pos from documents) t")
add("wn20_dpo_choice", """select c.task_id, c.call_index as chosen, j.call_index as rejected from (select *, row_number() over (partition by task_id order by norm_hash, call_index) as r from cands where status = 'VERIFIED') c
 join (select *, row_number() over (partition by task_id order by case status when 'confident_wrong' then 0 else 1 end, norm_hash, call_index) as r from cands where status <> 'VERIFIED') j on j.task_id = c.task_id and j.r = 1 where c.r = 1""", CANDIDATES)
add("wn21_shallow_cap", "select doc_id from (select doc_id, deep, row_number() over (partition by deep order by doc_id) as r, sum(deep) over () as total from (select doc_id, case when n_chars > 500 then 1 else 0 end as deep from documents) a) b where deep = 1 or r <= floor(total * 0.25 / 0.75)")
add("wn22_two_distinct", "select task_id, norm_hash from (select task_id, norm_hash, row_number() over (partition by task_id order by @h8[concat('s|', cast(norm_hash as string))], norm_hash) as r from (select distinct task_id, norm_hash from cands) d) t where r <= 2", CANDIDATES)
add("wn23_best_candidate", "select task_id, call_index from (select *, row_number() over (partition by task_id order by case status when 'VERIFIED' then 1 else 0 end desc, size, norm_hash, call_index) as r from cands) t where r = 1", CANDIDATES)
add("wn24_best_of_k", "select task_id, tier, conf from (select *, row_number() over (partition by task_id order by gate desc, conf desc, tier) as r from scores) t where r = 1", SCORES)
add("so01_stable_order", "select domain, task_id, row_number() over (order by domain, task_id) as place from (select lang as domain, doc_id as task_id from documents) t")
add("so02_hash_order", "select doc_id, row_number() over (order by @h8[concat(source, cast(doc_id as string))], doc_id) as place from documents")
add("so04_head_sample", "select doc_id from (select doc_id, row_number() over (order by @h8[concat('5|', cast(doc_id as string))], doc_id) as r from documents) t where r <= 100")
add("so06_most_common", "select w, count(*) as n from (select @explode[@words[text]] as w from documents) t group by w order by n desc, w limit 25")
add("set_ops", "select doc_id from documents intersect select doc_id from labels except select doc_id from labels where toxic = 1")

# ---- inference
add("st02_cluster_bootstrap", """select round(percentile_cont(0.025) within group (order by d), 6) as lo, round(percentile_cont(0.975) within group (order by d), 6) as hi from (select b, sum(w * good2) / cast(sum(w * m) as double) - sum(w * good0) / cast(sum(w * m) as double) as d from
 (select b, cluster, count(*) as w from (select bs.b, c.cluster from bs cross join slots s join slots c on c.slot = @h8[concat(cast(bs.b as string), '|', cast(s.slot as string))] % s.total) p group by b, cluster) draw
 join (select cluster, count(*) as m, sum(case when tier = 2 then correct else 0 end) as good2, sum(case when tier = 0 then correct else 0 end) as good0 from scores group by cluster) f on f.cluster = draw.cluster group by b) t""",
 SCORES, "slots as (select cluster, row_number() over (order by cluster) - 1 as slot, count(*) over () as total from (select distinct cluster from scores) c)", "bs as (select doc_id as b from documents where doc_id < 200)")
# 10,000 resamples of clusters within each domain; all tiers share the draw
add("st02_stratified_bootstrap", """select round(percentile_cont(0.025) within group (order by d), 6) as lo, round(percentile_cont(0.975) within group (order by d), 6) as hi, count(d) as n_valid from (select b, sum(c.good2 - c.good0) / cast(sum(c.m) as double) as d
 from bs cross join slots s join slots c on c.domain = s.domain and c.slot = @h8[concat(cast(bs.b as string), '|', s.domain, '|', cast(s.slot as string))] % s.total group by b) t""",
 SCORES, """held as (select coalesce(domain, '') as domain, coalesce(cluster, '') as cluster, sum(case when tier = 0 then 1 else 0 end) as m, sum(case when tier = 2 then correct else 0 end) as good2, sum(case when tier = 0 then correct else 0 end) as good0 from scores group by 1, 2)""",
 "slots as (select *, row_number() over (partition by domain order by cluster) - 1 as slot, count(*) over (partition by domain) as total from held)",
 "digits as (select * from (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) v(x))", "bs as (select a.x * 1000 + h.x * 100 + t.x * 10 + o.x as b from digits a cross join digits h cross join digits t cross join digits o)")
add("st04_mcnemar_counts", "select domain, count_if(c0 = 1 and c2 = 0) as b, count_if(c0 = 0 and c2 = 1) as c from played group by domain", ROUTED)
add("st05_holm", """select domain, p, least(1e0, max((m - r + 1) * p) over (order by r rows between unbounded preceding and current row)) as adjusted from (select domain, p, row_number() over (order by p, domain) as r, count(*) over () as m from
 (select lang as domain, cast(@h8[lang] % 1000 as double) / 1e4 as p from documents group by lang) a) t""")
add("st06_wilson", f"select tier, round({WIL}, 9) as lower_bound from (select tier, avg(cast(correct as double)) as p, cast(count(*) as double) as r from scores group by tier) t", SCORES)
add("st09_spearman", "select tier, round(corr(ra, rb), 9) as rho from (select tier, rank() over (partition by tier order by conf) + (count(*) over (partition by tier, conf) - 1) / 2e0 as ra, rank() over (partition by tier order by cost) + (count(*) over (partition by tier, cost) - 1) / 2e0 as rb from scores) t group by tier", SCORES)
add("st18_verdicts", "select tier, case when n < 500 then 'underpowered' when acc > 0.6 then 'supported' else 'not supported' end as verdict from (select tier, count(*) as n, avg(cast(correct as double)) as acc from scores group by tier) t", SCORES)
add("st20_band", "select cluster, round(avg(cast(correct as double)), 9) as top1, avg(cast(correct as double)) between 0.3 and 0.7 as in_band from scores where tier = 1 group by cluster", SCORES)

# ---- policies
add("rt01_cascade", "select task_id, final_tier, answered, correct, round(cost, 6) as cost from played", ROUTED)
add("rt02_router", "select task_id, start_tier, case when start_tier <= 0 and g0 = 1 then 0 when start_tier <= 1 and g1 = 1 then 1 else 2 end as final_tier from (select *, case when p0 >= 0.6 then 0 when p1 >= 0.6 then 1 else 2 end as start_tier from wide) t", ROUTED)
add("rt03_choose_tau", """select tau, round(acc, 9) as acc, round(mean_cost, 6) as mean_cost, acc >= target as reached from (select *, row_number() over (order by case when acc >= target then 0 else 1 end, case when acc >= target then mean_cost else -tau end, tau) as nth from (
 select tau, avg(cast(case when p0 >= tau then c0 when p1 >= tau then c1 else c2 end as double)) as acc, avg(case when p0 >= tau then k0 when p1 >= tau then k1 else k2 end) as mean_cost from wide cross join (select * from (values (0.2e0), (0.4e0), (0.6e0), (0.8e0)) g(tau)) g group by tau) t
 cross join (select avg(cast(correct as double)) as target from played) p) r where nth = 1""", ROUTED)
add("rt04_oracle_ceiling", "select round(avg(cast(greatest(c0, c1, c2) as double)), 9) as acc, round(avg(case when c0 = 1 then k0 when c1 = 1 then k1 else k2 end), 6) as cost from wide", ROUTED)
add("rt05_validate", "select count(*) as n, count_if(abs(cost - (k0 + case when g0 = 0 then k1 else 0 end + case when g0 = 0 and g1 = 0 then k2 else 0 end)) > 1e-6) as differ from played", ROUTED)
add("rt07_keyword_router", "select t.doc_id, 1 + 2.5e0 * (case when contains(padded, ' the ') then 1 else 0 end + case when contains(padded, ' der ') then 1 else 0 end) as score from (select doc_id, concat(' ', lower(text), ' ') as padded from documents) t")
add("rt08_routing_eval", "select count_if(start_tier < need) as under, count_if(start_tier > need) as over_, round(avg(case when start_tier = need then 1e0 else 0e0 end), 9) as top1 from (select case when p0 >= 0.6 then 0 when p1 >= 0.6 then 1 else 2 end as start_tier, case when c0 = 1 then 0 when c1 = 1 then 1 else 2 end as need from wide) t", ROUTED)
add("rt09_verdicts", "select verdict, count(*) as n from (select case when g0 + g1 + g2 > 0 then 'VERIFIED' when p2 >= 0.8 then 'LIKELY_CORRECT' when p2 <= 0.2 then 'LIKELY_WRONG' when final_tier = 2 then 'ABSTAIN' else 'ESCALATE' end as verdict from played) t group by verdict", ROUTED)
add("rt10_k_min", "select k, count_if(g0 + g1 + g2 < k and answered = 1) as demoted, count_if(g0 + g1 + g2 >= k and correct = 0) as remaining_cw from played cross join (select * from (values (1), (2), (3)) g(k)) g group by k", ROUTED)
add("rt13_cross_tier", "select task_id, case when c0 = c1 and c1 = c2 then 1 else 0 end as agree_all, case when c0 + c1 + c2 >= 2 then 1 else 0 end as majority from wide", ROUTED)
add("mx18_balanced", "select tier, round((sum(gate * correct) / nullif(cast(sum(correct) as double), 0) + sum((1 - gate) * (1 - correct)) / nullif(cast(sum(1 - correct) as double), 0)) / 2, 9) as balanced from scores group by tier", SCORES)
add("mx10_warmup", "select arm, round(sum(case when ord > 192 then gpu_s end), 6) as gpu_s from log group by arm", LOG)
add("mx22_deterministic", "select user_id, count(distinct event_type) = 1 as deterministic from events group by user_id")

# ---- dataset building
add("bd01_rejection_state", "select task_id, count(*) as verified, count(*) >= 2 as done from (select distinct task_id, norm_hash from cands where status = 'VERIFIED') t group by task_id", CANDIDATES)
add("bd03_sft", "select task_id, call_index from (select *, row_number() over (partition by task_id order by norm_hash, call_index) as r from cands where status = 'VERIFIED') t where r <= 2", CANDIDATES)
add("bd06_hard_negatives", "select task_id, tier, copy from scores cross join (select * from (values (1), (2), (3)) c(copy)) c where copy = 1 or (gate = 1 and correct = 0)", SCORES)
add("bd10_confidence_features", "select cluster, tier, round(avg(conf), 9) as mean, min(conf) as lo, round(avg(case when r <= greatest(1, ceil(0.1e0 * n)) then conf end), 9) as low_tenth from (select *, row_number() over (partition by cluster, tier order by conf, task_id) as r, count(*) over (partition by cluster, tier) as n from scores) t group by cluster, tier", SCORES)
add("bd11_prompt_features", "select doc_id, length(text) as n_chars, length(text) - length(replace(text, ' ', '')) as blanks, length(text) - length(replace(text, chr(10), '')) as lines, length(text) - length(replace(text, '?', '')) as questions from documents")
add("fn18_confidence", "select event_id, round(exp(least(0, -value)), 9) as conf from events")
add("fn19_logit", "select event_id, round(ln(greatest(1e-6, least(1 - 1e-6, value / 1e3)) / (1 - greatest(1e-6, least(1 - 1e-6, value / 1e3)))), 9) as logit from events")
add("generic_revenue", "select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by l_returnflag, l_linestatus")
add("generic_join_topk", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by n_name order by revenue desc, n_name limit 10")

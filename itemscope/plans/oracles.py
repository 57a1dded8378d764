"""The registered queries once more, as plain SQL over the same tables, for checking results."""

from itemscope.plans.queries import ALL_SEEDS, DIFFICULTIES, KS, MIN_OBSERVED, PAIRS, SEEDS

LONG, SHORT = "LeaveHomeForMoreThanAWeek", "LeaveHomeForLessThanAWeek"


def _r(expr, name, digits=6):
    return f"round({expr}, {digits}) + 0.0 as {name}"


_DAMAGE = ("case p_partkey % 4 when 0 then 'No Damage' when 1 then 'Some Damage' "
           "when 2 then 'Moderate Damage' else 'A lot of Damage' end")
_MAPPED = f"case when p_size + (p_partkey * 7919) % 40 > 45 then '{LONG}' else '{SHORT}' end"
_ITEM = "concat('item_', lpad(cast(p_partkey as string), 8, '0'))"

_BASE = f"""
decisions as (
  select concat('n', lpad(cast(s_nationkey as string), 2, '0')) as subject,
         concat('item_', lpad(cast(l_partkey as string), 8, '0')) as item_id,
         case when l_quantity > 30 then 1 when l_quantity >= 3 then 0 end as decision
  from (select s.s_nationkey, l.l_partkey, l.l_quantity,
               row_number() over (partition by s.s_nationkey, l.l_partkey
                                  order by l.l_orderkey, l.l_linenumber, l.l_quantity) as rn
        from lineitem l join supplier s on l.l_suppkey = s.s_suppkey) c
  where rn = 1),
items as (
  select {_ITEM} as item_id, {_MAPPED} as ground_truth_mapped,
    p_brand as State, p_type as Tenure,
    case when p_partkey % 17 = 0 then null else p_size end as Occupants,
    {_DAMAGE} as BuildingDamage,
    case p_partkey % 5 when 0 then 'No shortage' when 1 then 'Some shortage'
         when 2 then 'A lot of shortage' when 3 then 'Never' else 'No' end as WaterAccess,
    case when p_size % 3 = 0 then '' when p_size % 3 = 1 then 'Always' else 'Some' end
      as PowerAccess
  from part),
obs as (
  select d.subject, d.item_id, d.decision,
    case when i.ground_truth_mapped = '{LONG}' then 1 else 0 end as true_long,
    case when d.decision = case when i.ground_truth_mapped = '{LONG}' then 1 else 0 end
         then 1 else 0 end as y
  from decisions d join items i on d.item_id = i.item_id where d.decision is not null),
n_items as (select count(*) as n from part)"""


def _shortage(column):
    low = f"lower({column})"
    return (f"case when contains({low}, 'no ') then 0.0 when contains({low}, 'never') then 0.0 "
            f"when contains({low}, 'some') then 1.0 when contains({low}, 'a lot') then 2.0 "
            f"when contains({low}, 'lot') then 2.0 when contains({low}, 'always') then 0.0 "
            f"else 0.0 end")


def _scored(source, name, food="''", dirty="''"):
    """CTEs that add the severity scores and flags to `source`."""
    return f"""
{name}_1 as (
  select *, case when ground_truth_mapped = '{LONG}' then 1 else 0 end as true_long,
    cast(case BuildingDamage when 'Some Damage' then 1 when 'Moderate Damage' then 2
         when 'A lot of Damage' then 3 else 0 end as double) as damage_score,
    cast({_shortage('WaterAccess')} as double) as water_score,
    cast({_shortage('PowerAccess')} as double) as power_score,
    cast({_shortage(food)} as double) as food_score,
    cast({_shortage(dirty)} as double) as unsanitary_score
  from {source}),
{name}_2 as (
  select *, damage_score + water_score + power_score + food_score + unsanitary_score
    as total_severity_score from {name}_1),
{name}_3 as (
  select *, case when damage_score >= 2 or total_severity_score >= 5 then 1 else 0 end
      as severe_cues,
    case when damage_score <= 0 and total_severity_score <= 1 then 1 else 0 end as weak_cues
  from {name}_2),
{name} as (
  select *, case when severe_cues = 1 and true_long = 0 then 1 else 0 end as severe_cues_short,
    case when weak_cues = 1 and true_long = 1 then 1 else 0 end as weak_cues_long,
    case when (severe_cues = 1 and true_long = 0) or (weak_cues = 1 and true_long = 1)
         then 1 else 0 end as simple_cue_label_conflict
  from {name}_3)"""


_FLAT = _scored("items", "flat")


def _logit(expr):
    clipped = f"least(greatest({expr}, 1e-4), 1 - 1e-4)"
    return f"ln({clipped} / (1 - {clipped}))"


_MOMENTS = f"""
subject_raw as (select subject, avg(y) as mean_response, count(*) as n_observed from obs group by 1),
subject_fit as (
  select *, {_logit('mean_response')} - avg({_logit('mean_response')}) over () as ability
  from subject_raw),
item_raw as (
  select item_id, avg(y) as empirical_accuracy, count(*) as n_observed from obs group by 1),
item_own as (
  select *, -{_logit('empirical_accuracy')} as empirical_difficulty from item_raw),
item_fit as (
  select *, empirical_difficulty - avg(empirical_difficulty) over () as difficulty from item_own)"""

_TABLE = """
item_table as (
  select p.*, f.BuildingDamage, f.WaterAccess, f.true_long, f.damage_score,
    f.total_severity_score, f.severe_cues_short, f.weak_cues_long, f.simple_cue_label_conflict
  from item_fit p left join flat f on p.item_id = f.item_id)"""

_PERFORMANCE = """
counted as (
  select subject as model, count(y) as observed_total, avg(y) as accuracy,
    count(*) filter (where true_long = 1 and decision = 1) as tp,
    count(*) filter (where true_long = 0 and decision = 0) as tn,
    count(*) filter (where true_long = 0 and decision = 1) as fp,
    count(*) filter (where true_long = 1 and decision = 0) as fn
  from obs group by 1),
rates as (
  select *, n - observed_total as missing_total, observed_total / n as coverage,
    tp / nullif(tp + fn, 0) as long_recall, tn / nullif(tn + fp, 0) as short_specificity,
    (tp + fp) / nullif(tp + tn + fp + fn, 0) as predicted_long_rate,
    (tp + fn) / nullif(tp + tn + fp + fn, 0) as true_long_rate_observed
  from counted, n_items),
performance as (
  select *, coalesce((long_recall + short_specificity) / 2, long_recall, short_specificity)
      as balanced_accuracy,
    rank() over (order by accuracy desc nulls last) as accuracy_rank
  from rates)"""

_RESIDUALS = """
z as (
  select o.subject, o.item_id, 1 / (1 + exp(-(s.ability - i.difficulty))) as p, o.y
  from obs o join subject_fit s on o.subject = s.subject join item_fit i on o.item_id = i.item_id),
residuals as (
  select subject, item_id, (y - p) / sqrt(greatest(p * (1 - p), 1e-4)) as z from z)"""


def _with(*ctes):
    return "with " + ",".join(ctes)


def _values(rows):
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


def _sql():
    out = {}
    out["model_performance"] = _with(_BASE, _PERFORMANCE) + f"""
select model, observed_total, missing_total, {_r('coverage', 'coverage')},
  {_r('accuracy', 'accuracy')}, {_r('balanced_accuracy', 'balanced_accuracy')},
  {_r('long_recall', 'long_recall')}, {_r('short_specificity', 'short_specificity')},
  {_r('predicted_long_rate', 'predicted_long_rate')},
  {_r('true_long_rate_observed', 'true_long_rate_observed')}, tp, tn, fp, fn, accuracy_rank
from performance"""

    out["paired_comparisons"] = _with(_BASE, f"""
pairs(model_a, model_b) as (values {_values(PAIRS)}),
both_seen as (
  select model_a, model_b, a.y as a, b.y as b
  from pairs join obs a on a.subject = model_a
  join obs b on b.subject = model_b and b.item_id = a.item_id),
stats as (
  select model_a, model_b, count(*) as n, avg(a) as accuracy_a, avg(b) as accuracy_b,
    avg(b - a) as delta, stddev_samp(b - a) / sqrt(count(*)) as se,
    count(*) filter (where a = 1 and b = 0) as b10, count(*) filter (where a = 0 and b = 1) as b01
  from both_seen group by 1, 2)""") + f"""
select model_a, model_b, n as n_overlap, {_r('accuracy_a', 'accuracy_a')},
  {_r('accuracy_b', 'accuracy_b')}, {_r('delta', 'delta_b_minus_a')},
  {_r('delta - 1.96 * se', 'ci95_low')}, {_r('delta + 1.96 * se', 'ci95_high')},
  b10 as a_correct_b_wrong, b01 as a_wrong_b_correct, b10 + b01 as discordant,
  {_r('''case when b10 + b01 = 0 then 1.0 else least(1.0, 2 * (
      select sum(exp(lgamma(b10 + b01 + 1) - lgamma(i + 1) - lgamma(b10 + b01 - i + 1)
                     - (b10 + b01) * ln(2)))
      from unnest(range(0, least(b10, b01) + 1)) as r(i))) end''', 'mcnemar_exact_p')}
from stats"""

    out["decision_matrix_long"] = _with(_BASE) + """
select subject, item_id, decision from decisions where decision is not null"""

    out["vote_fraction_summary"] = _with(_BASE, f"""
votes as (
  select item_id, avg(decision) as share, count(decision) as voters from decisions
  group by 1 having count(decision) > 0),
edges as (select i, i * 0.1::double as edge from unnest(range(1, 11)) as r(i)),
binned as (
  select v.*, case when ground_truth_mapped = '{LONG}' then 1 else 0 end as true_long,
    (select min(i) from edges where v.share <= edge) as bin
  from votes v join items i on v.item_id = i.item_id)""") + f"""
select case bin when 1 then '(-0.001, 0.1]' when 2 then '(0.1, 0.2]' when 3 then '(0.2, 0.3]'
    when 4 then '(0.3, 0.4]' when 5 then '(0.4, 0.5]' when 6 then '(0.5, 0.6]'
    when 7 then '(0.6, 0.7]' when 8 then '(0.7, 0.8]' when 9 then '(0.8, 0.9]'
    else '(0.9, 1.0]' end as vote_bin,
  count(*) as n_cases, {_r('avg(share)', 'mean_long_vote_fraction')},
  {_r('avg(true_long)', 'empirical_true_long_rate')}, {_r('avg(voters)', 'mean_observed_models')}
from binned group by bin"""

    k = "p_partkey % 5"
    text = lambda c: f"case when {k} = 4 then '' else {c} end"
    flat_source = f"""
parsed as (
  select {_ITEM} as item_id, {_ITEM} as case_id,
    case when {k} in (0, 2) then 'Less than a week' end as ground_truth,
    {_MAPPED} as ground_truth_mapped,
    {text('p_brand')} as State, case when {k} = 1 then null else '' end as MSA,
    {text('p_type')} as Tenure, '' as Income,
    cast(case when {k} = 4 then null when {k} in (0, 2) and p_partkey % 17 = 0 then null
         else p_size end as double) as Occupants,
    cast(null as double) as Kids5years, cast(null as double) as Kids5_11years,
    cast(null as double) as Kids12_17years, '' as EmploymentStatus,
    {text(_DAMAGE)} as BuildingDamage, '' as DisasterType,
    case when {k} in (0, 2) then 'Never' when {k} = 4 then '' else 'A lot' end as WaterAccess,
    '' as PowerAccess, '' as FoodAccess, '' as UnsanitaryConditions
  from part)"""
    out["flattened_metadata"] = _with(flat_source, _scored("parsed", "flat")) + """
select * from flat"""

    out["severity_scores"] = _with(_BASE, _FLAT) + """
select item_id, true_long, damage_score, water_score, power_score, food_score, unsanitary_score,
  total_severity_score, severe_cues, weak_cues, severe_cues_short, weak_cues_long,
  simple_cue_label_conflict from flat"""

    numbers = ["damage_score", "water_score", "power_score", "food_score", "unsanitary_score",
               "total_severity_score"]
    out["feature_frame"] = _with(_BASE, _FLAT) + f"""
select item_id, State, Tenure, BuildingDamage, WaterAccess, PowerAccess,
  cast(coalesce(Occupants, (select quantile_cont(Occupants, 0.5) from flat)) as double)
    as Occupants, {', '.join(numbers)}
from flat"""

    out["ability_with_performance"] = _with(_BASE, _MOMENTS, _PERFORMANCE) + f"""
select a.subject as model, {_r('a.ability', 'ability')}, {_r('p.accuracy', 'accuracy')},
  {_r('p.coverage', 'coverage')}, {_r('p.balanced_accuracy', 'balanced_accuracy')},
  {_r('p.long_recall', 'long_recall')}, {_r('p.short_specificity', 'short_specificity')},
  {_r('p.predicted_long_rate', 'predicted_long_rate')}
from subject_fit a left join performance p on a.subject = p.model"""

    out["top_subjects_by_ability"] = _with(_BASE, _MOMENTS) + f"""
select subject as model, {_r('ability', 'ability')} from subject_fit
order by subject_fit.ability desc, subject limit 5"""

    out["item_difficulty_table"] = _with(_BASE, _FLAT, _MOMENTS, _TABLE) + f"""
select item_id, {_r('difficulty', 'difficulty')}, {_r('empirical_accuracy', 'empirical_accuracy')},
  {_r('empirical_difficulty', 'empirical_difficulty')}, BuildingDamage, WaterAccess, true_long,
  total_severity_score, simple_cue_label_conflict from item_table"""

    out["difficulty_decile_summary"] = _with(_BASE, _FLAT, _MOMENTS, _TABLE, """
raw_edges as (
  select unnest(quantile_cont(round(difficulty, 9), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8,
                                                     0.9, 1.0])) as e from item_table),
edges as (
  select edge, row_number() over (order by edge) - 1 as pos
  from (select distinct round(e, 9) as edge from raw_edges)),
binned as (
  select t.*, greatest(1, (select min(pos) from edges where edge >= round(t.difficulty, 9)))
    as difficulty_decile from item_table t where difficulty is not null)""") + f"""
select difficulty_decile, count(*) as n_items, {_r('avg(difficulty)', 'mean_irt_difficulty')},
  {_r('avg(empirical_accuracy)', 'empirical_accuracy')},
  {_r('avg(empirical_difficulty)', 'empirical_difficulty')},
  {_r('avg(simple_cue_label_conflict)', 'simple_cue_label_conflict')},
  {_r('avg(severe_cues_short)', 'severe_cues_short')},
  {_r('avg(weak_cues_long)', 'weak_cues_long')}, {_r('avg(damage_score)', 'damage_score')},
  {_r('avg(total_severity_score)', 'total_severity_score')}
from binned group by 1"""

    out["damage_label_difficulty"] = _with(_BASE, _FLAT, _MOMENTS, _TABLE, """
labelled as (
  select *, case when true_long = 1 then 'MoreThanAWeek' else 'LessThanAWeek' end as binary_label
  from item_table)""") + f"""
select BuildingDamage, binary_label, count(*) as n, {_r('avg(difficulty)', 'mean_irt_difficulty')},
  {_r('avg(empirical_accuracy)', 'empirical_accuracy')}, {_r('avg(true_long)', 'true_long_rate')},
  {_r('avg(simple_cue_label_conflict)', 'conflict_rate')},
  concat(BuildingDamage, ' | ', binary_label) as "group"
from labelled group by 1, 2"""

    variables = [("empirical difficulty", "empirical_difficulty"),
                 ("simple cue-label conflict", "simple_cue_label_conflict"),
                 ("total severity score", "total_severity_score"),
                 ("damage score", "damage_score")]
    long = " union all ".join(
        f"select '{label}' as variable, '{c}' as col, round(difficulty, 9) as d, "
        f"cast({'round(' + c + ', 9)' if c.startswith('empirical') else c} as double) as v "
        f"from item_table" for label, c in variables)
    ranked = _with(_BASE, _FLAT, _MOMENTS, _TABLE, f"""
long_pairs as (select * from ({long}) where d is not null and v is not null),
ranked as (
  select variable, col,
    rank() over (partition by variable order by d)
      + (count(*) over (partition by variable, d) - 1) / 2.0 as rd,
    rank() over (partition by variable order by v)
      + (count(*) over (partition by variable, v) - 1) / 2.0 as rv
  from long_pairs)""")
    out["difficulty_validity_correlations"] = ranked + f"""
select variable as construct_validity_variable, col as "column",
  {_r('corr(rd, rv)', 'spearman_corr_with_irt_difficulty')}, count(*) as n
from ranked group by 1, 2"""

    # Two-sided tail of Student's t with n - 2 degrees: the share of the integral of cos^(n-3)
    # beyond asin |r| in that over a quarter turn, by Simpson's rule with 20,000 intervals each.
    out["difficulty_validity_p_values"] = ranked + f""",
found as (select variable, abs(corr(rd, rv)) as r, count(*) as n from ranked group by 1),
nodes as (
  select cast(i as double) / 20000 as u,
    case when i in (0, 20000) then 1 when i % 2 = 1 then 4 else 2 end as w
  from range(20001) as steps(i)),
tails as (
  select variable, (1 - asin(least(r, 1)) / (pi() / 2)) * sum(w * power(greatest(
      cos(asin(least(r, 1)) + u * (pi() / 2 - asin(least(r, 1)))), 0), n - 3)) as tail,
    sum(w * power(greatest(cos(u * pi() / 2), 0), n - 3)) as whole
  from found, nodes group by variable, r, n)
select variable as construct_validity_variable, {_r('tail / whole', 'p_value')} from tails"""

    out["rasch_probability_grid"] = _with(_BASE, _MOMENTS, f"""
grid(difficulty) as (values {_values([(d,) for d in DIFFICULTIES])})""") + f"""
select subject as model, {_r('ability', 'ability')}, cast(difficulty as double) as difficulty,
  {_r('1 / (1 + exp(-(ability - difficulty)))', 'p_correct')}
from subject_fit, grid"""

    out["moment_1pl_items"] = _with(_BASE, _MOMENTS) + f"""
select item_id, {_r('empirical_accuracy', 'empirical_accuracy')}, n_observed,
  {_r('empirical_difficulty', 'empirical_difficulty')}, {_r('difficulty', 'difficulty')}
from item_fit"""

    out["moment_1pl_subjects"] = _with(_BASE, _MOMENTS) + f"""
select subject, {_r('mean_response', 'mean_response')}, n_observed, {_r('ability', 'ability')}
from subject_fit"""

    out["residual_long"] = _with(_BASE, _MOMENTS, _RESIDUALS) + f"""
select item_id, subject, {_r('z', 'z')} from residuals"""

    out["residual_gram"] = _with(_BASE, _MOMENTS, _RESIDUALS) + f"""
select a.subject as subject_a, b.subject as subject_b, {_r('sum(a.z * b.z)', 'dot', 5)}
from residuals a join residuals b on a.item_id = b.item_id and a.subject <= b.subject
group by 1, 2"""

    # Factors: a matrix squared again and again tends to the projection on its leading vector, which
    # is then taken off.
    steps = ["""
g1 as (
  select a.subject as i, b.subject as j, sum(a.z * b.z) as x
  from residuals a join residuals b on a.item_id = b.item_id group by 1, 2)"""]
    for k in range(1, 6):
        steps.append(f"""
p{k}(step, i, j, x) as (
  select 0, i, j, x / (select sum(x) from g{k} where i = j) from g{k}
  union all
  select step + 1, i, j, x / sum(case when i = j then x end) over ()
  from (select a.step, a.i, b.j, sum(a.x * b.x) as x from p{k} a join p{k} b on a.j = b.i
        where a.step < 40 group by a.step, a.i, b.j)),
c{k} as (
  select i, x / sqrt(max(case when i = j then x end) over ()) as v
  from p{k} where step = 40 and j = (select arg_max(i, x) from p{k} where step = 40 and i = j)),
v{k} as (
  select i, v * (select sign(arg_max(v, struct_pack(a := round(abs(v), 12), b := -ord(i)))) from c{k}) as v
  from c{k}),
l{k} as (
  select sum(x * a.v * b.v) as value from g{k} join v{k} a on a.i = g{k}.i join v{k} b on b.i = g{k}.j),
g{k + 1} as (
  select g{k}.i, g{k}.j, x - value * a.v * b.v as x
  from l{k}, g{k} join v{k} a on a.i = g{k}.i join v{k} b on b.i = g{k}.j)""")
    factor = _with(_BASE, _MOMENTS, _RESIDUALS, *steps).replace("with ", "with recursive ", 1)
    out["residual_factor_variance"] = factor + " union all ".join(f"""
select {k} as factor, {_r('sqrt(value)', 'singular_value')},
  {_r('value / (select sum(z * z) from residuals)', 'residual_variance_share')} from l{k}"""
        for k in range(1, 6))
    out["residual_factor_subject"] = factor + " select v1.i as model, " + ", ".join(
        _r(f"v{k}.v * power((select value from l{k}), 0.25)", f"factor{k}") for k in range(1, 6)) \
        + " from v1 " + " ".join(f"join v{k} on v{k}.i = v1.i" for k in range(2, 6))
    out["residual_factor_item"] = factor + " select item_id, " + ", ".join(
        _r(f"sum(z * v{k}.v) / power((select value from l{k}), 0.25)", f"factor{k}") for k in range(1, 6)) \
        + " from residuals " + " ".join(f"join v{k} on v{k}.i = subject" for k in range(1, 6)) \
        + " group by item_id"

    out["label_folds"] = _with(_BASE, _FLAT) + """
select item_id, true_long, (row_number() over (
    partition by true_long order by md5(concat('2026:', item_id))) - 1) % 5 as fold
from flat"""

    def metrics(source, group, y, p, accuracy="accuracy", auc_p=None):
        """CTEs `sums` and `aucs` with the probability metrics of `source` per group."""
        q = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
        return f"""
sums as (
  select {group}, count(*) as n, avg(case when ({p} >= 0.5) = ({y} = 1) then 1 else 0 end)
      as {accuracy},
    avg(({q} - {y}) * ({q} - {y})) as brier,
    -avg(case when {y} = 1 then ln({q}) else ln(1 - {q}) end) as logloss
  from {source} group by {group}),
pranks as (
  select {group}, {y} as yy, rank() over (partition by {group} order by {p})
    + (count(*) over (partition by {group}, {p}) - 1) / 2.0 as rk from {source}),
aucs as (
  select {group}, (sum(rk) filter (where yy = 1) - sum(yy) * (sum(yy) + 1) / 2)
    / nullif(sum(yy) * (count(*) - sum(yy)), 0) as auc from pranks group by {group})"""

    out["binary_metrics"] = _with(_BASE, """
share as (select item_id, avg(decision) as p from obs group by 1),
seen as (select o.subject, o.true_long, s.p from obs o join share s on o.item_id = s.item_id)""",
                                  metrics("seen", "subject", "true_long", "p")) + f"""
select s.subject, n, {_r('accuracy', 'accuracy')}, {_r('brier', 'brier')},
  {_r('logloss', 'logloss')}, {_r('auc', 'auc')}
from sums s join aucs a on s.subject = a.subject"""

    out["eligible_items"] = _with(_BASE) + """
select item_id, count(y) as n_observed from obs group by 1 having count(y) >= 10"""

    out["aligned_metadata"] = _with(_BASE) + """
select item_id, ground_truth_mapped, concat(State, '-1') as State, 1 as ordinal
from items where item_id in (select item_id from obs)"""

    out["missing_item_ids"] = _with(_BASE) + """
select distinct item_id from obs
where item_id not in (select item_id from items where State <> 'Brand#11')"""

    def held(seeds):
        return f"""
eligible as (select item_id from obs group by 1 having count(y) >= {MIN_OBSERVED}),
seeds(split) as (values {_values([(s,) for s in seeds])}),
drawn as (
  select split, item_id, row_number() over (
    partition by split order by md5(concat(cast(split as string), ':', item_id)), item_id) as rn
  from eligible, seeds),
held as (
  select split, item_id from drawn, n_items where rn <= greatest(20, n // 10))"""

    out["coldstart_split"] = _with(_BASE, held(SEEDS)) + """
select split, item_id from held"""

    out["coldstart_baselines"] = _with(_BASE, held(ALL_SEEDS), """
train_mean as (
  select s.split, o.subject, avg(o.y) as p from obs o cross join seeds s
  where not exists (select 1 from held h where h.split = s.split and h.item_id = o.item_id)
  group by 1, 2),
item_mean as (select item_id, avg(y) as p from obs group by 1),
test as (
  select h.split as seed, o.y, t.p as p1, m.p as p2
  from held h join obs o on o.item_id = h.item_id
  join train_mean t on t.split = h.split and t.subject = o.subject
  join item_mean m on m.item_id = o.item_id),
scored as (
  select seed, 'model_mean_only' as method, y, p1 as p from test
  union all select seed, 'oracle_item_mean_not_coldstart', y, p2 from test)""",
        metrics("scored", "seed, method", "y", "p", "acc_at_0p5"), f"""
ks(K) as (values {_values([(k,) for k in KS])})""") + f"""
select {_r('auc', 'auc')}, {_r('logloss', 'logloss')}, {_r('brier', 'brier')},
  {_r('acc_at_0p5', 'acc_at_0p5')}, s.method, K, s.seed,
  (select greatest(20, n // 10) from n_items) as test_items, n as n_test_responses,
  10.0::double as alpha
from sums s join aucs a on s.seed = a.seed and s.method = a.method cross join ks"""

    households = """
complete as (
  select o_orderkey as household_id,
    case o_orderkey % 3 when 0 then 'Hurricane' when 1 then 'Flood' else 'Tornado' end
      as DisasterType,
    case when o_orderkey % 2 = 0 then 'Less than a week' else 'More than a month' end
      as DisplacementDuration,
    c_mktsegment as State,
    case when o_orderkey % 2 = 0 then 'LeaveHomeForLessThanAWeek'
         else 'LeaveHomeForMoreThanAWeek' end as truth
  from orders join customer on o_custkey = c_custkey
  where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 and o_orderkey % 7 not in (0, 1, 2)
    and c_acctbal >= 0 and c_mktsegment is not null and o_orderpriority is not null
    and c_nationkey is not null)"""
    out["household_complete"] = _with(households) + " select * from complete"
    out["household_sample"] = _with(households, """
numbered as (
  select *, row_number() over (order by md5(concat('42:', cast(household_id as string)))) - 1
    as position from complete)""") + """
select * from numbered
where position >= 10 and position < (select count(*) * 3 // 4 from complete)"""
    decided = households + """,
decided as (
  select household_id, truth, case when household_id % 10 = 3 then null
    when household_id % 5 = 1 then 'LeaveHomeForLessThanAWeek' else truth end as decision
  from complete)"""
    out["agent_batch_decide"] = _with(decided) + """
select household_id, truth, decision,
  case when decision is null then 'RuntimeError' end as error_type,
  case when decision is null then 'no answer' end as error_message from decided"""
    totals = """count(*) as n_selected, count(decision) as n_decided,
  count(*) - count(decision) as n_errors, count(*) filter (where decision = truth) as n_correct,
  {} from decided""".format(_r("count(*) filter (where decision = truth) / count(decision)", "accuracy"))
    out["run_accuracy"] = _with(decided) + f" select {totals}"
    out["run_metadata"] = _with(decided) + f" select 'mock' as Model, 42 as Seed, {totals}"
    out["agent_decisions_round_trip"] = _with(decided) + """
select 'mock' as model, household_id, decision,
  row_number() over (order by household_id) - 1 as row_number
from decided where decision is not null"""

    out["response_matrix_file"] = _with(_BASE) + """
select item_id as subject, subject || ', "asked"' as item_id, y from obs"""

    out["subject_summary"] = _with(_BASE, _MOMENTS, """
totals as (
  select subject, cast(sum(y) as bigint) as correct, count(y) as observed_total from obs group by 1)
""") + f"""
select '1pl' as irt_model, a.subject as model, {_r('ability', 'ability')}, correct, observed_total,
  n - observed_total as missing_total, {_r('observed_total / n', 'coverage')},
  {_r('correct / observed_total', 'accuracy')},
  rank() over (order by a.ability desc) as ability_rank,
  rank() over (order by correct / observed_total desc) as accuracy_rank
from subject_fit a join totals t on a.subject = t.subject, n_items"""

    out["saved_table_read_back"] = _with(_BASE, _MOMENTS) + f"""
select item_id, {_r('difficulty', 'difficulty')} from item_fit"""
    return out


def all_sql():
    return _sql()

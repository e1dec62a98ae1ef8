"""Metrics, calibration, the value of asking, and paired statistics over the predictions; simple rules over the decisions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import stored
from ..functions import scoring as s
from ..functions import text
from ..operators import items, ranking
from ..sources import events as src
from .sql import DECISIONS, EVENTS, PREDICTIONS, hash32, uniform

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_P = f"""{PREDICTIONS},
soft as (select *, list_transform(logprobs, lambda x: exp(x - list_max(logprobs))) e from pred),
prob as (select *, list_transform(e, lambda x: x / list_sum(e)) p, list_position(logprobs, list_max(logprobs)) - 1 as top from soft),
probs as (select *, list_max(p) maxp, round(list_max(p), 9) c from prob)"""


@query(f"with {_P} select prediction_id, i - 1 as idx, round(p[i], 9) p from (select prediction_id, p, unnest(generate_series(1, len(p))) i from probs)")
def softmax_probs(spark, d):
    return ranking.with_probs(src.predictions(spark, d)).select("prediction_id", F.posexplode("p").alias("idx", "p")).select("prediction_id", "idx", F.round("p", 9).alias("p"))


@query(f"with {_P} select prediction_id, round(list_sum(list_transform(p, lambda x: case when x > 0 then -x * ln(x) else 0 end)), 7) as entropy, top, round(maxp, 9) maxp, case when c >= 0.6 then 'high' when c >= 0.4 then 'medium' else 'low' end as label from probs")
def prediction_entropy(spark, d):
    r = ranking.with_probs(src.predictions(spark, d))
    return r.select("prediction_id", F.round(s.entropy(F.col("p")), 7).alias("entropy"), "top", F.round("maxp", 9).alias("maxp"), s.confidence_label(F.round("maxp", 9)).alias("label"))


@query(f"with {PREDICTIONS} select arm, user_id, count(*) n, avg(coalesce(pick = answer_idx, false)::int) acc from pred group by 1, 2")
def per_user_accuracy(spark, d):
    return ranking.user_accuracy(src.predictions(spark, d), "arm")


@query(
    f"""with {PREDICTIONS}, u as (select arm, user_id, count(*) n, sum(coalesce(pick = answer_idx, false)::int) hits, count(*) filter (where pick is null) unparsed from pred group by 1, 2)
    select arm, cast(sum(n) as bigint) n, round(sum(hits) / sum(n), 9) micro, round(avg(hits / n), 9) macro, round(sum(unparsed) / sum(n), 9) unparsed from u group by arm"""
)
def micro_macro_accuracy(spark, d):
    return ranking.micro_macro(src.predictions(spark, d))


@query(
    f"""with {PREDICTIONS}, r as (select arm, 1 + len(list_filter(logprobs, lambda x: x > logprobs[answer_idx + 1])) r from pred)
    select arm, count(*) n, round(avg((r <= 1)::int), 9) acc_at_1, round(avg((r <= 2)::int), 9) acc_at_2, round(avg((r <= 3)::int), 9) acc_at_3, round(avg(1 / r), 9) mrr from r group by arm"""
)
def acc_at_k_mrr(spark, d):
    return ranking.rank_metrics(src.predictions(spark, d))


@query(f"with {PREDICTIONS}, c as (select arm, answer_idx, count(*) n from pred group by 1, 2) select arm, cast(sum(n) as bigint) n, round(max(n) / sum(n), 9) majority from c group by arm")
def majority_letter(spark, d):
    """Accuracy of always choosing the most frequent answer place."""
    c = src.predictions(spark, d).groupBy("arm", "answer_idx").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("arm").agg(F.sum("n").alias("n"), F.round(F.max("n") / F.sum("n"), 9).alias("majority"))


_BINS = f"""{_P},
binned as (select *, (c >= 0)::int + (c >= 0.3)::int + (c >= 0.4)::int + (c >= 0.5)::int + (c >= 0.6)::int + (c >= 0.7)::int + (c >= 0.8)::int b from probs),
bins as (select arm, [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8][b]::double lo, count(*) n, round(avg(c), 7) mean_conf, round(avg((top = answer_idx)::int), 9) accuracy from binned group by arm, b)"""


@query(f"with {_BINS} select * from bins")
def reliability_bins(spark, d):
    return ranking.reliability(src.predictions(spark, d))


@query(f"with {_BINS} select arm, round(sum(n * abs(mean_conf - accuracy)) / sum(n), 7) ece from bins group by arm")
def ece(spark, d):
    return ranking.ece(ranking.reliability(src.predictions(spark, d)))


@query(
    f"""with {_P}, w as (select arm, level, count(*) n, count(*) filter (where top <> answer_idx and c >= level) n_wrong from probs cross join (select unnest([0.5, 0.6, 0.7, 0.8])::double as level) group by 1, 2)
    select arm, level, n_wrong, round(n_wrong / n, 9) as share from w"""
)
def confidently_wrong(spark, d):
    return ranking.confidently_wrong(src.predictions(spark, d))


_NLL = f"""{PREDICTIONS}, z as (select *, cast('0x' || right(sha256(user_id), 1) as int) % 2 fold, list_transform(logprobs, lambda x: x - list_max(logprobs)) z from pred),
grid as (select i step, 0.25 * pow(200.0, i / 199) temperature from (select unnest(generate_series(0, 199)) i))"""


def _nll(by: str) -> str:
    return f"""losses as (select {by}, step, temperature, avg(least(ln(list_sum(list_transform(z, lambda x: exp(x / temperature)))) - z[answer_idx + 1] / temperature, 690.7755278982137)) nll from z cross join grid group by {by}, step, temperature),
    best as (select {by}, arg_min(temperature, (round(nll, 9), step)) temperature, arg_min(nll, (round(nll, 9), step)) nll from losses group by {by})"""


@query(f"with {_NLL}, {_nll('arm')} select arm, round(temperature, 9) temperature, round(nll, 7) nll from best")
def temperature_fit(spark, d):
    return ranking.fit_temperature(src.predictions(spark, d), "arm")


@query(f"with {_NLL}, {_nll('arm, fold')} select arm, 1 - fold as fold, round(temperature, 9) temperature, round(nll, 7) nll from best")
def crossfit_temps(spark, d):
    return ranking.crossfit_temperature(src.predictions(spark, d))


@query(f"with {PREDICTIONS} select distinct user_id, cast('0x' || right(sha256(user_id), 1) as int) % 2 as fold from pred")
def fold_of_user(spark, d):
    return src.predictions(spark, d).select("user_id").distinct().withColumn("fold", s.fold_of(F.col("user_id")))


# --- value of asking -------------------------------------------------------------------------------------------------

_CATS = f"""{EVENTS}, {DECISIONS},
meta as (select item, nullif(arg_max(coalesce(cat, ''), seq), '') cat from ev where cat is not null or name is not null group by item),
valid as (select * from dec where user_id is not null and len(candidates) = 5 and len(list_filter(candidates, lambda c: c is not null)) = 5),
slots as (select v.decision_id, i idx, m.cat from (select decision_id, candidates, unnest(generate_series(0, 4)) i from valid) v left join meta m on m.item = v.candidates[i + 1]),
cats as (select decision_id, list(cat order by idx) cats from slots group by 1)"""

_MENU = f"""{_CATS}, {_P},
rec as (select p.*, c.cats from probs p join cats c on p.decision_id = c.decision_id where len(p.logprobs) = 5),
cells as (select prediction_id, i idx, p[i + 1] p, cats[i + 1] cat, maxp from (select prediction_id, p, cats, maxp, unnest(generate_series(0, 4)) i from rec)),
asked as (select c.prediction_id, q.cat, sum(case when c.cat is not distinct from q.cat then c.p else 0 end) py, count(*) filter (where c.cat is not distinct from q.cat) n_yes,
    max(case when c.cat is not distinct from q.cat then c.p else 0 end) + max(case when c.cat is not distinct from q.cat then 0 else c.p end) - max(c.maxp) evpi
  from cells c join (select distinct prediction_id, cat from cells where cat is not null) q on c.prediction_id = q.prediction_id group by 1, 2),
menu as (select *, -(py * ln(py) + (1 - py) * ln(1 - py)) ig from asked where py > 0 and py < 1 and n_yes < 5)"""


def option_categories(spark: SparkSession, d: str) -> DataFrame:
    """decision_id, cats: the categories of the five options, in order, of decisions that have five."""
    meta = items.metadata(src.events(spark, d)).select("item", "cat")
    dec = src.decisions(spark, d).filter("user_id is not null and size(candidates) = 5 and not exists(candidates, c -> c is null)")
    slots = dec.select("decision_id", F.posexplode("candidates").alias("idx", "item")).join(meta, "item", "left")
    return slots.groupBy("decision_id").agg(F.sort_array(F.collect_list(F.struct("idx", "cat"))).alias("_c")).select("decision_id", F.col("_c.cat").alias("cats"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    preds = src.predictions(spark, d).filter("size(logprobs) = 5")
    return ranking.records(preds, option_categories(spark, d))


def _question(by: str) -> str:
    return f"with {_MENU} select prediction_id, cat, round(ig, 7) ig, round(evpi, 7) evpi from (select *, row_number() over (partition by prediction_id order by -round({by}, 12), cat) k from menu) where k = 1"


def _best(spark, d, by):
    r = _records(spark, d).withColumn("b", s.best_question(F.col("menu"), by)).filter("b is not null")
    return r.select("prediction_id", "b.cat", F.round("b.ig", 7).alias("ig"), F.round("b.evpi", 7).alias("evpi"))


@query(_question("ig"))
def ig_question(spark, d):
    """The category whose question tells most about the answer."""
    return _best(spark, d, "ig")


@query(_question("evpi"))
def evpi_question(spark, d):
    """The category whose question raises the expected accuracy most."""
    return _best(spark, d, "evpi")


@query(
    f"""with {_MENU}, firsts as (select prediction_id, cat, min(idx) pos from cells where cat is not null group by 1, 2),
    ranked as (select m.prediction_id, m.cat, m.evpi, f.pos, row_number() over (partition by m.prediction_id order by -round(m.evpi, 12), f.pos) k from menu m join firsts f on f.prediction_id = m.prediction_id and f.cat = m.cat)
    select prediction_id, cat, cast(pos as int) pos, round(evpi, 7) evpi from ranked where k = 1"""
)
def menu_question(spark, d):
    """The question of the largest gain when the menu is in the options' order, and the first of equals is taken."""
    r = _records(spark, d)
    placed = F.transform("menu", lambda q: F.struct((-F.round(q["evpi"], 12)).alias("s"), (F.array_position("cats", q["cat"]) - 1).cast("int").alias("pos"), q["cat"].alias("cat"), q["evpi"].alias("evpi")))
    return r.withColumn("b", F.array_min(placed)).filter("b is not null").select("prediction_id", "b.cat", "b.pos", F.round("b.evpi", 7).alias("evpi"))


@query(f"with {PREDICTIONS} select prediction_id, cast(i - 1 as int) idx, case when logprobs[i] > -30 then logprobs[i] else -30.0::double end lp from (select prediction_id, logprobs, unnest(generate_series(1, 5)) i from pred where len(logprobs) = 5)")
def letter_logprobs(spark, d):
    """Log-probabilities read back from token lists in which letters come with blanks, twice, and among other tokens."""
    p = src.predictions(spark, d).filter("size(logprobs) = 5")
    letter = lambda i: F.substring(F.lit(text.LETTERS), i + 1, F.lit(1))
    own = F.transform("logprobs", lambda x, i: F.struct(F.concat(F.when(i % 2 == 0, " ").otherwise(""), letter(i)).alias("token"), x.alias("logprob")))
    worse = F.transform("logprobs", lambda x, i: F.struct(letter(i).alias("token"), (x - 1).alias("logprob")))
    other = F.array(F.struct(F.lit("The").alias("token"), F.lit(-0.01).alias("logprob")))
    return p.select("prediction_id", F.posexplode(text.letter_logprobs(F.concat(other, worse, own))).alias("idx", "lp"))


_REC = f"""{_MENU},
quest as (select * from (select *, row_number() over (partition by prediction_id order by -round(ig, 12), cat) k from menu) where k = 1),
full_rec as (select r.*, q.cat q_cat, q.py, greatest(0, coalesce(q.evpi, 0)) gain, coalesce(r.cats[answer_idx + 1] = q.cat, false) truth from rec r left join quest q on r.prediction_id = q.prediction_id),
sides as (select *, unnest(generate_series(0, 4)) i from full_rec),
kept as (select prediction_id, i, case when q_cat is null then p[i + 1] when coalesce(cats[i + 1] = q_cat, false) = truth then p[i + 1] else 0 end x from sides),
mass as (select prediction_id, sum(x) m from kept group by 1),
post as (select k.prediction_id, i, round(case when m > 0 then (case when s.q_cat is null then x else x / m end) else s.p[i + 1] end, 12) x from kept k join mass m on k.prediction_id = m.prediction_id join full_rec s on s.prediction_id = k.prediction_id),
picks as (select prediction_id, arg_min(i, (-x, i)) pick_ask from post group by 1),
records as (select f.*, pick_ask from full_rec f join picks p on f.prediction_id = p.prediction_id)"""


@query(f"with {_REC} select prediction_id, top, round(maxp, 9) maxp, q_cat, round(gain, 7) gain, pick_ask, top = answer_idx as right_plain, pick_ask = answer_idx as right_asked from records")
def decision_records(spark, d):
    return _records(spark, d).select(
        "prediction_id", "top", F.round("maxp", 9).alias("maxp"), F.col("q.cat").alias("q_cat"), F.round("gain", 7).alias("gain"), "pick_ask",
        (F.col("top") == F.col("answer_idx")).alias("right_plain"), (F.col("pick_ask") == F.col("answer_idx")).alias("right_asked"),
    )


@query(f"with {_REC} " + " union all ".join(f"select arm, {q}::double rate, round(quantile_cont(gain, {1 - q!r}), 7) tau_gain, round(quantile_cont(maxp, {q}), 7) tau_confidence from records group by arm" for q in (0.3, 0.5, 0.7)))
def ask_thresholds(spark, d):
    """Thresholds of gain and of confidence at which a share `rate` of the decisions is asked."""
    r = stored(_records(spark, d).select("arm", "gain", "maxp"))
    rates = (0.3, 0.5, 0.7)
    g = ranking.middle_values(r, "gain", "arm", {f"g{k}": 1 - q for k, q in enumerate(rates)})
    m = ranking.middle_values(r, "maxp", "arm", {f"m{k}": q for k, q in enumerate(rates)})
    rows = F.array(*(F.struct(F.lit(q).alias("rate"), F.round(f"g{k}", 7).alias("tau_gain"), F.round(f"m{k}", 7).alias("tau_confidence")) for k, q in enumerate(rates)))
    return g.join(m, "arm").select("arm", F.inline(rows))


def _curve(trigger: str, order: str) -> str:
    return f"""select arm, rate, round(avg(case when k <= round_even(rate * n, 0) then asked else plain end), 9) accuracy, '{trigger}' as trigger
    from (select arm, (top = answer_idx)::int plain, (pick_ask = answer_idx)::int asked, row_number() over (partition by arm order by {order}, prediction_id) k, count(*) over (partition by arm) n from records)
    cross join (select unnest(generate_series(0, 10)) / 10 as rate) group by arm, rate"""


_CURVES = " union all ".join((_curve("value", "round(-gain, 9)"), _curve("confidence", "c"), _curve("random", hash32("'0'", "arm", "cast(prediction_id as varchar)"))))


@query(f"with {_REC} {_CURVES}")
def ask_curve(spark, d):
    """Accuracy when a growing share of the decisions is asked, by three triggers."""
    return ranking.ask_curve(_records(spark, d))


@query(
    f"""with {_REC}, curves as ({_CURVES}), w as (select arm, max(accuracy) filter (trigger = 'value') by_value, max(accuracy) filter (trigger = 'confidence') by_confidence, max(accuracy) filter (trigger = 'random') by_chance, rate from curves where rate = 0.5 group by arm, rate)
    select arm, by_value, by_confidence, by_chance, round(by_value - by_chance, 9) over_chance from w"""
)
def trigger_comparison(spark, d):
    """The three triggers at one half, side by side."""
    c = ranking.ask_curve(_records(spark, d), rates=(0.5,))
    w = c.groupBy("arm").agg(*(F.max(F.when(F.col("trigger") == t, F.col("accuracy"))).alias(n) for t, n in (("value", "by_value"), ("confidence", "by_confidence"), ("random", "by_chance"))))
    return w.withColumn("over_chance", F.round(F.col("by_value") - F.col("by_chance"), 9))


@query(
    f"""with {_REC}, curves as ({_CURVES}), binned as (select *, (c >= 0)::int + (c >= 0.3)::int + (c >= 0.4)::int + (c >= 0.5)::int + (c >= 0.6)::int + (c >= 0.7)::int + (c >= 0.8)::int b from probs), bins as (select arm, count(*) n, round(avg(c), 7) mean_conf, round(avg((top = answer_idx)::int), 9) accuracy from binned group by arm, b),
    e as (select arm, round(sum(n * abs(mean_conf - accuracy)) / sum(n), 7) ece from bins group by arm),
    v as (select c.arm, c.accuracy as value, e.ece, case c.arm when 'zero_shot' then 0 when 'distance_cue' then 1 else 2 end simplicity from curves c join e on c.arm = e.arm where rate = 0.5 and trigger = 'value')
    select arm, value, ece, simplicity from v where ece <= 1 and value > (select max(value) from v where ece <= 1) - 0.01 order by simplicity limit 1"""
)
def arm_selection(spark, d):
    """The simplest arm within a hundredth of the best value among those that are well calibrated."""
    value = ranking.ask_curve(_records(spark, d), rates=(0.5,)).filter("trigger = 'value'").select("arm", F.col("accuracy").alias("value"))
    simple = F.when(F.col("arm") == "zero_shot", 0).when(F.col("arm") == "distance_cue", 1).otherwise(2)
    return ranking.select_arm(value.join(ranking.ece(ranking.reliability(src.predictions(spark, d))), "arm").withColumn("simplicity", simple), most_ece=1.0)


@query(SQL["arm_selection"].replace("ece <= 1 ", "ece <= 0.3 ").replace("ece <= 1)", "ece <= 0.3)"))
def calibrated_arm(spark, d):
    """The same among the arms whose calibration error is at most 0.3."""
    value = ranking.ask_curve(_records(spark, d), rates=(0.5,)).filter("trigger = 'value'").select("arm", F.col("accuracy").alias("value"))
    simple = F.when(F.col("arm") == "zero_shot", 0).when(F.col("arm") == "distance_cue", 1).otherwise(2)
    return ranking.select_arm(value.join(ranking.ece(ranking.reliability(src.predictions(spark, d))), "arm").withColumn("simplicity", simple), most_ece=0.3)


@query(
    f"""with {_REC}, t as (select arm, median(gain) tau from records group by arm),
    plays as (select r.prediction_id, r.arm, policy, (case policy when 'never' then false when 'always' then true else gain >= tau end) and q_cat is not null asks, top, pick_ask, answer_idx
      from records r join t on r.arm = t.arm cross join (select unnest(['never', 'unsure', 'always']) policy))
    select arm, policy, count(*) n, count(*) filter (where asks) n_asked, round(avg(((case when asks then pick_ask else top end) = answer_idx)::int), 9) accuracy from plays group by 1, 2"""
)
def replay_policies(spark, d):
    """Every decision replayed under three policies: never ask, ask from the median gain on, always ask."""
    r = _records(spark, d)
    r = stored(r.select("arm", "q", "gain", "top", "pick_ask", "answer_idx"))
    tau = ranking.middle_values(r, "gain", "arm", {"tau": 0.5})
    policies = F.array(*(F.struct(F.lit(n).alias("policy"), F.lit(a).alias("ask_all"), F.lit(u).alias("uses")) for n, a, u in (("never", False, False), ("unsure", False, True), ("always", True, False))))
    x = r.join(F.broadcast(tau), "arm").select("arm", "q", "gain", "tau", "top", "pick_ask", "answer_idx", F.inline(policies))  # one row an arm
    asks = s.should_ask(F.col("ask_all"), F.when(F.col("uses"), F.col("tau")), F.col("gain")) & F.col("q").isNotNull()
    x = x.withColumn("asks", asks).withColumn("final", F.when(F.col("asks"), F.col("pick_ask")).otherwise(F.col("top")))
    return x.groupBy("arm", "policy").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("n_asked"), ranking.share(F.col("final") == F.col("answer_idx")).alias("accuracy"))


@query(
    f"""with {_CATS}, {PREDICTIONS}, past as (select decision_id, unnest(history) item from dec where user_id is not null),
    hc as (select p.decision_id, m.cat from past p join meta m on p.item = m.item where m.cat is not null group by 1, 2),
    w as (select p.prediction_id, p.arm, c.cats[p.pick + 1] pc, c.cats[p.answer_idx + 1] ac, p.decision_id from pred p join cats c on p.decision_id = c.decision_id where p.pick <> p.answer_idx),
    k as (select w.*, pc is not null and (select count(*) from hc where hc.decision_id = w.decision_id and hc.cat = w.pc) > 0 pf, ac is not null and (select count(*) from hc where hc.decision_id = w.decision_id and hc.cat = w.ac) > 0 af from w)
    select arm, case when coalesce(pc = ac, false) then 'same kind' when pf and not af then 'habit pull' when pf and af then 'both familiar' when af then 'missed familiar' else 'both new' end pattern, count(*) n from k group by 1, 2"""
)
def error_patterns(spark, d):
    """Wrong picks by whether the picked and the true category occur in the history."""
    meta = items.metadata(src.events(spark, d)).select("item", "cat").filter("cat is not null")
    past = src.decisions(spark, d).filter("user_id is not null").select("decision_id", F.explode("history").alias("item")).join(meta, "item")
    familiar = past.groupBy("decision_id").agg(F.collect_set("cat").alias("known"))  # at most a history's length
    wrong = src.predictions(spark, d).filter("pick <> answer_idx").join(option_categories(spark, d), "decision_id").join(familiar, "decision_id", "left")
    w = wrong.withColumn("pc", F.get("cats", "pick")).withColumn("ac", F.get("cats", "answer_idx"))
    knows = lambda c: F.coalesce(F.array_contains("known", F.col(c)), F.lit(False))
    pattern = F.when(F.col("pc") == F.col("ac"), "same kind").when(knows("pc") & ~knows("ac"), "habit pull").when(knows("pc") & knows("ac"), "both familiar").when(knows("ac"), "missed familiar").otherwise("both new")
    return w.groupBy("arm", pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


# --- paired statistics -----------------------------------------------------------------------------------------------

_PAIR = f"""{PREDICTIONS}, one as (select decision_id, user_id, arm, arg_min(coalesce(pick = answer_idx, false), prediction_id) ok, arg_min(coalesce(pick, -1), prediction_id) pick from pred group by 1, 2, 3),
pair as (select a.decision_id, a.user_id, a.ok ok_a, b.ok ok_b, a.pick pick_a, b.pick pick_b from one a join one b on a.decision_id = b.decision_id where a.arm = 'zero_shot' and b.arm = 'fine_tuned')"""


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that both arms predicted, by their first predictions."""
    p = src.predictions(spark, d).groupBy("decision_id", "user_id", "arm").agg(F.min_by(ranking.is_right(), "prediction_id").alias("ok"), F.min_by(F.coalesce("pick", F.lit(-1)), "prediction_id").alias("pick"))
    side = lambda arm, x: p.filter(F.col("arm") == arm).select("decision_id", "user_id", F.col("ok").alias(f"ok_{x}"), F.col("pick").alias(f"pick_{x}"))
    return side("zero_shot", "a").join(side("fine_tuned", "b"), ["decision_id", "user_id"])


@query(f"with {_PAIR} select ok_a, ok_b, count(*) n from pair group by 1, 2")
def flip_table(spark, d):
    return _paired(spark, d).groupBy("ok_a", "ok_b").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_PAIR} select count(*) n, count(*) filter (where pick_a <> pick_b) n_changed, round(avg((pick_a = pick_b)::int), 9) agreement, round(avg((pick_a = 0)::int), 9) first_letter_a, round(avg((pick_b = 0)::int), 9) first_letter_b from pair")
def pick_agreement(spark, d):
    return _paired(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pick_a") != F.col("pick_b")).alias("n_changed"), ranking.share(F.col("pick_a") == F.col("pick_b")).alias("agreement"), ranking.share(F.col("pick_a") == 0).alias("first_letter_a"), ranking.share(F.col("pick_b") == 0).alias("first_letter_b"))


_DELTA = f"{_PAIR}, delta as (select user_id, count(*) n, avg(ok_b::int) - avg(ok_a::int) delta, sum(ok_b::int - ok_a::int) net from pair group by 1)"


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("ok_b").cast("double")) - F.avg(F.col("ok_a").cast("double"))).alias("delta"), F.sum(F.col("ok_b").cast("int") - F.col("ok_a").cast("int")).alias("net"))


@query(f"with {_DELTA} select user_id, n, round(delta, 9) delta from delta")
def paired_deltas(spark, d):
    return _deltas(spark, d).select("user_id", "n", F.round("delta", 9).alias("delta"))


#: A Poisson(1) number from a uniform one, by its distribution function.
_WEIGHT = " + ".join(f"(u >= {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r})::int" for k in range(8))


def _boot(unit_sql: str, sf: str) -> str:
    return f"""units as ({unit_sql}), weighted as (select draw, a, b, {_WEIGHT} w from (select *, {uniform("'0'", 'cast(draw as varchar)', 'user_id')} u from units cross join (select unnest(generate_series(0, 999)) draw))),
    draws as (select draw, sum(w * a) / nullif(sum(w * b), 0) as value from weighted group by draw)
    select {sf}, round(quantile_cont(value, 0.025), 9) lo, round(quantile_cont(value, 0.975), 9) hi from draws"""


@query(f"with {_DELTA}, {_boot('select user_id, delta a, 1.0 b from delta', '(select round(avg(delta), 9) from delta) mean')}")
def bootstrap_ci(spark, d):
    """Mean of the users' differences with a 95 % interval, users weighted by Poisson numbers fixed by their hash."""
    u = stored(_deltas(spark, d))
    ci = ranking.interval(ranking.poisson_bootstrap(u, "user_id", F.col("delta"), F.lit(1.0)))
    return u.agg(F.round(F.avg("delta"), 9).alias("mean")).crossJoin(ci)


@query(f"with {_DELTA}, {_boot('select user_id, net a, n b from delta', '(select round(sum(net) / sum(n), 9) from delta) mean')}")
def bootstrap_ci_pooled(spark, d):
    """The same over decisions: a ratio of sums, resampled by user."""
    u = stored(_deltas(spark, d))
    ci = ranking.interval(ranking.poisson_bootstrap(u, "user_id", F.col("net"), F.col("n")))
    return u.agg(F.round(F.try_divide(F.sum("net"), F.sum("n")), 9).alias("mean")).crossJoin(ci)


@query(f"with {_DELTA} select count(*) filter (where delta > 0) n_up, count(*) filter (where delta < 0) n_down, count(*) filter (where delta = 0) n_same, case when count(*) filter (where delta > 0) > count(*) filter (where delta < 0) then 'up' when count(*) filter (where delta > 0) < count(*) filter (where delta < 0) then 'down' else 'even' end verdict from delta")
def sign_counts(spark, d):
    """Users that gained and lost; sign_test_p has the exact p of the two counts."""
    up, down = F.count_if(F.col("delta") > 0), F.count_if(F.col("delta") < 0)
    return _deltas(spark, d).agg(up.alias("n_up"), down.alias("n_down"), F.count_if(F.col("delta") == 0).alias("n_same"), F.when(up > down, "up").when(up < down, "down").otherwise("even").alias("verdict"))


_COUNTS = f"{_DELTA}, c as (select count(*) filter (where delta > 0) up, count(*) filter (where delta < 0) down from delta)"


@query(f"with {_COUNTS} select up n_up, down n_down, round(least(1.0, 2 * (select sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2))) from (select unnest(generate_series(0, least(up, down))) i))), 9) p from c")
def sign_test_p(spark, d):
    """Exact two-sided p of as many users gaining and losing, were both equally likely."""
    c = _deltas(spark, d).agg(F.count_if(F.col("delta") > 0).alias("n_up"), F.count_if(F.col("delta") < 0).alias("n_down"))
    return c.withColumn("p", F.round(ranking.sign_test(F.col("n_up"), F.col("n_down")), 9))


@query(
    f"""with {_DELTA}, few as (select delta, row_number() over (order by user_id) k from delta order by user_id limit 5),
    m as (select (a.delta + b.delta + c.delta + d.delta + e.delta) / 5 m from few a cross join few b cross join few c cross join few d cross join few e)
    select count(*) n_resamples, round(avg(m), 9) mean, round(quantile_cont(m, 0.025), 9) lo, round(quantile_cont(m, 0.975), 9) hi from m"""
)
def exact_bootstrap(spark, d):
    """All 3,125 resamples of the first five users' differences: the known answer that sampled intervals are held against."""
    five = _deltas(spark, d).orderBy("user_id").limit(5).select("delta")
    x = five.select(F.col("delta").alias("m"))
    for _ in range(4):
        x = x.crossJoin(F.broadcast(five)).select((F.col("m") + F.col("delta")).alias("m"))  # five rows
    m = F.col("m") / 5
    return x.agg(F.count(F.lit(1)).alias("n_resamples"), F.round(F.avg(m), 9).alias("mean"), F.round(F.percentile(m, F.lit(0.025)), 9).alias("lo"), F.round(F.percentile(m, F.lit(0.975)), 9).alias("hi"))


@query(
    f"""with {_P}, w as (select user_id, prediction_id, c, row_number() over (partition by user_id order by c desc, prediction_id) k from probs where top <> answer_idx)
    select user_id, prediction_id, c as confidence from w where k = 1 order by c desc, prediction_id limit 10"""
)
def one_per_user_top10(spark, d):
    """The ten most confident errors, one a user."""
    w = ranking.with_probs(src.predictions(spark, d)).filter("top <> answer_idx").select("user_id", "prediction_id", F.round("maxp", 9).alias("confidence"))
    best = w.groupBy("user_id").agg(F.min_by(F.struct("prediction_id", "confidence"), F.struct(-F.col("confidence"), "prediction_id")).alias("b"))
    return best.select("user_id", "b.prediction_id", "b.confidence").orderBy(F.desc("confidence"), "prediction_id").limit(10)

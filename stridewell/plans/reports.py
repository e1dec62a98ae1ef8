"""Reports on predictions and decisions as an application or an evaluation shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import stored
from ..functions.scoring import confidence_label, rank_of
from ..operators import checks, items, ranking, recommend, serving, timeline
from ..operators.sampling import hash32
from ..sources import events as src
from ..sources.tables import table
from . import rules, scores, service
from .scores import _CATS, _CURVES, _P, _REC
from .sql import DECISIONS, EVENTS, LINES, PREDICTIONS
from .sql import hash32 as hash_sql
from .texts import _DOCS, _LABELS, history_labels

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n_rows() -> Column:
    return F.count(F.lit(1))


def _preds(spark: SparkSession, d: str) -> DataFrame:
    return ranking.with_probs(src.predictions(spark, d)).withColumn("c", F.round("maxp", 9))


# --- one decision --------------------------------------------------------------------------------------------------

@query(
    f"""with {_P}, o as (select prediction_id, i - 1 idx, p[i] p, pick from (select *, unnest(generate_series(1, len(p))) i from probs))
    select prediction_id, cast(idx as int) idx, cast(row_number() over (partition by prediction_id order by -round(p, 12), idx) as int) place from o where round(p, 12) > 0 and idx is distinct from pick"""
)
def option_ranking(spark, d):
    """The options after the pick is put out, likeliest first."""
    r = _preds(spark, d).select("prediction_id", F.posexplode(serving.ranking(F.col("p"), F.array("pick"))).alias("place", "idx"))
    return r.select("prediction_id", "idx", (F.col("place") + 1).alias("place"))


_TENTHS = f"{_P}, tenths as (select *, cast(least(9, floor(round(c * 10, 9))) as int) bin from probs), cards as (select arm, bin, count(*) n, avg((top = answer_idx)::int) accuracy, avg(c) mean_conf from tenths group by 1, 2)"


@query(f"with {_TENTHS} select arm, bin, bin / 10 lo, n, round(mean_conf, 7) mean_conf, round(accuracy, 9) accuracy from cards")
def reliability_tenths(spark, d):
    """Accuracy by tenths of confidence."""
    return serving.equal_bins(_preds(spark, d)).select("arm", "bin", "lo", "n", F.round("mean_conf", 7).alias("mean_conf"), F.round("accuracy", 9).alias("accuracy"))


@query(f"with {_TENTHS} select t.prediction_id, k.n n_similar, case when k.n >= 30 then round(k.accuracy, 9) end match_rate from tenths t join cards k on t.arm = k.arm and t.bin = k.bin")
def match_rates(spark, d):
    """How often picks of like confidence were right, where there are at least thirty."""
    p = stored(_preds(spark, d).select("prediction_id", "arm", "c", "top", "answer_idx"))
    return serving.with_match_rate(p, serving.equal_bins(p)).select("prediction_id", "n_similar", F.round("match_rate", 9).alias("match_rate"))


@query(
    f"""with {_TENTHS} select t.prediction_id, t.top pick, case when c >= 0.6 then 'high' when c >= 0.4 then 'medium' else 'low' end as label, cast(floor(c * 100 + 0.5) as int) || '%' as sure,
    case when k.n >= 30 then ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'][cast(floor(round(k.accuracy, 9) * 10 + 0.5) as int) + 1] end matched_out_of_10 from tenths t join cards k on t.arm = k.arm and t.bin = k.bin"""
)
def decision_views(spark, d):
    """What a person is told about each pick: the option, how sure it is, and the match rate of similar picks in tens."""
    p = stored(_preds(spark, d).select("prediction_id", "arm", "c", "p", "top", "answer_idx"))
    v = serving.with_match_rate(p, serving.equal_bins(p))
    tens = serving.half_up(F.round("match_rate", 9) * 10)
    return v.select("prediction_id", F.get(serving.ranking(F.col("p")), F.lit(0)).alias("pick"), confidence_label(F.col("c")).alias("label"), serving.percent(F.col("c")).alias("sure"), serving.number_word(tens).alias("matched_out_of_10"))


@query(
    f"""with {_REC}, t as (select arm, median(gain) tau from records group by arm), r as (select x.arm, count(*) n, count(*) filter (where gain >= tau and q_cat is not null) n_asked, round(count(*) filter (where gain >= tau and q_cat is not null) / count(*), 9) rate from records x join t on x.arm = t.arm group by 1)
    select arm, rate, case when rate >= 1 then 'Asks before every pick' when rate > 0 then case when floor(rate * 10 + 0.5) <= 0 then 'Asks less than once in 10 times' when floor(rate * 10 + 0.5) >= 10 then 'Asks almost every time' else 'Asks about ' || cast(floor(rate * 10 + 0.5) as int) || ' in 10 times' end else 'Picks without asking' end said,
      regexp_replace(cast(n_asked as varchar), '(\\d)(\\d\\d\\d)$', '\\1,\\2') || case when n_asked = 1 then ' question' else ' questions' end asked from r"""
)
def ask_rate_texts(spark, d):
    """How often each arm asks when it does so from the median gain on, in words."""
    r = stored(scores._records(spark, d).select("arm", "gain", F.col("q").isNotNull().alias("has")))
    tau = ranking.middle_values(r, "gain", "arm", {"tau": 0.5})
    x = r.join(F.broadcast(tau), "arm").groupBy("arm").agg(n_rows().alias("n"), F.count_if((F.col("gain") >= F.col("tau")) & F.col("has")).alias("n_asked"))  # one row an arm
    x = x.withColumn("rate", F.round(F.col("n_asked") / F.col("n"), 9))
    return x.select("arm", "rate", serving.ask_rate_text(F.col("rate")).alias("said"), serving.counted(F.col("n_asked"), "question", "questions").alias("asked"))


_FLOW = f"""with recursive {service._REQ}, steps as (select user_id, t // 86400 as day, row_number() over (partition by user_id, t // 86400 order by event_id) rn, case when event_type in ('error', 'view') then 'reject' when event_type = 'click' then 'select' else 'accept' end kind,
      cast({hash_sql("'0'", "cast(event_id as varchar)")} % 5 as int) pos from req where user_id is not null),
    f(user_id, day, rn, cur, gone, done, own) as (select distinct user_id, day, 0::bigint, 0, []::int[], false, false from steps
      union all select s.user_id, s.day, s.rn, case when not f.done and kind = 'reject' and f.cur is not null then list_min(list_filter([0, 1, 2, 3, 4], lambda p: not list_contains(list_append(f.gone, f.cur), p))) when not f.done and kind = 'select' and not list_contains(f.gone, pos) then pos else f.cur end,
        case when not f.done and kind = 'reject' and f.cur is not null then list_append(f.gone, f.cur) else f.gone end, f.done or (kind = 'accept' and f.cur is not null),
        case when not f.done and kind = 'reject' and f.cur is not null then false when not f.done and kind = 'select' and not list_contains(f.gone, pos) then pos <> 0 else f.own end
      from f join steps s on s.user_id = f.user_id and s.day = f.day and s.rn = f.rn + 1)"""


@query(f"{_FLOW} select user_id, day, arg_max(struct_pack(v := cur), rn).v as current, len(arg_max(gone, rn))::int n_rejected, arg_max(done, rn) accepted, arg_max(own, rn) by_user from f group by 1, 2")
def decision_flows(spark, d):
    """Where people end who reject, select and accept options, their requests of a day read as steps on five options."""
    r = service.requests(spark, d).filter("user_id is not null")
    kind = F.when(F.col("event_type").isin("error", "view"), "reject").when(F.col("event_type") == "click", "select").otherwise("accept")
    step = F.struct("event_id", kind.alias("kind"), F.pmod(hash32(0, "event_id"), F.lit(5)).cast("int").alias("position"))
    days = r.groupBy("user_id", F.expr("t div 86400").alias("day")).agg(F.array_sort(F.collect_list(step)).alias("steps"))  # one user's requests of one day
    return days.select("user_id", "day", serving.choice_after(F.col("steps"), F.lit(5)).alias("s")).select("user_id", "day", "s.*")


# --- evaluation ----------------------------------------------------------------------------------------------------

_KIND = f"""{PREDICTIONS}, {DECISIONS}, kinds as (select p.arm, p.user_id, coalesce(p.pick = p.answer_idx, false) ok, case when list_contains(d.history, d.true_item) then 'revisit' else 'novel' end kind from pred p join dec d on p.decision_id = d.decision_id where d.true_item is not null)"""


@query(
    f"""with {_KIND}, u as (select arm, coalesce(kind, 'pooled') kind, user_id, count(*) n, sum(ok::int) hits from kinds group by grouping sets ((arm, user_id), (arm, kind, user_id)))
    select arm, kind, cast(sum(n) as bigint) n, count(*) n_users, round(sum(hits) / sum(n), 9) micro, round(avg(hits / n), 9) macro from u group by 1, 2"""
)
def evaluation_report(spark, d):
    """Accuracy over all decisions, over new places and over places of the history."""
    kind = src.decisions(spark, d).filter("true_item is not null").select("decision_id", F.when(F.array_contains("history", F.col("true_item")), "revisit").otherwise("novel").alias("kind"))
    p = src.predictions(spark, d).join(kind, "decision_id").select("arm", "user_id", ranking.is_right().cast("int").alias("ok"), F.explode(F.array("kind", F.lit("pooled"))).alias("kind"))
    u = p.groupBy("arm", "kind", "user_id").agg(n_rows().alias("n"), F.sum("ok").alias("hits"))
    return u.groupBy("arm", "kind").agg(F.sum("n").alias("n"), n_rows().alias("n_users"), F.round(F.sum("hits") / F.sum("n"), 9).alias("micro"), F.round(F.avg(F.col("hits") / F.col("n")), 9).alias("macro"))


@query(
    f"""with {PREDICTIONS}, s as (select arm, decision_id % 3 seed, avg(coalesce(pick = answer_idx, false)::int) hit from pred group by 1, 2), a as (select arm, avg(hit) hit from s group by arm)
    select arm, round(hit, 9) hit_at_1, round(hit, 3) stored_value, abs(hit - round(hit, 3)) < 0.0005 + 1e-12 as agrees from a"""
)
def known_answers(spark, d):
    """Hit@1 of each arm, its mean over seeds, against the value that was written down, to within half a thousandth."""
    s = src.predictions(spark, d).groupBy("arm", (F.col("decision_id") % 3).alias("seed")).agg(F.avg(ranking.is_right().cast("double")).alias("hit"))
    a = s.groupBy("arm").agg(F.avg("hit").alias("hit"))
    return a.select("arm", F.round("hit", 9).alias("hit_at_1"), F.round("hit", 3).alias("stored_value"), checks.agrees(F.col("hit"), F.round("hit", 3), 0.0005).alias("agrees"))


_ARM_PAIRS = (("zero_shot", "fine_tuned"), ("zero_shot", "distance_cue"), ("distance_cue", "fine_tuned"))


@query(
    f"""with {PREDICTIONS}, u as (select arm, user_id, avg(coalesce(pick = answer_idx, false)::int) acc from pred group by 1, 2),
    pairs(a, b) as (values {", ".join(f"('{a}', '{b}')" for a, b in _ARM_PAIRS)}), x as (select p.a, p.b, v.acc - w.acc delta from pairs p join u w on w.arm = p.a join u v on v.arm = p.b and v.user_id = w.user_id)
    select a, b, count(*) n_users, round(avg(delta), 9) delta, round(avg(delta) - 1.959963985 * stddev_samp(delta) / sqrt(count(*)), 9) lo, round(avg(delta) + 1.959963985 * stddev_samp(delta) / sqrt(count(*)), 9) hi,
      case when avg(delta) - 1.959963985 * stddev_samp(delta) / sqrt(count(*)) > 0 then 'better' when avg(delta) + 1.959963985 * stddev_samp(delta) / sqrt(count(*)) < 0 then 'worse' when count(*) > 1 then 'no difference shown' end verdict from x group by 1, 2"""
)
def arm_contrasts(spark, d):
    """Differences of the users' accuracies between pairs of arms, with a 95 % interval and what it says."""
    u = stored(ranking.user_accuracy(src.predictions(spark, d), "arm").select("arm", "user_id", "acc"))
    out = None
    for a, b in _ARM_PAIRS:
        x = u.filter(F.col("arm") == a).select("user_id", F.col("acc").alias("x")).join(u.filter(F.col("arm") == b).select("user_id", F.col("acc").alias("y")), "user_id").withColumn("delta", F.col("y") - F.col("x"))
        half = F.lit(1.959963985) * F.stddev_samp("delta") / F.sqrt(n_rows())
        one = x.agg(n_rows().alias("n_users"), F.avg("delta").alias("delta"), (F.avg("delta") - half).alias("lo"), (F.avg("delta") + half).alias("hi")).filter("n_users > 0")
        one = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n_users", *(F.round(c, 9).alias(c) for c in ("delta", "lo", "hi")), serving.verdict(F.col("lo"), F.col("hi")).alias("verdict"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""with {_P}, w as (select arm, count(*) n, count(distinct user_id) n_people, count(*) filter (where pick = answer_idx) n_right, count(*) filter (where pick is null) n_unparsed, count(*) filter (where top <> answer_idx) n_missed, count(*) filter (where top <> answer_idx and c >= 0.6) n_sure_misses, count(*) filter (where top <> answer_idx and 1 + len(list_filter(logprobs, lambda x: x > logprobs[answer_idx + 1])) = 2) n_second from probs group by arm)
    select arm, n, n_people, n_right, n_unparsed, round(n_missed / n, 9) miss_share, round(n_sure_misses / nullif(n_missed, 0), 9) sure_share, round(n_second / nullif(n_missed, 0), 9) second_share from w"""
)
def headline_numbers(spark, d):
    """Numbers of people and decisions, and shares of the misses: those told as sure, and those with the truth second."""
    p = _preds(spark, d).withColumn("miss", F.col("top") != F.col("answer_idx")).withColumn("r", rank_of(F.col("logprobs"), F.col("answer_idx")))
    w = p.groupBy("arm").agg(n_rows().alias("n"), F.count_distinct("user_id").alias("n_people"), F.count_if(F.col("pick") == F.col("answer_idx")).alias("n_right"), F.count_if(F.col("pick").isNull()).alias("n_unparsed"), F.count_if("miss").alias("m"), F.count_if(F.col("miss") & (F.col("c") >= 0.6)).alias("s"), F.count_if(F.col("miss") & (F.col("r") == 2)).alias("t"))
    return w.select("arm", "n", "n_people", "n_right", "n_unparsed", F.round(F.col("m") / F.col("n"), 9).alias("miss_share"), F.round(F.try_divide("s", "m"), 9).alias("sure_share"), F.round(F.try_divide("t", "m"), 9).alias("second_share"))


@query(
    f"""with {_REC}, curves as ({_CURVES}), binned as (select *, (c >= 0)::int + (c >= 0.3)::int + (c >= 0.4)::int + (c >= 0.5)::int + (c >= 0.6)::int + (c >= 0.7)::int + (c >= 0.8)::int b from probs), bins as (select arm, count(*) n, round(avg(c), 7) mean_conf, round(avg((top = answer_idx)::int), 9) accuracy from binned group by arm, b),
    e as (select arm, round(sum(n * abs(mean_conf - accuracy)) / sum(n), 7) ece from bins group by arm), m as (select arm, cast(count(*) as bigint) n, round(avg(coalesce(pick = answer_idx, false)::int), 9) micro from pred group by arm),
    k as (select arm, max(accuracy) filter (rate = 0) never, max(accuracy) filter (rate = 0.5) half, max(accuracy) filter (rate = 1) always from curves where trigger = 'value' group by arm)
    select m.arm, n, micro, ece, never, half, always, ece <= 0.06 as calibrated, round(always - never, 9) gain_of_asking from m join e on m.arm = e.arm join k on k.arm = m.arm"""
)
def candidate_report(spark, d):
    """The arms side by side: accuracy, calibration, and accuracy when none, half or all of the decisions are asked."""
    p = src.predictions(spark, d)
    curve = ranking.ask_curve(scores._records(spark, d), rates=(0.0, 0.5, 1.0)).filter("trigger = 'value'")
    k = curve.groupBy("arm").agg(*(F.max(F.when(F.col("rate") == r, F.col("accuracy"))).alias(n) for r, n in ((0.0, "never"), (0.5, "half"), (1.0, "always"))))
    m = p.groupBy("arm").agg(n_rows().alias("n"), ranking.share(ranking.is_right()).alias("micro"))
    j = m.join(ranking.ece(ranking.reliability(p)), "arm").join(k, "arm")
    return j.withColumn("calibrated", F.col("ece") <= 0.06).withColumn("gain_of_asking", F.round(F.col("always") - F.col("never"), 9))


@query(
    f"""with {_REC}, curves as ({_CURVES}), taus as ({" union all ".join(f"select arm, {q}::double rate, round(quantile_cont(gain, {round(1 - q, 1)!r}), 7) tau from records group by arm" for q in (0.3, 0.5, 0.7))})
    select c.arm, case c.rate when 0 then 'never' when 0.3 then 'rarely' when 0.5 then 'unsure' when 0.7 then 'often' else 'always' end setting, c.rate, c.accuracy, t.tau, c.rate = 1 as ask_all
    from curves c left join taus t on t.arm = c.arm and t.rate = c.rate where c.trigger = 'value' and c.rate in (0, 0.3, 0.5, 0.7, 1)"""
)
def interface_settings(spark, d):
    """What the application's five settings are: how often they ask, from which gain on, and how often they are right."""
    names = {0.0: "never", 0.3: "rarely", 0.5: "unsure", 0.7: "often", 1.0: "always"}
    r = stored(scores._records(spark, d).select("arm", "prediction_id", "gain", "maxp", "top", "pick_ask", "answer_idx"))
    c = ranking.ask_curve(r, rates=tuple(names)).filter("trigger = 'value'").select("arm", "rate", "accuracy")
    taus = ranking.middle_values(r, "gain", "arm", {"t3": 0.7, "t5": 0.5, "t7": 0.3})
    j = c.join(F.broadcast(taus), "arm")  # one row an arm
    tau = F.when(F.col("rate") == 0.3, F.col("t3")).when(F.col("rate") == 0.5, F.col("t5")).when(F.col("rate") == 0.7, F.col("t7"))
    label = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))
    return j.select("arm", label[F.col("rate")].alias("setting"), "rate", "accuracy", F.round(tau, 7).alias("tau"), (F.col("rate") == 1).alias("ask_all"))


@query(
    f"""with {PREDICTIONS}, {DECISIONS}, r as (select count(*) n, round(avg((pick is null)::int), 9) unparsed, round(avg(coalesce(pick = answer_idx, false)::int), 9) hit_at_1, (select max(len(candidates)) from dec) options from pred)
    select 'unparsed' as "constraint", unparsed::double as value, 'at most 0.05' target, case when unparsed <= 0.05 then 'met' else 'not met' end state from r union all select 'hit_at_1', hit_at_1, 'at least 0.2', case when hit_at_1 >= 0.2 then 'met' else 'not met' end from r
    union all select 'options', options, 'at most 5', case when options <= 5 then 'met' else 'not met' end from r"""
)
def constraint_table(spark, d):
    """Measured values of the predictions against limits."""
    r = src.predictions(spark, d).agg(F.round(F.avg(F.col("pick").isNull().cast("int")), 9).alias("unparsed"), ranking.share(ranking.is_right()).alias("hit_at_1"))
    r = r.crossJoin(src.decisions(spark, d).agg(F.max(F.size("candidates")).alias("options")))  # one row each
    return serving.against_limits(r, {"unparsed": ("at most", 0.05), "hit_at_1": ("at least", 0.2), "options": ("at most", 5)})


@query(
    f"""with {_CATS}, {PREDICTIONS}, w as (select arm, count(*) n_wrong, count(*) filter (where p.pick <> p.answer_idx and c.decision_id is not null) n_classified from pred p left join cats c on p.decision_id = c.decision_id where p.pick <> p.answer_idx group by 1)
    select arm, n_wrong, n_classified, n_wrong - n_classified n_without_categories from w"""
)
def error_pattern_totals(spark, d):
    """The kinds of wrong picks must add up to the wrong picks of decisions whose options have categories."""
    wrong = src.predictions(spark, d).filter("pick <> answer_idx").groupBy("arm").agg(n_rows().alias("n_wrong"))
    kinds = scores.error_patterns(spark, d).groupBy("arm").agg(F.sum("n").alias("n_classified"))
    return wrong.join(kinds, "arm", "left").select("arm", "n_wrong", F.coalesce("n_classified", F.lit(0)).alias("n_classified")).withColumn("n_without_categories", F.col("n_wrong") - F.col("n_classified"))


# --- distances, donors, labels ---------------------------------------------------------------------------------------

@query(
    f"""with {rules._NEAREST}, {PREDICTIONS}, best as (select decision_id, arg_min(idx, (km, idx)) nearest from near where km is not null group by 1)
    select arm, count(*) n, count(nearest) n_located, round(avg(coalesce(pick = nearest, false)::int), 9) share_nearest, round(avg(coalesce(pick = 0, false)::int), 9) share_first from pred p left join best b on p.decision_id = b.decision_id group by arm"""
)
def nearest_pick_share(spark, d):
    """How often the pick is the option nearest to the history, and the first one."""
    best = rules.nearest_km(spark, d).filter("km is not null").groupBy("decision_id").agg(F.min_by("idx", F.struct("km", "idx")).alias("nearest"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 9)
    return src.predictions(spark, d).join(best, "decision_id", "left").groupBy("arm").agg(n_rows().alias("n"), F.count("nearest").alias("n_located"), share(F.col("pick") == F.col("nearest")).alias("share_nearest"), share(F.col("pick") == 0).alias("share_first"))


@query(
    f"""with {rules._NEAREST}, r as (select decision_id, count(km) n_km, count(*) n from near group by 1)
    select idx, count(*) n, round(avg((km is null)::int), 9) share_unknown, round(avg(km), 5) mean_km, (select count(*) from r where n_km = 0) n_rows_unknown, (select count(*) from r) n_rows from near group by idx"""
)
def distance_gaps(spark, d):
    """Distances by the option's place, how many are unknown, and the decisions of which all are."""
    near = stored(rules.nearest_km(spark, d))
    r = near.groupBy("decision_id").agg(F.count("km").alias("k")).agg(F.count_if(F.col("k") == 0).alias("n_rows_unknown"), n_rows().alias("n_rows"))
    return near.groupBy("idx").agg(n_rows().alias("n"), F.round(F.avg(F.col("km").isNull().cast("int")), 9).alias("share_unknown"), F.round(F.avg("km"), 5).alias("mean_km")).crossJoin(F.broadcast(r))  # one row


@query(
    f"""with {rules._NEAREST}, {PREDICTIONS}, pop as (select item, count(*) c from ev group by item),
    o as (select o.decision_id, o.idx, coalesce(p.c, 0) c from opt o left join pop p on o.item = p.item), best as (select decision_id, arg_max(idx, (c, -idx)) popular from o group by 1),
    close as (select decision_id, arg_min(idx, (km, idx)) nearest from near where km is not null group by 1)
    select p.arm, count(*) n_wrong, count(*) filter (where a.km is null) pick_unlocated, count(*) filter (where b.km is null) truth_unlocated, count(*) filter (where a.km < b.km) pick_nearer, count(*) filter (where p.pick = c.nearest) pick_nearest, count(*) filter (where p.pick = x.popular) pick_popular
    from pred p left join near a on a.decision_id = p.decision_id and a.idx = p.pick left join near b on b.decision_id = p.decision_id and b.idx = p.answer_idx left join close c on c.decision_id = p.decision_id left join best x on x.decision_id = p.decision_id where p.pick <> p.answer_idx group by 1"""
)
def case_facts(spark, d):
    """What wrong picks have in common: their distance and popularity beside the truth's."""
    near = stored(rules.nearest_km(spark, d).select("decision_id", "idx", "km"))
    nearest = near.filter("km is not null").groupBy("decision_id").agg(F.min_by("idx", F.struct("km", "idx")).alias("nearest"))
    popular = rules._popular(spark, d).groupBy("decision_id").agg(F.max_by("idx", F.struct("score", -F.col("idx"))).alias("popular"))
    w = src.predictions(spark, d).filter("pick <> answer_idx").select("arm", "decision_id", "pick", "answer_idx")
    w = w.join(near.select("decision_id", F.col("idx").alias("pick"), F.col("km").alias("a")), ["decision_id", "pick"], "left").join(near.select("decision_id", F.col("idx").alias("answer_idx"), F.col("km").alias("b")), ["decision_id", "answer_idx"], "left")
    w = w.join(nearest, "decision_id", "left").join(popular, "decision_id", "left")
    return w.groupBy("arm").agg(n_rows().alias("n_wrong"), F.count_if(F.col("a").isNull()).alias("pick_unlocated"), F.count_if(F.col("b").isNull()).alias("truth_unlocated"), F.count_if(F.col("a") < F.col("b")).alias("pick_nearer"), F.count_if(F.col("pick") == F.col("nearest")).alias("pick_nearest"), F.count_if(F.col("pick") == F.col("popular")).alias("pick_popular"))


@query(rules.SQL["matched_donor"].replace("select user_id, donor, band, round(cosine, 9) cosine, round(ratio, 9) ratio from best where k = 1", "select band, count(*) n, round(min(cosine), 9) least, round(median(cosine), 9) middle, round(avg(cosine), 9) mean, round(max(cosine), 9) most from best where k = 1 group by band"))
def donor_summary(spark, d):
    """Of the matched donors (as in matched_donor) how similar they are, by the band of lengths they were found in."""
    m = rules.matched_donor(spark, d)
    return m.groupBy("band").agg(n_rows().alias("n"), F.round(F.min("cosine"), 9).alias("least"), F.round(F.median("cosine"), 9).alias("middle"), F.round(F.avg("cosine"), 9).alias("mean"), F.round(F.max("cosine"), 9).alias("most"))


_LABELLED = f"""{_LABELS.replace("nullif(m.cat, '') cat, case", "nullif(m.cat, '') cat, nullif(m.name, '') as name, case")}, {DECISIONS},
hist as (select d.decision_id, d.i, d.item, l.label, l.name from (select decision_id, i, history[i] item from (select decision_id, history, unnest(generate_series(1, len(history))) i from dec where user_id is not null)) d left join labels l on d.item = l.item where d.item is not null),
slots as (select o.*, coalesce(l.label, 'Unknown') as label, l.name, coalesce(l.cat, '?') cat from opt o left join labels l on o.item = l.item),
truth as (select * from slots where is_true),
near_pairs as (select decision_id, bool_or(again) again from (select decision_id, item = lag(item) over (partition by decision_id order by i) again from hist) group by 1)"""


@query(
    f"""with {_LABELLED} select count(*) n, count(*) filter (where (select count(distinct label) from slots s where s.decision_id = t.decision_id) < (select count(*) from slots s where s.decision_id = t.decision_id)) same_labels, count(*) filter (where t.name is null) unnamed_truth,
    count(*) filter (where exists (select 1 from hist h where h.decision_id = t.decision_id and coalesce(h.label, 'Unknown') = t.label)) label_in_history, count(*) filter (where exists (select 1 from hist h where h.decision_id = t.decision_id and h.name = t.name)) name_in_history,
    round(avg(((select count(*) from slots s where s.decision_id = t.decision_id and s.cat = t.cat) = 1)::int), 9) unique_category_share, round(avg(coalesce((select again from near_pairs p where p.decision_id = t.decision_id), false)::int), 9) repeat_share from truth t"""
)
def label_counters(spark, d):
    """Of the decisions with a true option: labels that coincide, are unnamed or occur in the history, and shown repeats."""
    e = src.events(spark, d)
    known = stored(e.select("item").distinct().join(items.metadata(e), "item", "left").select("item", "cat", "name", items.label(F.col("cat"), F.col("name")).alias("label")))
    dec = src.decisions(spark, d).filter("user_id is not null")
    slots = src.options(dec).join(known, "item", "left").select("decision_id", "is_true", F.coalesce("label", F.lit("Unknown")).alias("label"), "name", F.coalesce("cat", F.lit("?")).alias("cat"))
    o = slots.groupBy("decision_id").agg(F.collect_list("label").alias("labels"), F.collect_list("cat").alias("cats"), F.max(F.when(F.col("is_true"), F.struct("label", "name", "cat"))).alias("t"), F.count_if("is_true").alias("_true")).filter("_true > 0")  # a decision's options
    h = dec.select("decision_id", F.posexplode("history").alias("i", "item")).filter("item is not null").join(known, "item", "left")
    h = h.groupBy("decision_id").agg(F.collect_set(F.coalesce("label", F.lit("Unknown"))).alias("old"), F.collect_set("name").alias("names"), F.transform(F.array_sort(F.collect_list(F.struct("i", "item"))), lambda x: x["item"]).alias("line"))
    x = o.join(h, "decision_id", "left")
    has = lambda a, v: F.coalesce(F.array_contains(a, F.col(v)), F.lit(False))
    again = F.coalesce(F.exists(F.zip_with(F.slice("line", 1, F.greatest(F.lit(0), F.size("line") - 1)), F.slice("line", 2, F.greatest(F.lit(0), F.size("line") - 1)), lambda a, b: a == b), lambda q: q), F.lit(False))
    one = F.size(F.filter("cats", lambda c: c == F.col("t.cat"))) == 1
    return x.agg(n_rows().alias("n"), F.count_if(F.size(F.array_distinct("labels")) < F.size("labels")).alias("same_labels"), F.count_if(F.col("t.name").isNull()).alias("unnamed_truth"), F.count_if(has("old", "t.label")).alias("label_in_history"), F.count_if(has("names", "t.name")).alias("name_in_history"), F.round(F.avg(one.cast("int")), 9).alias("unique_category_share"), F.round(F.avg(again.cast("int")), 9).alias("repeat_share"))


@query(f"with {_DOCS}, t as (select *, row_number() over (partition by decision_id order by n desc, p) r from (select decision_id, cat, count(*) n, min(pos) p from hist group by 1, 2)) select decision_id, string_agg(cat || ' (' || n || ')', ', ' order by r) top from t where r <= 3 group by 1")
def case_categories(spark, d):
    """The three most frequent categories of each history with their counts, for showing a case."""
    per = history_labels(spark, d).groupBy("decision_id", "cat").agg(n_rows().alias("n"), F.min("pos").alias("p"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p", "cat"))), 1, 3)  # a history has a dozen places
    return per.groupBy("decision_id").agg(F.array_join(F.transform(top, lambda x: F.concat(x["cat"], F.lit(" ("), (-x["m"]).cast("string"), F.lit(")"))), ", ").alias("top"))


# --- timelines -------------------------------------------------------------------------------------------------------

@query(f"with {LINES} select seq, user_id, is_novel, row_number() over (partition by user_id, is_novel order by rn) ordinal from held")
def held_out_ordinals(spark, d):
    """Held-out decisions, new places and revisits each numbered in a person's order."""
    held = timeline.held_out(timeline.split(timeline.ordered(src.events(spark, d)))).select("seq", "user_id", "t", "item", "is_novel", F.concat_ws("|", F.col("is_novel").cast("string"), "user_id").alias("line"))
    return timeline.ordered(held, key="line").select("seq", "user_id", "is_novel", F.col("rn").alias("ordinal"))


@query(
    f"""with {LINES}, {DECISIONS}, k as (select user_id, item, t, row_number() over (partition by user_id order by rn) k from held where is_novel), q as (select decision_id, user_id, true_item, row_number() over (partition by user_id order by t, true_item, decision_id) k from dec where user_id is not null and t is not null and true_item is not null)
    select q.decision_id, q.k, k.item event_item, k.item is not distinct from q.true_item as agrees from q left join k on k.user_id = q.user_id and k.k = q.k"""
)
def decision_alignment(spark, d):
    """The k-th decision of a person beside the k-th new place after the cut, and whether they name the same place."""
    novel = timeline.held_out(timeline.split(timeline.ordered(src.events(spark, d)))).filter("is_novel").select("seq", "user_id", "t", "item")
    k = timeline.ordered(novel).select("user_id", F.col("rn").alias("k"), F.col("item").alias("event_item"))
    dec = src.decisions(spark, d).dropna(subset=["user_id", "t", "true_item"]).select("decision_id", "user_id", "t", "true_item")
    q = timeline.ordered(dec, order=("t", "true_item", "decision_id")).select("decision_id", "user_id", "true_item", F.col("rn").alias("k"))
    return q.join(k, ["user_id", "k"], "left").select("decision_id", "k", "event_item", F.col("event_item").eqNullSafe(F.col("true_item")).alias("agrees"))


@query(
    f"""with {PREDICTIONS}, one as (select decision_id, user_id, arm, arg_min(answer_idx, prediction_id) answer_idx from pred group by 1, 2, 3), a as (select * from one where arm = 'zero_shot'), b as (select * from one where arm = 'fine_tuned')
    select coalesce(a.decision_id, b.decision_id) decision_id, a.answer_idx a_answer_idx, b.answer_idx b_answer_idx from a full join b on a.decision_id = b.decision_id where a.decision_id is null or b.decision_id is null or a.answer_idx <> b.answer_idx or a.user_id <> b.user_id order by 1 limit 20"""
)
def alignment_gate(spark, d):
    """The first twenty decisions at which two arms' predictions aren't of the same person and answer; none lets them pass."""
    p = src.predictions(spark, d).groupBy("decision_id", "user_id", "arm").agg(F.min_by("answer_idx", "prediction_id").alias("answer_idx"))
    side = lambda arm: p.filter(F.col("arm") == arm).select("decision_id", "user_id", "answer_idx")
    bad = checks.misaligned(side("zero_shot"), side("fine_tuned"), ["decision_id"], ["user_id", "answer_idx"])
    return bad.select("decision_id", "a_answer_idx", "b_answer_idx").orderBy("decision_id").limit(20)


@query(f"with {EVENTS} select case substr(user_id, 1, 2) when 'u0' then 'numbered' else 'named' end kind, count(*) n, count(distinct user_id) n_users from ev group by 1")
def users_by_prefix(spark, d):
    """Events by what the beginning of the account's id says."""
    kind = F.when(F.substring("user_id", 1, 2) == "u0", "numbered").otherwise("named")
    return src.events(spark, d).groupBy(kind.alias("kind")).agg(n_rows().alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(f"with {service._SCRAPES}, g as (select event_type, t, lead(t) over (partition by event_type order by t) - t silent_s from scrapes) select event_type, t, silent_s from g where silent_s > 3600")
def silent_scrapes(spark, d):
    """Hours after which a type of request was missing from the next scrape."""
    return serving.gaps_between(service.scrapes(spark, d, "event_type"), 3600, ["event_type"])


@query(f"with {EVENTS}, v as (select item, arg_min(lat, seq) lat, arg_min(lon, seq) lon, count(*) n from ev where lat is not null and lon is not null group by item), box as (select min(lat) s, max(lat) n, min(lon) w, max(lon) e from v) select item, v.n, 3 + 1.5 * (v.n - 1) radius, lat >= s + (n_ - s) / 4 and lat <= n_ - (n_ - s) / 4 and lon >= w + (e - w) / 4 and lon <= e - (e - w) / 4 as in_view from v cross join (select s, n n_, w, e from box)")
def visit_markers(spark, d):
    """The size of each place's marker by its visits, and whether it is in view when the middle of the map is shown."""
    v = stored(src.events(spark, d).filter("lat is not null and lon is not null").groupBy("item").agg(F.min_by("lat", "seq").alias("lat"), F.min_by("lon", "seq").alias("lon"), n_rows().alias("n")))
    box = v.agg(F.min("lat").alias("s"), F.max("lat").alias("t"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    inside = lambda x, a, b: (F.col(x) >= F.col(a) + (F.col(b) - F.col(a)) / 4) & (F.col(x) <= F.col(b) - (F.col(b) - F.col(a)) / 4)
    return v.crossJoin(F.broadcast(box)).select("item", "n", (3 + 1.5 * (F.col("n") - 1)).cast("double").alias("radius"), (inside("lat", "s", "t") & inside("lon", "w", "e")).alias("in_view"))  # one row


@query(
    f"""with {DECISIONS}, vecs as (select vec_id, embedding from embeddings), size as (select count(*) n from vecs), lastly as (select decision_id, history[-1] l from dec),
    keyed as (select o.decision_id, o.idx, {hash_sql("'item'", 'o.item')} % (select n from size) i, {hash_sql("'user'", 'o.user_id')} % (select n from size) u, {hash_sql("'last'", 'l.l')} % (select n from size) h from opt o join lastly l on l.decision_id = o.decision_id)
    select k.decision_id, k.idx, round(list_dot_product(a.embedding::double[], b.embedding::double[]) + coalesce(list_dot_product(c.embedding::double[], b.embedding::double[]), 0), 6) score from keyed k join vecs a on a.vec_id = k.u join vecs b on b.vec_id = k.i left join vecs c on c.vec_id = k.h"""
)
def next_item_scores(spark, d):
    """Scores of the options for a person after the history's last place: the sum of the person's and the last place's vector,
    times the option's. The vectors are looked up in a table, here by hash; `recommend.next_item_scores` takes fitted ones.
    """
    vecs = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = vecs.count()
    at = lambda name, c: F.pmod(hash32(name, c), F.lit(n))
    last = src.decisions(spark, d).select("decision_id", F.when(F.size("history") > 0, F.element_at("history", -1)).alias("l"))
    o = src.options(src.decisions(spark, d)).join(last, "decision_id").select("decision_id", "idx", at("user", "user_id").alias("user"), at("item", "item").alias("item"), F.when(F.col("l").isNotNull(), at("last", "l")).alias("last"))
    return recommend.next_item_scores(o, vecs.toDF("user", "v"), vecs.toDF("last", "v"), vecs.toDF("item", "v")).select("decision_id", "idx", F.round("score", 6).alias("score"))


@query()
def bootstrap_intervals(spark, d):
    """The difference of two arms with 4,000 draws: over people, over pooled decisions by person, and, wrongly, with the
    decisions as units; each interval by three conventions, with what it says.
    """
    pairs = stored(scores._paired(spark, d).select("decision_id", "user_id", (F.col("ok_b").cast("int") - F.col("ok_a").cast("int")).alias("v")))
    people = pairs.groupBy("user_id").agg(F.avg("v").alias("delta"), F.sum("v").alias("net"), n_rows().alias("n"))
    one = F.lit(1.0)
    forms = (("people", people, "user_id", F.col("delta"), one), ("pooled", people, "user_id", F.col("net"), F.col("n")), ("decisions", pairs, "decision_id", F.col("v"), one))
    out = None
    for name, rows, unit, top, below in forms:
        ci = ranking.intervals(ranking.bootstrap_sums(rows, unit, top, below))
        x = rows.agg(n_rows().alias("n_units"), F.try_divide(F.sum(top), F.sum(below)).alias("value")).crossJoin(ci)  # one row each
        numbers = [F.round(c, 9).alias(c) for c in ("value", "lo", "hi", "lo_at", "hi_at", "hi_before")]
        x = x.select(F.lit(name).alias("unit"), "n_units", *numbers, serving.verdict(F.col("lo"), F.col("hi")).alias("verdict"), serving.is_significant(F.col("lo_at"), F.col("hi_at"), F.col("n_units")).alias("significant"))
        out = x if out is None else out.unionByName(x)
    return out

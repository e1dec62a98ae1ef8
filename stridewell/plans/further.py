"""Samples, training rows, donors' prompts, maps, seeds and other single reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..common import stored
from ..functions import planar, text
from ..operators import checks, controls, items, privacy, ranking, recommend, sampling, timeline
from ..sources import events as src
from ..sources.tables import table
from . import rules
from .choices import _all
from .scores import _PAIR, _paired
from .sql import DECISIONS, EVENTS, LINES, PREDICTIONS, hash32
from .texts import _PROMPT, prompts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"""with {DECISIONS}, c as (select user_id, count(*) n from dec where user_id is not null group by 1 having count(*) >= 3), people as (select user_id from c order by md5('0|' || user_id), user_id limit 20),
    r as (select decision_id, user_id, row_number() over (partition by user_id order by {hash32("'0'", 'user_id', 'cast(decision_id as varchar)')}, decision_id) k from dec where user_id in (select user_id from people)) select user_id, decision_id, k from r where k <= 5"""
)
def people_sample(spark, d):
    """Twenty people with at least three decisions, five decisions of each at most."""
    dec = src.decisions(spark, d).filter("user_id is not null").select("user_id", "decision_id")
    many = dec.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    mine = dec.join(sampling.sample_keys(many, "user_id", 20, 0), "user_id", "left_semi").withColumn("h", sampling.hash32(0, "user_id", "decision_id"))
    return sampling.take_per_group(mine, ["user_id"], 5, [F.col("h"), F.col("decision_id")], rank="k").select("user_id", "decision_id", "k")


@query(f"with {EVENTS}, r as (select cat, seq, {hash32(chr(39) + '0' + chr(39), 'cast(seq as varchar)')} h from ev where cat is not null), b as (select cat, arg_min(seq, (h, seq)) seq from r group by 1) select cat, seq from b order by md5('0|' || cat), cat limit 5")
def one_per_group(spark, d):
    """One random event of each of five random categories."""
    e = src.events(spark, d).filter("cat is not null").groupBy("cat").agg(F.min_by("seq", F.struct(sampling.hash32(0, "seq"), "seq")).alias("seq"))
    return e.orderBy(F.md5(F.concat(F.lit("0|"), "cat")), "cat").limit(5)


@query(
    f"""with {EVENTS}, {PREDICTIONS}, keep as (select distinct user_id from pred where arm = 'fine_tuned'), u as (select distinct user_id from ev),
    m as (select u.user_id, k.user_id is not null kept from u left join keep k on u.user_id = k.user_id) select user_id, kept from m order by not kept, {hash32("'0'", 'user_id')}, user_id limit 400"""
)
def training_pool(spark, d):
    """All users of an evaluation set, and others in random order up to a budget."""
    keep = src.predictions(spark, d).filter("arm = 'fine_tuned'")
    return recommend.training_pool(src.events(spark, d), keep, 400)


@query(
    f"""with {LINES}, u as (select user_id, list(item order by rn) items from parts where not held group by 1), f as (select user_id, items[greatest(1, len(items) - 9):] tail from u)
    select user_id, cast(10 - len(tail) as int) n_pad, array_to_string(tail, ',') tail from f"""
)
def padded_sequences(spark, d):
    """The last ten items before the cut of each user, as a left-padded window for a sequence model."""
    p = timeline.split(timeline.ordered(src.events(spark, d))).filter("not held and rn > cut - 10")
    # the window is cut off before it is gathered: at most ten rows a user
    w = p.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "item"))).alias("w")).select("user_id", F.col("w.item").alias("tail"))
    ids = recommend.left_truncated(F.sequence(F.lit(1).cast("bigint"), F.size("tail").cast("bigint")), 10)
    return w.select("user_id", F.size(F.filter(ids, lambda x: x == 0)).alias("n_pad"), F.array_join("tail", ",").alias("tail"))


@query(f"with {_PROMPT} select p.decision_id, prompt, ' ' || chr(65 + d.answer_idx) completion from prompts p join dec d on p.decision_id = d.decision_id where d.answer_idx between 0 and 4 and d.k = 5 and p.n = 5 and len(d.candidates) = 5")
def sft_examples(spark, d):
    """Prompt and completion of each well-formed decision."""
    dec = src.decisions(spark, d).filter("answer_idx between 0 and 4 and k = 5 and size(candidates) = 5").select("decision_id", "answer_idx")
    p = prompts(spark, d).filter("n_options = 5").join(dec, "decision_id")
    return p.select("decision_id", "prompt", F.concat(F.lit(" "), F.substring(F.lit(text.LETTERS), F.col("answer_idx") + 1, F.lit(1))).alias("completion"))


_SEGMENT = (text.HISTORY_HEAD + "\n", "\n" + text.TOP_HEAD)


@query(
    f"""with {_PROMPT}, owner as (select decision_id, user_id from dec where user_id is not null), users as (select user_id donor, row_number() over (order by user_id) - 1 rank, count(*) over () n from (select distinct user_id from owner)),
    j as (select o.decision_id, u.rank, {hash32("'0'", 'cast(o.decision_id as varchar)')} % (u.n - 1) j from owner o join users u on o.user_id = u.donor where u.n > 1),
    donors as (select j.decision_id, u.donor from j join users u on u.rank = j.j + (j.j >= j.rank)::int), firsts as (select o.user_id, arg_min(p.prompt, p.decision_id) prompt from prompts p join owner o on p.decision_id = o.decision_id group by 1)
    select p.decision_id, substr(p.prompt, 1, {len(_SEGMENT[0])}) || substr(f.prompt, {len(_SEGMENT[0]) + 1}, strpos(f.prompt, chr(10) || '{text.TOP_HEAD}') - {len(_SEGMENT[0]) + 1}) || substr(p.prompt, strpos(p.prompt, chr(10) || '{text.TOP_HEAD}')) prompt
    from prompts p join donors x on p.decision_id = x.decision_id join firsts f on f.user_id = x.donor"""
)
def stranger_prompts(spark, d):
    """Each prompt with some other user's places in place of the own ones."""
    dec = src.decisions(spark, d).filter("user_id is not null").select("decision_id", "user_id")
    p = prompts(spark, d).select("decision_id", "prompt").join(dec, "decision_id")
    first = p.groupBy("user_id").agg(F.min_by("prompt", "decision_id").alias("donor_prompt")).withColumnRenamed("user_id", "donor")
    x = controls.random_donors(dec, dec, "decision_id").drop("user_id").join(p, "decision_id").join(first, "donor")
    return x.select("decision_id", text.spliced(F.col("prompt"), F.col("donor_prompt"), *_SEGMENT).alias("prompt")).filter("prompt is not null")


@query(
    f"""with {PREDICTIONS}, u as (select arm, user_id, avg(coalesce(pick = answer_idx, false)::int) acc from pred group by 1, 2) select arm, least(10, cast(floor(acc * 10) as int) + 1) bin, count(*) n from u group by 1, 2"""
)
def accuracy_histogram(spark, d):
    """Users by accuracy, in ten bins of which the last is closed."""
    u = ranking.user_accuracy(src.predictions(spark, d), "arm")
    return u.groupBy("arm", F.least(F.lit(10), F.floor(F.col("acc") * 10).cast("int") + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {PREDICTIONS}, s as (select arm, decision_id % 3 as seed, avg(coalesce(pick = answer_idx, false)::int) acc from pred group by 1, 2) select arm, count(*) n_seeds, round(avg(acc), 9) mean, round(stddev_samp(acc), 9) sd from s group by 1"""
)
def mean_over_seeds(spark, d):
    """Two-level mean: over decisions within a seed, then over seeds, with the seeds' deviation."""
    s = src.predictions(spark, d).groupBy("arm", (F.col("decision_id") % 3).alias("seed")).agg(F.avg(ranking.is_right().cast("double")).alias("acc"))
    return s.groupBy("arm").agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("acc"), 9).alias("mean"), F.round(F.stddev_samp("acc"), 9).alias("sd"))


@query(
    f"""with {_PAIR}, c as (select 'users' unit, user_id k, avg(ok_b::int - ok_a::int) v from pair group by user_id union all select 'decisions', cast(decision_id as varchar), ok_b::int - ok_a::int from pair)
    select unit, count(*) n, round(avg(v), 9) mean, round(stddev_samp(v) / sqrt(count(*)), 9) standard_error from c group by unit"""
)
def unit_of_resampling(spark, d):
    """The same difference with users and, wrongly, decisions as independent units."""
    p = _paired(spark, d).withColumn("v", F.col("ok_b").cast("int") - F.col("ok_a").cast("int"))
    both = p.groupBy("user_id").agg(F.avg("v").alias("v")).select(F.lit("users").alias("unit"), "v").unionByName(p.select(F.lit("decisions").alias("unit"), F.col("v").cast("double").alias("v")))
    n = F.count(F.lit(1))
    return both.groupBy("unit").agg(n.alias("n"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_samp("v") / F.sqrt(n), 9).alias("standard_error"))


_SPOTS = "spots as (select item, arg_min(lat, seq) lat, arg_min(lon, seq) lon, arg_min(coalesce(cat, ''), seq) cat from ev where lat is not null and lon is not null group by item)"


@query(f"with {EVENTS}, {_SPOTS} select round(round(lat / 0.0045) * 0.0045, 6) + 0.0 lat, round(round(lon / 0.006) * 0.006, 6) + 0.0 lon, item, (row_number() over (partition by round(lat / 0.0045), round(lon / 0.006) order by item) - 1 - (count(*) over (partition by round(lat / 0.0045), round(lon / 0.006)) - 1) / 2) * 20 as shift from spots")
def marker_offsets(spark, d):
    """Markers that fall on one map cell, fanned out side by side."""
    s = items.coordinates(src.events(spark, d)).withColumn("y", F.round(F.col("lat") / 0.0045)).withColumn("x", F.round(F.col("lon") / 0.006))
    n = s.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("y", "x").orderBy("item")
    return s.withColumn("i", F.row_number().over(w) - 1).join(n, ["y", "x"]).select((F.round(F.col("y") * 0.0045, 6) + 0.0).alias("lat"), (F.round(F.col("x") * 0.006, 6) + 0.0).alias("lon"), "item", ((F.col("i") - (F.col("n") - 1) / 2) * 20).alias("shift"))


@query(
    f"""with {EVENTS}, b as (select user_id, min(lat) s, max(lat) n, min(lon) w, max(lon) e from ev where lat is not null and lon is not null group by 1)
    select user_id, round((s + n) / 2 - greatest((n - s) / 2 * 1.5, 0.0135), 9) south, round((s + n) / 2 + greatest((n - s) / 2 * 1.5, 0.0135), 9) north, round((w + e) / 2 - greatest((e - w) / 2 * 1.5, 0.018), 9) west, round((w + e) / 2 + greatest((e - w) / 2 * 1.5, 0.018), 9) east,
      round(sqrt(pow((n - s) * 111.32, 2) + pow((e - w) * 111.32 * cos(radians(40.7)), 2)), 5) span_km from b"""
)
def fit_boxes(spark, d):
    """The map section that shows all of a user's places, with room around and a least size."""
    e = src.events(spark, d).filter("lat is not null and lon is not null")
    b = e.groupBy("user_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    y, x = planar.padded(F.col("s"), F.col("n"), 0.027), planar.padded(F.col("w"), F.col("e"), 0.036)
    r = lambda c: F.round(c, 9)
    return b.select("user_id", r(y["low"]).alias("south"), r(y["high"]).alias("north"), r(x["low"]).alias("west"), r(x["high"]).alias("east"), F.round(planar.planar_km(F.col("s"), F.col("w"), F.col("n"), F.col("e")), 5).alias("span_km"))


@query(f"with {EVENTS} select round(lat, 3) + 0.0 lat, round(lon, 3) + 0.0 lon, count(*) n, string_agg(distinct cat, '|' order by cat) kinds from ev where lat is not null and lon is not null and cat is not null group by 1, 2")
def visits_by_point(spark, d):
    """Visits of each point with the set of kinds of place."""
    e = src.events(spark, d).filter("lat is not null and lon is not null and cat is not null")
    return e.groupBy(F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("cat")), "|").alias("kinds"))


def _composite_sql() -> str:
    return f"""with {EVENTS}, own as (select distinct user_id, item, cat from ev where cat is not null), chosen as (select user_id from (select distinct user_id from own) order by md5('0|' || user_id), user_id limit 50),
    mixed as (select *, row_number() over (partition by user_id order by {hash32("'0'", 'user_id', 'item', 'cat')}, item, cat) k from own where user_id in (select user_id from chosen)),
    pick as (select a.user_id, a.item, b.cat from mixed a join mixed b on a.user_id = b.user_id and a.k = 1 and b.k = 2)
    select p.user_id, p.item, p.cat, (select count(*) from (select user_id from own where item = p.item intersect select user_id from own where cat = p.cat)) n_users from pick p"""


@query(_composite_sql())
def composite_support(spark, d):
    """Users that share both a random item and the category of another random visit of each of 50 users."""
    own = src.events(spark, d).filter("cat is not null").select("user_id", "item", "cat").distinct()
    mine = own.join(sampling.sample_keys(own, "user_id", 50, 0), "user_id", "left_semi").withColumn("h", sampling.hash32(0, "user_id", "item", "cat"))
    two = sampling.take_per_group(mine, ["user_id"], 2, [F.col("h"), F.col("item"), F.col("cat")], rank="k")
    pick = two.filter("k = 1").select("user_id", "item").join(two.filter("k = 2").select("user_id", "cat"), "user_id")
    holders = pick.join(own.select("item", F.col("user_id").alias("u")).distinct(), "item").join(own.select("cat", F.col("user_id").alias("u")).distinct(), ["cat", "u"], "left_semi")
    n = holders.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_users"))
    return pick.join(n, "user_id", "left").select("user_id", "item", "cat", F.coalesce("n_users", F.lit(0)).alias("n_users"))


@query(
    f"""with {EVENTS}, own as (select distinct user_id, item, cat from ev where cat is not null),
    mixed as (select *, row_number() over (partition by user_id, draw order by {hash32("'0'", 'cast(draw as varchar)', 'user_id', 'item', 'cat')}, item, cat) k from own cross join (select unnest(generate_series(0, 19)) draw)),
    pick as (select a.user_id, a.draw, a.item, b.cat from mixed a join mixed b on a.user_id = b.user_id and a.draw = b.draw and a.k = 1 and b.k = 2),
    counts as (select p.item, p.cat, count(distinct a.user_id) n_users from (select distinct item, cat from pick) p join own a on a.item = p.item join own b on b.cat = p.cat and b.user_id = a.user_id group by 1, 2)
    select p.user_id, p.draw, p.item, p.cat, coalesce(n_users, 0) n_users from pick p left join counts c on c.item = p.item and c.cat = p.cat"""
)
def all_composite_support(spark, d):
    """The same for every user with two visits to draw from, twenty draws each."""
    own = stored(src.events(spark, d).filter("cat is not null").select("user_id", "item", "cat").distinct())
    x = own.withColumn("draw", F.explode(F.expr("sequence(0, 19)"))).withColumn("h", sampling.hash32(0, "draw", "user_id", "item", "cat"))
    two = stored(sampling.take_per_group(x, ["user_id", "draw"], 2, [F.col("h"), F.col("item"), F.col("cat")], rank="k"))
    pick = stored(two.filter("k = 1").select("user_id", "draw", "item").join(two.filter("k = 2").select("user_id", "draw", "cat"), ["user_id", "draw"]))
    # each different pair is counted once
    holders = pick.select("item", "cat").distinct().join(own.select("item", F.col("user_id").alias("u")).distinct(), "item").join(own.select("cat", F.col("user_id").alias("u")).distinct(), ["cat", "u"], "left_semi")
    n = holders.groupBy("item", "cat").agg(F.count(F.lit(1)).alias("n_users"))
    return pick.join(n, ["item", "cat"], "left").select("user_id", "draw", "item", "cat", F.coalesce("n_users", F.lit(0)).alias("n_users"))


@query()
def period_widths(spark, d):
    """By width of the band window, how many of all held-out decisions found decoys of the same period profile there."""
    w = _all(spark, d, "popmatched_period").period[0].filter("p_width is not null")
    return w.groupBy(F.col("p_width").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.min("n_labels").alias("least_labels"))


#: The question set that stays untouched until the end: no distance phrases may be added to it.
TEST_SEED = 20260920
_OPTS = "opts as (select o.decision_id, o.idx, coalesce(l.label, 'Unknown') as label from opt o left join labels l on o.item = l.item)"
_NEAR = rules._NEAREST.replace(f"{EVENTS}, {DECISIONS}, ", "")
_CUED = _PROMPT.replace(
    _OPTS,
    f"""{_NEAR}, cues as (select decision_id, idx, case when km is null then ' [distance unknown]' else ' [' || format('{{:.1f}}', round_even(km, 1)) || ' km from the nearest place in their history]' end cue from near),
    opts as (select o.decision_id, o.idx, coalesce(l.label, 'Unknown') || c.cue as label from opt o join cues c on c.decision_id = o.decision_id and c.idx = o.idx left join labels l on o.item = l.item)""",
)


def with_distances(spark, d, seed: int = 0):
    """decision_id, prompt with the options' distances; refuses the seed of the final test."""
    if seed == TEST_SEED:
        raise ValueError("distance phrases are not added to the test questions")
    p = prompts(spark, d)
    km = rules.nearest_km(spark, d).groupBy("decision_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "km"))), lambda x: x["km"]).alias("kms"))  # a decision's options
    x = p.join(km, "decision_id").withColumn("cued", text.add_cues(F.col("cands"), F.col("kms")))
    plain, cued = (F.array_join(text.option_lines(F.col(c)), "\n") for c in ("cands", "cued"))
    at = F.instr("prompt", text.QUESTION) + len(text.QUESTION) + 1  # where the options begin
    rest = F.substring("prompt", at + F.length(plain), F.length("prompt"))
    return x.select("decision_id", F.concat(F.substring("prompt", F.lit(1), at - 1), cued, rest).alias("prompt"))


@query(f"with {_CUED} select decision_id, prompt from prompts")
def cue_prompts(spark, d):
    """The prompts with each option's distance from the history."""
    return with_distances(spark, d)


_DONORS = rules.SQL["matched_donor"].replace(f"with {EVENTS}, ", "", 1).rsplit("select user_id, donor, band", 1)[0]
_STRANGER = f"""with {_PROMPT}, {_DONORS}, owner as (select decision_id, user_id from dec where user_id is not null), firsts as (select o.user_id, arg_min(p.prompt, p.decision_id) prompt from prompts p join owner o on p.decision_id = o.decision_id group by 1)
    select p.decision_id, b.donor, b.band, round(b.cosine, 9) cosine, substr(p.prompt, 1, {len(_SEGMENT[0])}) || substr(f.prompt, {len(_SEGMENT[0]) + 1}, strpos(f.prompt, chr(10) || '{text.TOP_HEAD}') - {len(_SEGMENT[0]) + 1}) || substr(p.prompt, strpos(p.prompt, chr(10) || '{text.TOP_HEAD}')) prompt
    from prompts p join owner o on o.decision_id = p.decision_id join best b on b.k = 1 and b.user_id = o.user_id join firsts f on f.user_id = b.donor"""


def _matched_strangers(spark, d, donors):
    dec = src.decisions(spark, d).filter("user_id is not null").select("decision_id", "user_id")
    p = stored(prompts(spark, d).select("decision_id", "prompt").join(dec, "decision_id"))
    first = p.groupBy("user_id").agg(F.min_by("prompt", "decision_id").alias("donor_prompt")).withColumnRenamed("user_id", "donor")
    x = p.join(donors.select("user_id", "donor", "band", "cosine"), "user_id").join(first, "donor")
    own, other = (text.split_marker(F.col(c), *_SEGMENT) for c in ("prompt", "donor_prompt"))
    x = x.select("decision_id", "donor", "band", "cosine", text.spliced(F.col("prompt"), F.col("donor_prompt"), *_SEGMENT).alias("prompt"), own["inner"].eqNullSafe(other["inner"]).alias("same"))
    return x.filter("prompt is not null")


@query(_STRANGER)
def matched_stranger_prompts(spark, d):
    """Prompts of the people in `matched_donor` with their donor's places in place of their own, and who the donor is."""
    return _matched_strangers(spark, d, rules.matched_donor(spark, d)).drop("same")


@query()
def all_matched_stranger_prompts(spark, d):
    """The same for everybody; `changed` is false where the donor's prompt happens to show the same places."""
    x = _matched_strangers(spark, d, rules.all_matched_donor(spark, d))
    return x.withColumn("changed", ~F.col("same")).drop("same")


def _gate(name: str, control: str) -> str:
    head, top = len(_SEGMENT[0]), f"chr(10) || '{text.TOP_HEAD}'"
    return f"""select '{name}' control, count(*) n_rows, count(*) filter (where own is null or substr(x.prompt, 1, {head}) <> substr(own, 1, {head}) or substr(x.prompt, strpos(x.prompt, {top})) <> substr(own, strpos(own, {top}))) n_failed
    from ({control}) x left join (with {_PROMPT} select decision_id as own_id, prompt own from prompts) y on y.own_id = x.decision_id"""


@query(f"{_gate('random donor', SQL['stranger_prompts'])} union all {_gate('matched donor', SQL['matched_stranger_prompts'])}")
def identity_gate(spark, d):
    """By control, how many of its prompts fail the gate: they must belong to a decision and differ from it in the shown
    places only.
    """
    own = stored(prompts(spark, d).select("decision_id", F.col("prompt").alias("own")))
    out = None
    for name, control in (("random donor", stranger_prompts(spark, d)), ("matched donor", _matched_strangers(spark, d, rules.matched_donor(spark, d)))):
        x = control.select("decision_id", "prompt").join(own, "decision_id", "left")
        a, b = (text.split_marker(F.col(c), *_SEGMENT) for c in ("prompt", "own"))
        bad = F.col("own").isNull() | ~(a["before"].eqNullSafe(b["before"]) & a["after"].eqNullSafe(b["after"]))
        one = x.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_failed")).select(F.lit(name).alias("control"), "n_rows", "n_failed")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""with {EVENTS}, held as (select distinct user_id, item, cat from ev where cat is not null), often as (select item from (select distinct user_id, item from held) group by 1 having count(*) >= 3),
    slots as (select cat, cast(row_number() over (order by n desc, cat) - 1 as int) slot from (select cat, count(*) n from ev where cat is not null group by 1) order by n desc, cat limit 4),
    pool as (select *, row_number() over (partition by cat order by user_id, item) - 1 r, count(*) over (partition by cat) c from held where cat in (select cat from slots) and item in (select item from often)),
    drawn as (select a attempt, s.slot, s.cat, p.user_id, p.item from (select unnest(generate_series(0, 199)) a) cross join slots s join pool p on p.cat = s.cat and p.r = {hash32("'0'", 'cast(a as varchar)', 'cast(s.slot as varchar)')} % p.c),
    whole as (select attempt from drawn group by 1 having count(distinct user_id) = 4 and count(distinct item) = 4), someone as (select d.attempt from drawn d join (select distinct user_id u, item from held) h on h.item = d.item group by d.attempt, u having count(*) = 4)
    select * from drawn where attempt = (select min(attempt) from whole where attempt not in (select attempt from someone))"""
)
def composite_example(spark, d):
    """An example person from four users' visits to the four most frequent kinds of place, whom nobody is."""
    e = src.events(spark, d).filter("cat is not null")
    slots = [r.cat for r in e.groupBy("cat").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cat").limit(4).collect()]
    return privacy.composite(e, slots)


@query(f"""with {_PROMPT}, w as (select decision_id, len(regexp_extract_all(prompt, '[A-Za-z]+')) n from prompts) select decision_id, cast(least(n, 59) + 1 as int) n_ids, cast(least(n, 59) as int) n_ignored, n > 59 as is_cut from w""")
def truncated_instances(spark, d):
    """Training rows of at most sixty ids, words standing in for tokens: the prompt's beginning is cut, its labels ignored."""
    ids = F.transform(F.regexp_extract_all("prompt", F.lit("[A-Za-z]+"), 0), lambda w: F.xxhash64(w))
    x = prompts(spark, d).select("decision_id", F.size(ids).alias("n"), recommend.instance_ids(ids, F.array(F.lit(1).cast("bigint")), 60).alias("r"))
    return x.select("decision_id", F.size("r.ids").alias("n_ids"), F.size(F.filter("r.labels", lambda y: y == -100)).alias("n_ignored"), (F.col("n") > 59).alias("is_cut"))


@query("with j as (select doc_id, text from documents where kind = 'row' and text is not null and json_valid(text)), t as (select regexp_replace(fullkey, '^\\$\\.?', '') path, type from j, json_tree(j.text) where type not in ('OBJECT', 'ARRAY')) select regexp_replace(path, '\"', '', 'g') path, count(*) n from t group by 1")
def json_leaves(spark, d):
    """The paths of the values in the question rows among the documents."""
    rows = table(spark, d, "documents").filter("kind = 'row' and text is not null").select("doc_id", "text")
    return checks.json_paths(rows, "doc_id", "text").groupBy("path").agg(F.count(F.lit(1)).alias("n"))

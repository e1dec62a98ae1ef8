"""Question sets from events: every step from the timelines to the shuffled options, under any decoy condition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import stored
from . import items, questions, sampling, timeline

CONDITIONS = ("popmatched", "textmatched", "popmatched_period", "popular", "random")


@dataclass
class Builder:
    """Questions about the held-out events of people with at least `min_events` events (seq, user_id, t, item, and cat and
    name for the labels).

    condition: how decoys are drawn. n_users: ask that many people, drawn after the exclusion of `exclude` (user_id); all
    by default. kind: 'novel' asks about new places only, 'revisit' about the others, 'pooled' about both. scores: item and
    score of every item, for 'textmatched'. What several steps need is computed once, and only if a step needs it.
    """

    events: DataFrame
    condition: str = "popmatched"
    k: int = 5
    seed: int = 0
    min_events: int = 20
    test_frac: float = 0.2
    n_users: int | None = None
    kind: str = "pooled"
    exclude: DataFrame | None = None
    scores: DataFrame | None = None
    n_bands: int = 20
    n_popular: int = 2000

    def __post_init__(self):
        if self.condition not in CONDITIONS:
            raise ValueError(f"unknown condition {self.condition!r}; there are {', '.join(CONDITIONS)}")
        if self.kind not in ("pooled", "novel", "revisit"):
            raise ValueError("kind must be pooled, novel or revisit")
        if self.k < 2:
            raise ValueError("k must be at least 2")
        if self.condition == "textmatched" and self.scores is None:
            raise ValueError("textmatched needs the items' scores")

    @cached_property
    def parts(self) -> DataFrame:
        line = timeline.ordered(self.events.select("seq", "user_id", "t", "item"))
        return stored(timeline.split(line, self.min_events, self.test_frac).select("user_id", "rn", "t", "item", "held"))

    @cached_property
    def decisions(self) -> DataFrame:
        held = timeline.held_out(self.parts)
        if self.kind != "pooled":
            held = held.filter("is_novel" if self.kind == "novel" else "not is_novel")
        held = held.select("user_id", "rn", "t", "item")
        if self.n_users is not None:
            held = questions.cohort(held, self.n_users, self.seed, self.exclude)
        elif self.exclude is not None:
            held = held.join(self.exclude.select("user_id").distinct(), "user_id", "left_anti")
        return stored(held)

    @cached_property
    def past(self) -> DataFrame:
        past = timeline.seen_before(self.parts)
        if self.n_users is not None or self.exclude is not None:
            past = past.join(self.decisions.select("user_id").distinct(), "user_id", "left_semi")
        return stored(past)

    @cached_property
    def bands(self) -> DataFrame:
        return stored(items.bands(timeline.popularity(self.parts), self.events, self.n_bands))

    @cached_property
    def wide(self) -> DataFrame:
        return questions.decoy_width(self.decisions, self.past, self.bands, self.k, self.n_bands)

    @cached_property
    def generic(self) -> tuple[DataFrame, DataFrame]:
        """(decisions with spans, weight line) for 'textmatched'; every item must have a score."""
        scored = stored(self.scores.select("item", "score").filter("score is not null"))
        uncovered = self.events.select("item").distinct().join(scored, "item", "left_anti")
        few = uncovered.limit(4).collect()
        if few:
            raise ValueError(f"{uncovered.count()} items have no score, such as {', '.join(r.item for r in few[:3])}")
        bins = scored.select("item", items.bin_of(F.col("score"), items.bin_edges(scored)).alias("g"))
        line = questions.weight_line(self.bands.select("item", "pop", "band").join(bins, "item"), ["g", "band"])
        return questions.generic_spans(self.wide.filter("width is not null"), self.past, line, self.k - 1, self.n_bands), line

    @cached_property
    def period(self) -> tuple[DataFrame, DataFrame]:
        """(decisions with spans, weight line) for 'popmatched_period'."""
        named = self.events.select("item").distinct().join(items.metadata(self.events), "item", "left")
        labels = stored(named.select("item", items.label(F.col("cat"), F.col("name")).alias("label")))
        profile = stored(items.period_profile(self.events, self.parts))
        line = questions.period_line(self.bands, profile, labels)
        asked = self.decisions.withColumn("per", items.period(F.col("t")))
        return questions.period_spans(asked, self.past, self.bands, profile, labels, line, self.k, self.n_bands), line

    def _even(self, ranked: DataFrame) -> DataFrame:
        line = ranked.select("item", F.col("rank").alias("w_from"), F.lit(1).cast("bigint").alias("w"))
        ready = self.decisions.withColumn("lo", F.lit(0).cast("bigint")).withColumn("hi", F.lit(line.count()).cast("bigint"))
        return questions.draw_decoys(ready, line, None, self.k - 1, self.seed)

    @cached_property
    def decoys(self) -> DataFrame:
        draw: dict[str, Callable[[], DataFrame]] = {
            "popmatched": lambda: questions.draw_decoys(questions.stretch_of_bands(self.wide.filter("width is not null"), self.bands, self.n_bands), self.bands.select("item", "w_from", (F.col("pop") + 1).alias("w")), self.past, self.k - 1, self.seed),
            "textmatched": lambda: questions.draw_decoys(self.generic[0], self.generic[1].select("item", "w_from", "w"), self.past, self.k - 1, self.seed),
            "popmatched_period": lambda: questions.draw_decoys(self.period[0], self.period[1].select("item", "w_from", "w", "label"), self.past, self.k - 1, self.seed),
            "popular": lambda: self._even(items.most_frequent(self.events, self.n_popular)),
            "random": lambda: self._even(items.global_rank(self.events.select("item").distinct(), ["item"])),
        }
        return draw[self.condition]()

    @cached_property
    def options(self) -> DataFrame:
        """user_id, rn, idx, item, is_true of the decisions for which there are k - 1 decoys."""
        return questions.shuffled(self.decisions, self.decoys, self.k - 1, self.seed)

    def stats(self) -> DataFrame:
        """condition, n_rows, n_fallback (decisions whose pool had to be widened), n_dropped (for want of decoys)."""
        total = self.decisions.agg(F.count(F.lit(1)).alias("n_rows"))
        none = F.lit(0).cast("bigint")
        pop = lambda: self.wide.agg(F.count_if(F.col("width") > 0).alias("n_fallback"), F.count_if(F.col("width").isNull()).alias("n_dropped"))
        if self.condition == "popmatched":
            one = pop()
        elif self.condition == "textmatched":
            one = self.generic[0].agg(F.count_if(F.col("g_width") > 0).alias("n_fallback")).crossJoin(pop().select("n_dropped"))
        elif self.condition == "popmatched_period":
            p = self.period[0].agg(F.count_if(F.col("p_width") > 0).alias("n_fallback"), F.count("p_width").alias("_n"))
            one = total.crossJoin(p).select("n_fallback", (F.col("n_rows") - F.col("_n")).alias("n_dropped"))
        else:
            one = total.select(none.alias("n_fallback"), none.alias("n_dropped"))
        return total.crossJoin(one).select(F.lit(self.condition).alias("condition"), "n_rows", "n_fallback", "n_dropped")  # one row each


def training_instances(events: DataFrame, cap: int = 20, k: int = 5, seed: int = 0, exclude: DataFrame | None = None, **how) -> tuple[Builder, DataFrame]:
    """Questions for training from the events before the cut: a builder whose decisions are at most `cap` random first
    visits of each person, other than the very first event, and its options.

    No decoy is a place that the person visits before the cut, so none is the answer of another instance of theirs. The
    draws depend on each row's own key only: people left out by `exclude` change nothing in the others' instances.
    """
    b = Builder(events, "popmatched", k, seed, **how)
    first = b.parts.filter("not held").groupBy("user_id", "item").agg(F.min("rn").alias("rn"), F.min_by("t", "rn").alias("t")).filter("rn > 1")
    if exclude is not None:
        first = first.join(exclude.select("user_id").distinct(), "user_id", "left_anti")
    few = sampling.take_per_group(first.withColumn("_h", sampling.hash32(seed, "user_id", "rn")), ["user_id"], cap, [F.col("_h"), F.col("rn")])
    b.__dict__["decisions"] = stored(few.select("user_id", "rn", "t", "item"))
    answers = timeline.held_out(b.parts).filter("is_novel").select("user_id", "item")
    if not b.decisions.join(answers, ["user_id", "item"], "left_semi").isEmpty():
        raise ValueError("training instances include held-out answers")
    return b, b.options

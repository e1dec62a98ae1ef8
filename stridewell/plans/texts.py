"""Labels, tokens, retrieval, prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import stored
from ..functions import text
from ..operators import items, retrieval
from ..operators.features import type_dictionary
from ..sources import events as src
from ..sources.tables import table
from .sql import DECISIONS, EVENTS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LABELS = f"""{EVENTS}, meta as (select item, arg_max(coalesce(cat, ''), seq) cat, arg_max(coalesce(name, ''), seq) as name from ev where cat is not null or name is not null group by item),
labels as (select i.item, nullif(m.cat, '') cat, case when coalesce(name, '') <> '' then name || ' (' || coalesce(nullif(cat, ''), 'Unknown') || ')' else coalesce(nullif(cat, ''), 'Unknown') end as label
    from (select distinct item from ev) i left join meta m on i.item = m.item)"""


def _stop() -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def _tokens(x: str) -> str:
    return rf"""list_filter(regexp_extract_all(regexp_replace(lower({x}), '[''’]s\b', '', 'g'), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 and not list_contains({_stop()}, w))"""


def labels(spark: SparkSession, d: str) -> DataFrame:
    """item, cat, label of every item of the check-ins."""
    e = src.events(spark, d)
    return e.select("item").distinct().join(items.metadata(e), "item", "left").select("item", "cat", items.label(F.col("cat"), F.col("name")).alias("label"))


@query(f"with {_LABELS} select item, array_to_string({_tokens('label')}, ' ') words, len({_tokens('label')}) n_words from labels")
def tokens(spark, d):
    w = text.tokens(F.col("label"))
    return labels(spark, d).select("item", F.array_join(w, " ").alias("words"), F.size(w).alias("n_words"))


_DOCS = f"""{_LABELS}, {DECISIONS},
hist as (select h.decision_id, h.pos, coalesce(l.label, 'Unknown') as label, coalesce(l.cat, '?') cat from (select decision_id, i pos, history[i] item from (select decision_id, history, unnest(generate_series(1, len(history))) i from dec where user_id is not null)) h left join labels l on h.item = l.item where h.item is not null),
opts as (select o.decision_id, o.idx, coalesce(l.label, 'Unknown') as label from opt o left join labels l on o.item = l.item)"""

_BM25 = f"""{_DOCS}, words as (select decision_id, pos, {_tokens('label')} ws from hist), sized as (select decision_id, pos, len(ws) dl, ws from words),
stats as (select decision_id, count(*) n, avg(dl) avgdl from sized group by 1),
tf as (select decision_id, pos, dl, w, count(*) tf from (select decision_id, pos, dl, unnest(ws) w from sized) group by all), dfs as (select decision_id, w, count(*) df from tf group by all),
q as (select decision_id, w, count(*) qf from (select decision_id, unnest({_tokens('label')}) w from opts) group by all),
hits as (select t.decision_id, t.pos, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) score from tf t join q on t.decision_id = q.decision_id and t.w = q.w join dfs d on d.decision_id = t.decision_id and d.w = t.w join stats s on s.decision_id = t.decision_id group by 1, 2),
scored as (select s.decision_id, s.pos, round(coalesce(h.score, 0), 9) score from sized s left join hits h on h.decision_id = s.decision_id and h.pos = s.pos)"""


def history_labels(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    """decision_id, pos (1 is the oldest), label, cat of the history's places."""
    h = src.decisions(spark, d).filter("user_id is not null").select("decision_id", F.posexplode("history").alias("pos", "item")).filter("item is not null")
    j = h.join(labels(spark, d) if known is None else known, "item", "left")
    return j.select("decision_id", (F.col("pos") + 1).alias("pos"), F.coalesce("label", F.lit("Unknown")).alias("label"), F.coalesce("cat", F.lit("?")).alias("cat"))


def option_labels(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    o = src.options(src.decisions(spark, d)).join(labels(spark, d) if known is None else known, "item", "left")
    return o.select("decision_id", "idx", F.coalesce("label", F.lit("Unknown")).alias("label"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    known = stored(labels(spark, d))
    docs = stored(history_labels(spark, d, known).select("decision_id", "pos", text.tokens(F.col("label")).alias("words")))
    queries = option_labels(spark, d, known).select("decision_id", text.tokens(F.col("label")).alias("words"))
    return retrieval.bm25(docs, queries)


@query(f"with {_BM25} select * from scored")
def bm25_scores(spark, d):
    """How well each place of a history matches the words of the options."""
    return _scored(spark, d)


@query(f"with {_BM25}, best as (select *, row_number() over (partition by decision_id order by score desc, pos desc) r from scored) select decision_id, pos, score, row_number() over (partition by decision_id order by pos) nth from best where r <= 5")
def retrieved_history(spark, d):
    """The five best matching places of each history, in their original order."""
    return retrieval.best_in_order(_scored(spark, d), 5)


_PROMPT = f"""{_DOCS}, hl as (select decision_id, string_agg(label, ', ' order by pos) line from hist group by 1),
tops as (select decision_id, string_agg(cat, ', ' order by r) line from (select *, row_number() over (partition by decision_id order by n desc, p) r from (select decision_id, cat, count(*) n, min(pos) p from hist group by 1, 2)) where r <= 6 group by 1),
ol as (select decision_id, string_agg('  ' || chr(65 + r) || '. ' || label, chr(10) order by r) line, string_agg(chr(65 + r), '/' order by r) letters, count(*) n from (select *, cast(row_number() over (partition by decision_id order by idx) - 1 as int) r from opts) where r < 5 group by 1),
prompts as (select o.decision_id, o.n, concat_ws(chr(10), '{text.HISTORY_HEAD.replace("'", "''")}', '  ' || coalesce(hl.line, ''), '{text.TOP_HEAD}' || coalesce(t.line, ''), '', '{text.QUESTION}', o.line, '', 'Answer with one letter (' || o.letters || '). Answer:') prompt
  from ol o left join hl on hl.decision_id = o.decision_id left join tops t on t.decision_id = o.decision_id)"""


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """decision_id, n_options, prompt, history, cands (arrays of labels) of each decision with options."""
    known = stored(labels(spark, d))
    h = stored(history_labels(spark, d, known))
    per = h.groupBy("decision_id", "cat").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    # a history has at most a dozen places
    top = per.groupBy("decision_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "p", "cat"))), lambda x: x["cat"]), 1, 6).alias("top"))
    hist = h.groupBy("decision_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("history"))
    opts = option_labels(spark, d, known).groupBy("decision_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]).alias("cands"))
    none = F.array().cast("array<string>")
    j = opts.join(hist, "decision_id", "left").join(top, "decision_id", "left").select("decision_id", "cands", F.coalesce("history", none).alias("history"), F.coalesce("top", none).alias("top"))
    return j.select("decision_id", F.size("cands").alias("n_options"), text.render_prompt(F.col("history"), F.col("top"), F.col("cands")).alias("prompt"), "history", "cands")


@query(f"with {_PROMPT} select decision_id, prompt from prompts")
def rendered_prompt(spark, d):
    return prompts(spark, d).select("decision_id", "prompt")


@query(f"with {_PROMPT} select decision_id, cast(n as int) n_options, (select count(*)::int from hist h where h.decision_id = p.decision_id) n_history, md5(prompt) digest, sha256(prompt) long_digest from prompts p")
def prompt_round_trip(spark, d):
    """What reading the rendered prompts back finds, and their digests."""
    p = prompts(spark, d)
    known = [*type_dictionary(table(spark, d, "categories")), "Unknown"]
    r = text.parse_prompt(F.col("prompt"), known)
    found = F.size(r["history"])
    return p.select("decision_id", F.size(r["candidates"]).alias("n_options"), F.when(F.size("history") == 0, 0).otherwise(found).alias("n_history"), F.md5("prompt").alias("digest"), F.sha2("prompt", 256).alias("long_digest"))


@query(
    r"""with a as (select doc_id, regexp_extract(upper(split_part(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1)), '(?:^|[^A-Z])([A-E])(?:[^A-Z]|$)', 1) letter from documents where kind = 'answer')
    select doc_id, case when letter <> '' then ascii(letter) - 65 end choice from a"""
)
def parse_choice(spark, d):
    """The option that each answer text names, if any."""
    a = table(spark, d, "documents").filter("kind = 'answer'")
    return a.select("doc_id", text.parse_choice(F.col("text")).alias("choice"))


@query(r"""select doc_id, len(regexp_extract_all(text, '(?m)^[ ]*([A-E])[.] ')) n_options, coalesce(array_to_string(regexp_extract_all(text, '(?m)^[ ]*([A-E])[.] ', 1), ''), '') letters from documents where kind = 'question' and text is not null""")
def prompt_options(spark, d):
    """Option lines of the questions among the documents."""
    q = table(spark, d, "documents").filter("kind = 'question' and text is not null")
    letters = F.regexp_extract_all("text", F.lit(r"(?md)^[ ]*([A-E])[.] "), 1)
    return q.select("doc_id", F.size(letters).alias("n_options"), F.array_join(letters, "").alias("letters"))


def _noun(c: str) -> str:
    proper = "[" + ", ".join(f"'{w}'" for w in text.PROPER) + "]"
    return f"array_to_string(list_transform(string_split(trim({c}), ' '), lambda w: case when list_contains({proper}, lower(w)) then w else lower(w) end), ' ')"


@query(
    f"""with n as (select trim(cat) cat, {_noun('cat')} noun from categories where trim(cat, ' ' || chr(9)) <> ''),
    a as (select cat, case when lower(noun) in ('health care', 'general entertainment', 'arts & entertainment') then noun when lower(noun[1]) in ('a', 'e', 'i', 'o', 'u') then 'an ' || noun else 'a ' || noun end phrase from n)
    select cat, 'Are you up for ' || phrase || '?' question, 'A new kind of place for you: none of your last 12 places was ' || phrase || '.' none, 'You went to ' || phrase || ' 3 times in your last 12 places.' thrice from a"""
)
def question_texts(spark, d):
    c = table(spark, d, "categories").select(F.trim("cat").alias("cat")).filter("cat <> ''")
    return c.select("cat", text.question_text(F.col("cat")).alias("question"), text.reason_line(F.col("cat"), F.lit(0), F.lit(12)).alias("none"), text.reason_line(F.col("cat"), F.lit(3), F.lit(12)).alias("thrice"))


_SHOWN = r"case when label like '%)' then regexp_extract(label, '\(((?:[^()]|\([^()]*\))*)\)$', 1) else label end"


@query(f"with {_PROMPT}, t as (select decision_id, unnest(string_split(line, ', ')) c from tops) select distinct c category from (select decision_id, {_SHOWN} c from hist where label like '%)' union all select decision_id, {_SHOWN} from opts union all select * from t) where decision_id in (select decision_id from prompts) and c <> ''")
def prompt_vocabulary(spark, d):
    """Every category that the rendered prompts name."""
    return text.vocabulary(prompts(spark, d))


@query(
    f"""with n as (select trim(cat) cat, {_noun('cat')} noun from categories where trim(cat, ' ' || chr(9)) <> ''),
    a as (select cat, noun, case when lower(noun) in ('health care', 'general entertainment', 'arts & entertainment') then noun when lower(noun[1]) in ('a', 'e', 'i', 'o', 'u') then 'an ' || noun else 'a ' || noun end phrase from n)
    select cat, 'They went to ' || phrase || ' 3 times in their last 12 places.' thrice, 'A new kind of place for them: none of their last 12 places was ' || phrase || '.' none, noun || ': 3 of 12' short from a"""
)
def reason_texts(spark, d):
    """The sentences about somebody else's habits, and their short form."""
    c = table(spark, d, "categories").select(F.trim("cat").alias("cat")).filter("cat <> ''")
    about = lambda n: text.reason_about(F.col("cat"), F.lit(n), F.lit(12))
    return c.select("cat", about(3).alias("thrice"), about(0).alias("none"), text.short_reason(F.col("cat"), F.lit(3), F.lit(12)).alias("short"))

"""Conversations as training windows of bounded length, in DataFrame functions only.

A turn is written `<|role|>text<|end|>` and a line break. Control strings inside roles and texts are escaped
reversibly (`&` -> `&a`, `<|` -> `&l`, `|>` -> `&r`), so no text can open or close a turn.

Prefix sums of the turns' tokens choose spans of whole turns: a window's new turns are those whose prefix sum
falls into the same half of what the budget leaves beside the system turn and the history; a turn longer
than that half is a span of its own, whole even where it exceeds the budget. Every window starts with the
conversation's system turn, if its first turn is one, and with up to HISTORY_TURNS of the turns before, as
far as HISTORY tokens reach. These repeats are masked: the loss covers the texts of assistant turns, each
in the one window where it is new.

Turns are ordered by turn, role and text, nulls first; null roles and texts count as empty ones; rows that
repeat are turns of their own; a null conv_id is a conversation. Empty tables give no rows. Extra columns are
ignored. One conversation's turns are put in order by one task (sorted, spilled if need be).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import textkit as K

BUDGET = 512
HISTORY = 96
HISTORY_TURNS = 2
#: Tokens that the template adds to a turn.
FRAME = 4
TOKEN = r"[0-9A-Za-z]+|[^0-9A-Za-z \t\r\n]"


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&a")), F.lit("<|"), F.lit("&l")), F.lit("|>"), F.lit("&r"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&r"), F.lit("|>")), F.lit("&l"), F.lit("<|")), F.lit("&a"), F.lit("&"))


def _turns(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def _spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its place n, its window and the windows it is repeated in."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    w = Window.partitionBy("conv_id").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = turns.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + FRAME).withColumn("n", F.row_number().over(w))
    system = (F.col("n") == 1) & (F.col("role") == "system")
    t = t.withColumn("system", system).withColumn("sys_tokens", F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole))
    t = t.withColumn("half", F.greatest(F.lit(1), F.floor((budget - history - F.col("sys_tokens")) / 2).cast("long")))
    t = t.withColumn("before", F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).over(upto) - F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    t = t.withColumn("part", F.floor(F.col("before") / F.col("half"))).withColumn("large", F.col("tokens") > F.col("half"))
    after_system = F.lag("system").over(w)
    starts = F.when(F.col("n") == 1, True).when(after_system, False).otherwise(F.col("large") | F.lag("large").over(w) | (F.col("part") != F.lag("part").over(w)))
    t = t.withColumn("starts", starts).withColumn("window", F.sum(F.col("starts").cast("int")).over(upto)).withColumn("windows", F.max("window").over(whole))
    again = []
    for d in range(1, HISTORY_TURNS + 1):
        near = F.lead("starts", d).over(w) & (F.lead("before", d).over(w) - F.col("before") <= history) & ~F.col("system")
        again.append(F.when(near, F.lead("window", d).over(w)))
    repeats = F.when(F.col("system") & (F.col("windows") > 1), F.sequence(F.lit(2), F.col("windows").cast("int")).cast("array<bigint>")).when(F.col("system"), F.array().cast("array<bigint>")).otherwise(F.array_compact(F.array(*again)))
    return t.withColumn("repeats", repeats)


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window: conv_id, window, formatted, n_turns, n_repeated (leading turns that are repeats), loss (spans, in characters)."""
    t = _spans(_turns(conversations), budget, history)
    piece = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"), escape(F.col("text")), F.lit("<|end|>\n"))
    t = t.select(
        "conv_id", "n", piece.alias("piece"), (F.length(escape(F.col("role"))) + 4).alias("skip"), F.length(escape(F.col("text"))).alias("size"), (F.col("role") == "assistant").alias("target"),
        F.concat(F.array(F.struct(F.col("window"), F.lit(False).alias("repeated"))), F.transform("repeats", lambda x: F.struct(x.alias("window"), F.lit(True).alias("repeated")))).alias("places"),
    )
    placed = t.withColumn("p", F.explode("places")).select("conv_id", "p.window", F.struct("n", "p.repeated", "piece", "skip", "size", "target").alias("turn"))
    windows = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    loss = F.aggregate(
        "turns",
        empty,
        lambda done, x: F.struct(
            (done["at"] + F.length(x["piece"])).alias("at"),
            F.when(x["target"] & ~x["repeated"], F.concat(done["spans"], F.array(F.struct((done["at"] + x["skip"]).alias("start"), x["size"].alias("length"))))).otherwise(done["spans"]).alias("spans"),
        ),
        lambda done: done["spans"],
    )
    return windows.select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"), loss.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and loss texts of each conversation, from the formatted windows alone: conv_id, n_turns, turns, loss_text, formatted_chars."""
    turns = F.split("formatted", r"<\|end\|>\n")
    new = F.slice(turns, F.col("n_repeated") + 1, F.size(turns) - 1 - F.col("n_repeated"))

    def plain(t: Column) -> Column:
        head = F.substring_index(t, "|>", 1)
        return F.concat(unescape(F.substr(head, F.lit(3))), F.lit("\n"), unescape(F.substr(t, F.length(head) + 3)), F.lit("\n"))

    learnt = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    parts = windows.select("conv_id", "window", F.size(new).alias("n"), F.array_join(F.transform(new, plain), "").alias("turns"), F.array_join(learnt, "").alias("loss_text"), F.length("formatted").alias("chars"))
    gathered = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("w"))
    return gathered.select(
        "conv_id", "n_turns", F.array_join(F.transform("w", lambda x: x["turns"]), "").alias("turns"), F.array_join(F.transform("w", lambda x: x["loss_text"]), "").alias("loss_text"), "formatted_chars"
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(sample).alias("text"))
    rows = K.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_conversations(rows))
    return back.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def _oracle() -> str:
    esc = "replace(replace(replace({0}, '&', '&a'), '<|', '&l'), '|>', '&r')"
    order = "partition by conv_id order by turn nulls first, role, text"
    copies = "".join(
        f" + coalesce(case when not system and lead(starts, {d}) over (partition by conv_id order by n) and lead(before, {d}) over (partition by conv_id order by n) - before <= {HISTORY} then 1 end, 0)" for d in range(1, HISTORY_TURNS + 1)
    )
    return rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t as (select *, len(regexp_extract_all(text, '{TOKEN}')) + {FRAME} as tokens, row_number() over ({order}) as n, length({esc.format("role")}) + length({esc.format("text")}) + 12 as size from c),
s as (select *, n = 1 and role = 'system' as system, max(case when n = 1 and role = 'system' then tokens else 0 end) over (partition by conv_id) as sys_tokens from t),
h as (select *, greatest(1, cast(floor(({BUDGET} - {HISTORY} - sys_tokens) / 2) as bigint)) as half,
  coalesce(sum(case when system then 0 else tokens end) over (partition by conv_id order by n rows between unbounded preceding and 1 preceding), 0) as before from s),
p as (select *, before // half as part, tokens > half as large from h),
g as (select *, case when n = 1 then true when lag(system) over (partition by conv_id order by n) then false
  else large or lag(large) over (partition by conv_id order by n) or part <> lag(part) over (partition by conv_id order by n) end as starts from p),
w as (select *, sum(starts::int) over (partition by conv_id) as windows, 1{copies} as copies from g)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  length(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), ''))::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  sum(size * case when system then windows else copies end)::bigint as formatted_chars
from w group by conv_id
"""


OP8_SQL = _oracle()

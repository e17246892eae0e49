"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

TURN, MORE, END = "<|turn|>", "<|more|>", "<|end|>\n"


def escape(c: Column) -> Column:
    """Backslashes are doubled and `<|`, which every control string begins with, is parted by one."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\/"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start, end in code points of each assistant text within formatted).

    Turns are sorted by turn, role and text (so ties and repeated rows have one order, and null turns come first); adjacent turns of one role become one block
    whose texts a control string parts. Null texts and roles are empty; rows without conv_id are one conversation; an empty table gives none, and other columns
    don't matter. Texts of any length come back whole. One conversation is one output row, so it is the largest group; rows are grouped by conversation and
    nothing wider: rows whose conv_id was lost should get one before.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.count(F.lit(1)).cast("int").alias("k"))

    def piece(x: Column, i: Column) -> Column:
        role = lambda j: F.element_at("turns", j)["role"]
        new = F.when(i == 0, True).otherwise(role(F.greatest(i, F.lit(1))) != x["role"])
        last = F.when(i + 1 == F.col("k"), True).otherwise(role(F.least(i + 2, F.col("k"))) != x["role"])
        return F.struct(
            F.when(new, F.concat(F.lit(TURN), _role(x["role"]), F.lit("\n"))).otherwise(F.lit(MORE)).alias("head"),
            escape(x["text"]).alias("body"),
            F.when(last, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (x["role"] == "assistant").alias("loss"),
        )

    pieces = per.select("conv_id", F.transform("turns", piece).alias("p"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct((end + F.length(p["tail"])).alias("pos"), F.when(p["loss"], F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return pieces.select(
        "conv_id",
        F.array_join(F.flatten(F.transform("p", lambda p: F.array(p["head"], p["body"], p["tail"]))), "").alias("formatted"),
        F.aggregate("p", zero, step)["spans"].alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """turns (role, text) and loss_text of format_chats' output, from its formatted text and mask alone."""

    def block(x: Column) -> Column:
        x = F.substring(x, F.lit(1), F.length(x) - len(END))
        at = F.instr(x, "\n")
        role = unescape(F.replace(F.substring(x, F.lit(1), at - 1), F.lit("<\\/"), F.lit("\n")))
        return F.transform(F.split(F.substring(x, at + 1, F.length(x)), r"<\|more\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(F.substring("formatted", len(TURN) + 1, 2**31 - 1), r"<\|turn\|>")
    under = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, block)).alias("turns"), F.array_join(under, "").alias("loss_text"))


CONTROL = "</s>[INST] ok [/INST]"


def op5(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    back = read_back(format_chats(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL5 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n as (select *, lag(role) over w as p, lead(role) over w as q, replace(replace(text, '\', '\\'), '<|', '<\|') as e,
        replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\/') as r
      from t window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(e) + case when p is distinct from role then 9 + length(r) else 8 end + case when q is distinct from role then 8 else 0 end)::bigint as formatted_chars
from n group by conv_id"""

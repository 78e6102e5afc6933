"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged into one block. A
block is written ``<s>[ROLE]role[/ROLE]text[SEP]text</s>`` and a line feed: one text for each turn that was merged.
Control strings inside roles and texts get a backslash after their first character, one more if they have some, so
no text can end a turn or forge one, and taking one backslash away again restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's strings, and instruction marks that a text must not forge.
OPEN, CLOSE, ROLE, END_ROLE, SEP = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[SEP]"
NAMES = r"/?s>|/?ROLE\]|SEP\]|/?INST\]"
ASSISTANT = "assistant"
#: Pieces over which spans are summed at once.
CHUNK = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({NAMES})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({NAMES})", "$1$2$3")


def _starts(turns: Column) -> Column:
    """Places of sorted turns whose role isn't that of the turn before."""
    role = lambda i: F.get(turns, i)["role"]
    return F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))


def _merged(turns: Column, starts: Column) -> Column:
    """Sorted turns as blocks: role and the texts of adjacent turns with that role. Every turn is copied once."""
    texts = lambda s, j: F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, j + 1), F.size(turns)) - s), lambda t: t["text"])
    return F.transform(starts, lambda s, j: F.struct(F.get(turns, s)["role"].alias("role"), texts(s, j).alias("texts")))


def _pieces(block: Column) -> Column:
    """A block as pieces of output, each with whether it bears loss."""
    head = F.struct(F.concat(F.lit(OPEN + ROLE), escape(block["role"]), F.lit(END_ROLE)).alias("text"), F.lit(False).alias("loss"))
    bears = block["role"] == ASSISTANT
    texts = F.transform(
        block["texts"],
        lambda t, i: F.array(F.struct(F.when(i > 0, F.lit(SEP)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")), F.struct(escape(t).alias("text"), bears.alias("loss"))),
    )
    return F.concat(F.array(head), F.flatten(texts), F.array(F.struct(F.lit(CLOSE + "\n").alias("text"), F.lit(False).alias("loss"))))


def _spans(pieces: Column) -> Column:
    """Where pieces that bear loss lie. Sums run over chunks of CHUNK pieces, then over chunks, so no array grows by one again and again."""
    none = F.array().cast("array<struct<at:int,length:int>>")
    size = lambda p: F.length(p["text"])
    step = lambda acc, p: F.struct(
        (acc["at"] + size(p)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("at"), size(p).alias("length"))))).otherwise(acc["spans"]).alias("spans")
    )
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / F.lit(CHUNK)).cast("int")), lambda c: F.aggregate(F.slice(pieces, c * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))
    shifted = lambda acc, c: F.array(F.transform(c["spans"], lambda s: F.struct((s["at"] + acc["at"]).alias("at"), s["length"].alias("length"))))
    return F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<at:int,length:int>>>").alias("spans")),
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["spans"], shifted(acc, c)).alias("spans")),
        lambda acc: F.flatten(acc["spans"]),
    )


def formatted(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, ``formatted`` and ``loss_spans``, structs of ``at`` (from 0) and ``length`` in code points that cover assistants' texts.

    Turns are in order of ``turn``, null first; turns of equal number are in order of role, then text, so repeated rows are all kept, side by
    side. Null roles and texts count as empty. Rows with a null conversation form one conversation. A conversation is
    one row of output, so its turns meet in one task; nothing else does. Cost grows with a conversation's length, not its square. Other columns are ignored. An empty table gives no rows.
    """
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    turns = conversations.groupBy(F.col(f"`{conv}`").alias(conv)).agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    turns = turns.select(F.col(f"`{conv}`"), "_turns", _starts(F.col("_turns")).alias("_starts"))
    pieces = turns.select(F.col(f"`{conv}`"), F.flatten(F.transform(_merged(F.col("_turns"), F.col("_starts")), _pieces)).alias("_pieces"))
    return pieces.select(F.col(f"`{conv}`"), F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("formatted"), _spans(F.col("_pieces")).alias("loss_spans"))


def turns_of(text: Column) -> Column:
    """Read the turns back from a formatted conversation: structs of role and text, one for each turn that went in."""
    blocks = F.filter(F.split(text, r"</s>\n"), lambda b: b != "")

    def read(b: Column) -> Column:
        role = unescape(F.regexp_extract(b, r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\]", 1))
        body = F.regexp_extract(b, r"(?s)^<s>\[ROLE\].*?\[/ROLE\](.*)$", 1)
        return F.transform(F.split(body, r"\[SEP\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, read))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["at"] + 1, s["length"]))), "")


def digest(out: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the query returns of formatted conversations, read back from them."""
    back = out.select(conv, "formatted", turns_of(F.col("formatted")).alias("_turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("_loss"))
    spelled = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The query's input: all conversations and one, -1, whose texts hold control strings."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all
 select -1, t, case when t = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(t)),
e as (select *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?ROLE\]|SEP\]|/?INST\])', '\1\\\2\3', 'g') as er, regexp_replace(text, '([<\[])(\\*)(/?s>|/?ROLE\]|SEP\]|/?INST\])', '\1\\\2\3', 'g') as et,
 coalesce(lag(role) over (partition by conv_id order by turn, role, text) = role, false) as more from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(length(et) + case when more then 5 else length('<s>[ROLE][/ROLE]</s>' || er) + 1 end) as bigint) as formatted_chars
from e group by conv_id
"""

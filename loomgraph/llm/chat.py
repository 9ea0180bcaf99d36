"""Chat formatting with typed content parts (operator 10, DataFrame functions only).

A message holds content parts ``(type, text, ref, width, height, seconds, pages)``.  A visitor turns them, in order,
into one string: text is escaped, and an image, audio or document part becomes a placeholder.  The k-th
placeholder of a conversation belongs to its k-th attachment record, which has the reference and the number of
tokens that the placeholder is expanded to.

The template writes each turn as ``<|turn|>role<|body|>content<|end|>``.  All its control strings begin with ``<``; in
roles and texts ``&``, ``<`` and ``[`` become character references, so no control string, of this template or of
others that use brackets, can occur there, and the original comes back by replacing them.  The loss mask is the
list of code-point spans of the assistant's contents in the formatted string.

One conversation is one output string, so its turns have to meet in one task; conversations are spread
over tasks by a hash of their id.

Defined cases: null text, role or content is empty; null conv_ids form one conversation; turns are ordered
by turn (null first), then role, then content, so ties and repeated rows have one order and all stay; an
unknown part type counts as an attachment of no tokens; an empty table gives an empty result; other columns
are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|file|>"
#: Fixed escapes; the first is undone last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Expansion: pixels per side of an image token, audio tokens a second, tokens a page.
IMAGE_SIDE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def _visit(part: Column) -> Column:
    out = F.lit(OTHER)
    for kind, mark in PLACEHOLDER.items():
        out = F.when(part.type == kind, F.lit(mark)).otherwise(out)
    return F.when(part.type == "text", escape(F.coalesce(part.text, F.lit("")))).otherwise(out)


def _tokens(part: Column) -> Column:
    tiles = lambda side: F.ceil(F.greatest(F.coalesce(side, F.lit(0)), F.lit(1)) / IMAGE_SIDE)
    image = tiles(part.width) * tiles(part.height)
    audio = F.ceil(F.coalesce(part.seconds, F.lit(0.0)) * AUDIO_RATE)
    pages = F.coalesce(part.pages, F.lit(1)) * PAGE_TOKENS
    return F.when(part.type == "image", image).when(part.type == "audio", audio).when(part.type == "document", pages).otherwise(0).cast("long")


def text_part(text: Column) -> Column:
    """Content of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def format_chats(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows ``conv_id, turn, role, content`` (array of parts) to one row per conversation: conv_id, n_turns,
    formatted, loss_mask (array of (start, end), end exclusive), attachments (array of (ordinal, turn, type, ref,
    tokens)), expanded_tokens (their sum)."""
    content = F.coalesce("content", F.array().cast(f"array<{PART}>"))
    rows = messages.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.array_join(F.transform(content, _visit), "").alias("body"),
            F.transform(F.filter(content, lambda p: p.type.isNull() | (p.type != "text")), lambda p: F.struct(p.type.alias("type"), p.ref.alias("ref"), _tokens(p).alias("tokens"))).alias("files"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t.role), F.lit(BODY))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t.body, F.lit(END))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc.at + F.length(head(t))
        end = begin + F.length(t.body)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t.role.isin(*trained), F.concat(acc.out, span)).otherwise(acc.out).alias("out"))

    files = F.flatten(F.transform("turns", lambda t: F.transform(t.files, lambda f: F.struct(t.turn.alias("turn"), f.type.alias("type"), f.ref.alias("ref"), f.tokens.alias("tokens")))))
    numbered = F.transform(files, lambda f, i: F.struct((i + 1).alias("ordinal"), f.turn.alias("turn"), f.type.alias("type"), f.ref.alias("ref"), f.tokens.alias("tokens")))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), F.aggregate("turns", start, step, lambda acc: acc.out).alias("loss_mask"), numbered.alias("attachments")).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f.tokens))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, unescaped: array of (role, text)."""
    turns = F.filter(F.split(formatted, END.replace("|", "\\|")), lambda t: t != "")
    bare = F.transform(turns, lambda t: F.substr(t, F.lit(len(TURN) + 1)))
    return F.transform(bare, lambda t: F.transform(F.array(F.split(t, BODY.replace("|", "\\|"), 2)), lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))[0])


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, s.start + 1, s.end - s.start))), "")


def digest(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted string."""
    chats = format_chats(conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("content")))
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss_mask"))
    back = chats.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that is added to the table; its texts imitate another template's control strings.
ADDED = "select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"

ORACLE = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') as r, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') as t from c),
g as (select conv_id, count(*) as n, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, t) as said,
  coalesce(string_agg(text, '' order by turn, t) filter (where role = 'assistant'), '') as loss, sum(length(r) + length(t) + {len(TURN + BODY + END)}) as chars from e group by conv_id)
select conv_id, n::bigint as n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, chars::bigint as formatted_chars from g
"""

"""Quotation linking of chat and mail (operator 4).

A message's lines are parsed into levels: a line that begins with k signs '>' (spaces may stand
between them) is quoted k deep.  A passage is a run of lines of one level without a blank
line; it is normalised (lower-cased, white space collapsed, as lines may be wrapped anew) and
hashed, and so is each of its lines.  Hashes are joined, within a conversation, to those of
the passages that other messages have unquoted.  A message answers the earlier message that
its longest matched passage of level 1 is from, of equally long ones the latest.  Deeper passages are
linked in the same way, and don't make a parent.  The conversation is put into reply order:
every message is followed by its answers, in order of time, each with its own.  What a message
quotes, and the line that introduces a quote ("On ... wrote:"), are taken out.

Defined results: messages are in order of turn, rows of one turn in order of role, then text; repeated
rows stay apart; a null text, or one that is all quotes, has an empty body; a message without a
matched passage is a root; a message never answers itself or a later one; lines without a
letter or digit, and level 0 of other conversations, match nothing; a null conv_id is a conversation
of its own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import table, workers_find_package

_LEVEL = re.compile(r"[ \t]*((?:>[ \t]*)+)")
_SAID = re.compile(r"(?:On\b.*\bwrote:|.*\b(?:schrieb|a écrit|escribió) ?:)\s*", re.DOTALL)
_WORD = re.compile(r"[^\W_]")


def levels(text: str | None) -> list[tuple[int, str]]:
    """(level, line without its signs) of every line."""
    out = []
    for line in (text or "").split("\n"):
        line = line.removesuffix("\r")
        found = _LEVEL.match(line)
        out.append((found.group(1).count(">"), line[found.end() :]) if found else (0, line))
    return out


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(body without quotes, (level, normalised passage) of every passage and of its lines)."""
    lines = levels(text)
    body, passages, run = [], [], []
    for k, (level, line) in enumerate(lines):
        said = not level and k + 1 < len(lines) and lines[k + 1][0] and _SAID.fullmatch(line)
        if not level and not said:
            body.append(line)
        if run and (run[-1][0] != level or not line.strip() or said):
            passages.append(run)
            run = []
        if line.strip() and not said:
            run.append((level, line))
    passages.append(run)
    out: dict[tuple[int, str], None] = {}
    for run in passages:
        own = [" ".join(line.lower().split()) for _, line in run]
        for passage in [" ".join(own), *own]:
            if run and _WORD.search(passage):
                out[run[0][0], passage] = None
    return "\n".join(body).strip("\n"), list(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [parse(t) for t in batch.column("text").to_pylist()]
        passages = [[{"level": k, "hash": np.uint64(xxhash.xxh3_64_intdigest(p)).astype(np.int64), "size": len(p)} for k, p in own] for _, own in got]
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())]))
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([b for b, _ in got], pa.string()), pa.array(passages, kind)], [*keep, "body", "passages"])


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth and place in reply order of the messages of one conversation."""
    rows = pa.Table.from_batches(list(batches)).sort_by("seq")
    seq, parent = rows.column("seq").to_pylist(), rows.column("parent").to_pylist()
    place = {s: k for k, s in enumerate(seq)}
    children: list[list[int]] = [[] for _ in seq]
    roots = []
    for k, p in enumerate(parent):
        (roots if p is None else children[place[p]]).append(k)
    stack, at = [(k, 0) for k in reversed(roots)], 0
    depth, order = [0] * len(seq), [0] * len(seq)
    while stack:
        k, d = stack.pop()
        depth[k], order[k], at = d, at, at + 1
        stack += [(c, d + 1) for c in reversed(children[k])]
    yield pa.RecordBatch.from_arrays([rows.column("conv_id").combine_chunks(), pa.array(seq, pa.int32()), pa.array(depth, pa.int32()), pa.array(order, pa.int32())], ["conv_id", "seq", "depth", "reply_order"])


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, turn, role, body, passages) of every message, as a written table."""
    workers_find_package(conversations.sparkSession)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.col("text").cast("string")).withColumn("seq", F.row_number().over(order))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return table(rows.mapInArrow(_parse, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, seq int, body string, passages array<struct<level: int, hash: long, size: int>>"))


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, seq, level, source, size): for every message and level the earlier message that its longest matched passage is from."""
    cut = parsed.select("conv_id", "seq", F.inline("passages"))
    quoted = cut.filter("level > 0")
    own = cut.filter("level = 0").select(F.col("conv_id").alias("c"), F.col("seq").alias("source"), F.col("hash").alias("h"))
    same = quoted["hash"].eqNullSafe(own["h"]) & quoted["conv_id"].eqNullSafe(own["c"]) & (own["source"] < quoted["seq"])
    best = F.max(F.struct("size", "source")).alias("best")
    return quoted.join(own, same).groupBy("conv_id", "seq", "level").agg(best).select("conv_id", "seq", "level", "best.source", "best.size")


def threads(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, turn, role, answers, depth, reply_order, quoted, body): every message without quotes, in its place; quoted: (level, source) of deeper links too."""
    parsed = messages(conversations)
    linked = links(parsed).groupBy("conv_id", "seq").agg(
        F.max(F.when(F.col("level") == 1, F.col("source"))).alias("answers"),
        F.array_join(F.array_sort(F.collect_list(F.concat("level", F.lit(":"), "source"))), " ").alias("quoted"),
    )
    linked = linked.toDF("c", "s", "answers", "quoted")
    on = parsed["conv_id"].eqNullSafe(linked["c"]) & (parsed["seq"] == linked["s"])
    whole = table(parsed.select("conv_id", "seq", "turn", "role", "body").join(linked, on, "left").drop("c", "s"))
    kind = whole.schema["conv_id"].dataType.simpleString()
    tree = whole.select("conv_id", "seq", F.col("answers").alias("parent")).groupBy("conv_id").applyInArrow(_tree, f"conv_id {kind}, seq int, depth int, reply_order int").toDF("c", "s", "depth", "reply_order")
    on = whole["conv_id"].eqNullSafe(tree["c"]) & (whole["seq"] == tree["s"])
    return whole.join(tree, on).select("conv_id", "seq", "turn", "role", "answers", "depth", "reply_order", F.coalesce("quoted", F.lit("")).alias("quoted"), "body")


#: Messages with quotes made of the table conversations, which has none, for Spark and DuckDB alike.
#: Every turn but the first quotes the turn before, or on each third turn the one two before, and what
#: that turn quoted itself one level deeper; each fifth turn is a new thread.
QUOTED_SQL = """
with o as (select conv_id, turn, role, text, lag(text, 1) over w as t1, lag(text, 2) over w as t2, lag(text, 3) over w as t3 from conversations
  window w as (partition by conv_id order by turn, role, text)),
p as (select *, case when turn % 5 = 4 then null when turn % 3 = 2 then t2 else t1 end as near, case when turn % 3 = 2 then t3 else t2 end as far from o)
select conv_id, turn, role, case when near is null then text else concat('On that day they wrote:', chr(10),
  case when far is null then '' else concat('> > ', replace(far, chr(10), concat(chr(10), '> > ')), chr(10)) end,
  '> ', replace(near, chr(10), concat(chr(10), '> ')), chr(10), chr(10), text) end as text from p
"""


def quoted_conversations(conversations: DataFrame) -> DataFrame:
    """The messages that ``QUOTED_SQL`` makes of a table of conversations."""
    return conversations.sparkSession.sql(QUOTED_SQL.replace("from conversations", "from {conversations}"), conversations=conversations)


def sql() -> str:
    """``threads`` over ``QUOTED_SQL`` for DuckDB."""
    return rf"""
with recursive q as ({QUOTED_SQL}),
m as (select conv_id, turn, role, text, cast(row_number() over (partition by conv_id order by turn, role, text) as integer) as seq from q),
l as (select conv_id, seq, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as raw from m),
v as (select conv_id, seq, k, cast(length(regexp_replace(regexp_extract(raw, '^[ \t]*((>[ \t]*)+)', 1), '[^>]', '', 'g')) as integer) as level, regexp_replace(raw, '^[ \t]*(>[ \t]*)+', '') as line from l),
w as (select *, level = 0 and coalesce(lead(level) over (partition by conv_id, seq order by k), 0) > 0 and regexp_full_match(line, 'On\b.*\bwrote:\s*') as said from v),
b as (select conv_id, seq, trim(string_agg(line, chr(10) order by k), chr(10)) as body from w where level = 0 and not said group by all),
g as (select *, trim(line) = '' or said as gap, sum(case when trim(line) = '' or said or level is distinct from lag_level then 1 else 0 end) over (partition by conv_id, seq order by k) as run
      from (select *, lag(level) over (partition by conv_id, seq order by k) as lag_level from w)),
n as (select conv_id, seq, level, run, k, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) as norm from g where not gap),
s as (select conv_id, seq, level, norm as passage from n union select conv_id, seq, level, string_agg(norm, ' ' order by k) from n group by conv_id, seq, level, run),
z as (select * from s where regexp_matches(passage, '[\p{{L}}\p{{N}}]')),
j as (select a.conv_id, a.seq, a.level, max({{'size': length(a.passage), 'source': o.seq}}) as best from z a join z o on a.conv_id = o.conv_id and a.passage = o.passage and o.level = 0 and o.seq < a.seq where a.level > 0 group by 1, 2, 3),
k as (select conv_id, seq, max(case when level = 1 then best.source end) as answers, array_to_string(list_sort(list(level || ':' || best.source)), ' ') as quoted from j group by 1, 2),
a as (select m.conv_id, m.seq, m.turn, m.role, k.answers, coalesce(k.quoted, '') as quoted, coalesce(b.body, '') as body from m left join k using (conv_id, seq) left join b using (conv_id, seq)),
t as (select conv_id, seq, 0 as depth, [seq] as path from a where answers is null
      union all select a.conv_id, a.seq, t.depth + 1, list_append(t.path, a.seq) from a join t on a.conv_id = t.conv_id and a.answers = t.seq)
select a.conv_id, a.seq, a.turn, a.role, a.answers, t.depth, cast(row_number() over (partition by a.conv_id order by t.path) - 1 as integer) as reply_order, a.quoted, a.body from a join t using (conv_id, seq)"""

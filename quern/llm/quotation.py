"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (the number of ``>`` before the text).  Consecutive lines of one
level are a passage; passages of level 0 are the message's own text.  A passage's words are folded (lower case, no
punctuation, one space) and hashed: own text as a whole, by paragraph and by line, quotes as a whole and by line.
A quote of level k is joined to the messages of its conversation that hold a passage of that hash as own text.  The message's parent is the latest earlier
message that one of its outermost quotes comes from, by the longest quote that is found; deeper quotes say what the
parent replied to and only count if no outermost one is found.  A message without a quote that is found replies to
the message before it.

The result has one row a message: reply order by depth first, a parent before its replies and replies by turn, its
text without the quotes and without the line that announces one (``On … wrote:``).

Only hashes are shuffled and grouped; texts stay in the scan until the last join.  The latest earlier origin of a quote
is found in one pass over the messages that hold its hash, by turn, so that a line that a whole conversation repeats
costs no more than others.  Reply trees are walked in tasks of some ``TASK_TURNS`` messages, over (turn, parent) only,
16 bytes a message: a conversation is one tree and is not divided.

Defined cases: null and empty texts have no quotes and stay as they are; rows without conv_id or turn belong to no
conversation: they keep their text, position and parent null; rows that repeat (conv_id, turn) are one message for
links and share position and parent; quotes of texts that aren't in the conversation are removed like others;
hashes of fewer than ``min_words`` words link nothing ("Thanks."); a text of any length is parsed in whole; an empty
table stays empty; of the columns conv_id, turn, role and text are read, whatever others there are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import kernel as K
from quern.llm.common import cut, map_arrow, pick, prepare

MIN_WORDS, TASK_TURNS = 3, 20_000
_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
_ANNOUNCE = re.compile(r"[ \t]*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)[ \t]*:[ \t]*", re.I)


def parse(text: str) -> list[tuple[int, list[str]]]:
    """(level, lines) of each passage, in order, marks removed."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _QUOTE.fullmatch(line)
        level, rest = (m[1].count(">"), m[2]) if m else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
    return out


def own_text(text: str | None) -> str | None:
    """The text without quotes and the lines that announce them; unchanged if it quotes nothing."""
    if not text or ">" not in text:
        return text
    passages = parse(text)
    if all(level == 0 for level, _ in passages):
        return text
    kept = []
    for k, (level, lines) in enumerate(passages):
        if level:
            continue
        if k + 1 < len(passages):
            while lines and not lines[-1].strip():
                lines.pop()
            if lines and _ANNOUNCE.fullmatch(lines[-1]):
                lines.pop()
        kept += lines
    return "\n".join(kept).strip("\n")


def passage_hashes(passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each passage's words, and their number."""
    if not passages:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cps, bounds = K.code_points(passages)
    h, ws, _ = K.words(cps)
    at = np.searchsorted(ws, bounds)
    return K.run_hashes(h, at[:-1], at[1:], 5).view(np.int64), np.diff(at)


def passages_of(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """The passages that a message can be quoted by, and its quotes with their levels: whole, by paragraph, by line."""
    passages = parse(text) if ">" in text else [(0, text.split("\n"))]
    own, quotes = [], []
    for level, lines in passages:
        units = {"\n".join(lines), *lines}
        paragraph: list[str] = []
        for line in [*lines, ""]:
            if line.strip():
                paragraph.append(line)
            elif paragraph:
                units.add("\n".join(paragraph))
                paragraph = []
        if level:
            quotes += [(level, u) for u in units]
        else:
            own += units
    if len(passages) > 1:
        own.append("\n".join("\n".join(lines) for level, lines in passages if not level))
    return own, quotes


def _hash_task(min_words: int):
    def task(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            at, level, what = [], [], []
            for i, t in enumerate(texts):
                own, quotes = passages_of(t or "")
                own = set(own)
                at += [i] * (len(own) + len(quotes))
                level += [0] * len(own) + [q[0] for q in quotes]
                what += [*own, *(q[1] for q in quotes)]
            h, n = passage_hashes(what)
            ok = n >= min_words
            rows = pa.array(np.array(at, np.int64)[ok])
            keys = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in ("conv_id", "turn")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.array(level, np.int32)[ok]), pa.array(h[ok]), pa.array(n[ok])], ["conv_id", "turn", "level", "h", "words"])

    return task


def links(messages: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(conv_id, turn, parent) for messages (conv_id, turn, text) with a quote whose origin is found."""
    kinds = [messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    hashes = cut(map_arrow(messages.where("conv_id is not null and turn is not null and text is not null"), _hash_task(min_words), f"conv_id {kinds[0]}, turn {kinds[1]}, level int, h long, words long"))
    quoted = hashes.where("level > 0").select("conv_id", "h").distinct()  # most own text is never quoted
    some = hashes.join(quoted, ["conv_id", "h"], "left_semi")
    # turns may be of any type that has an order: a message's own passages are passed over by their rank
    at = F.dense_rank().over(Window.partitionBy("conv_id", "h").orderBy("turn"))
    origin = F.when(F.col("level") == 0, F.struct("at", "turn"))
    ranked = some.withColumn("at", at).withColumn("origin", origin)
    before = Window.partitionBy("conv_id", "h").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = ranked.withColumn("from", F.max("origin").over(before)["turn"]).where("level > 0 and from is not null")
    best = F.max_by("from", F.struct(-F.col("level"), F.col("words"), F.col("from")))
    return found.groupBy("conv_id", "turn").agg(best.alias("parent"))


def order(parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position depth first, and depth, of messages in the order of their turns; a parent is an earlier place or -1."""
    n = len(parents)
    depth, size = np.zeros(n, np.int64), np.ones(n, np.int64)
    up = parents.tolist()
    for i, p in enumerate(up):
        if p >= 0:
            depth[i] = depth[p] + 1
    for i in range(n - 1, -1, -1):
        if up[i] >= 0:
            size[up[i]] += size[i]
    # a reply comes after its parent and that one's earlier replies with all that is below them
    position, free, roots = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for i, p in enumerate(up):
        if p < 0:
            position[i] = roots
            roots += size[i]
        else:
            position[i] = free[p]
            free[p] += size[i]
        free[i] = position[i] + 1
    return position, depth


def _tree_task(names: list[str]):
    def trees(table: pa.Table) -> pa.RecordBatch:
        conv, turn = table["conv_id"], table["turn"]
        parent = table["parent"]
        n = table.num_rows
        place = {t: i for i, t in enumerate(turn.to_pylist())}
        at = np.array([place[p] if p is not None else i - 1 for i, p in enumerate(parent.to_pylist())], np.int64)
        position, depth = order(at)
        named = turn.combine_chunks().take(pa.array(at, mask=at < 0)) if n else turn
        return pa.RecordBatch.from_arrays([conv.combine_chunks(), turn.combine_chunks(), named, pa.array(position), pa.array(depth)], names)

    def task(batches):
        # rows come sorted by conversation and turn; the last conversation of a batch may go on in the next
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            conv = table["conv_id"].combine_chunks()
            new = np.flatnonzero(pc.not_equal(conv[1:], conv[:-1]).to_numpy(zero_copy_only=False)) + 1
            edges = [0, *new.tolist(), table.num_rows]
            if held and held[0]["conv_id"][0].as_py() != conv[0].as_py():
                yield trees(pa.concat_tables(held))
                held = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                held.append(table.slice(a, b - a))
                if b < table.num_rows:
                    yield trees(pa.concat_tables(held))
                    held = []
        if held:
            yield trees(pa.concat_tables(held))

    return task


def _text_task(names):
    def task(batches):
        for batch in batches:
            text = [own_text(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names], names)

    return task


def threads(conversations: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, position, depth): messages without quotes, in reply order."""
    prepare(conversations.sparkSession)
    own = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    kinds = [own.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    parents = links(own.select("conv_id", "turn", "text"), min_words)
    turns = own.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    known = cut(turns.join(parents, ["conv_id", "turn"], "left"))
    # a few bytes a message, but a walk in Python: adaptive execution would put all of them into one task
    tasks = max(1, -(-known.count() // TASK_TURNS))
    names = ["conv_id", "turn", "parent_turn", "position", "depth"]
    rows = known.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "turn", "parent")
    tree = map_arrow(rows, _tree_task(names), f"conv_id {kinds[0]}, turn {kinds[1]}, parent_turn {kinds[1]}, position long, depth long")
    plain = own.mapInArrow(_text_task(own.columns), own.schema)
    return plain.join(tree, ["conv_id", "turn"], "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, without quotes and in reply order."""
    return threads(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

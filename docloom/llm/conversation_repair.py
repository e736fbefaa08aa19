"""Conversation structure repair by error-correcting Earley parsing.

A grammar over role initials says what a conversation may be. An item of the chart is a production with a dot and an origin; it keeps the minimum
of (cost, audit), where the audit spells the edits so far. A terminal before the dot of an item may be met by a kept row of that initial, by a row
that is given its role, or by nothing (an insert); rows may be deleted before it. The grammar is left-recursive, so every item begins at the
start and a column of the chart holds a bounded number of items, however long the conversation is.

Rows go to their conversation's task and are sorted within it, so a task streams through its conversations. Edits that all items of the last
column share are settled and leave memory, and items that cost more than the grammar's `slack` above an accepting one are dropped, since that one
can be continued as they can for no more. What is held of a conversation is thus a window of rows; only the audit, which the result holds as one
string, and the digest's state go through the whole. A conversation is parsed from its first row to its last in one task: edits depend on all
rows before them. Repeats of a row are marked by a window over digests before that, so no set of seen texts grows.

Defined cases: rows of one turn are ordered by role, then text, by code points; a null conv_id is a conversation of its own; a null turn comes
first and a null role or text is one space; a role of another initial must be given another role or be deleted; repeated rows after the first are
duplicates; ties between edits fall to the least audit; an empty table gives no rows; very long texts stay whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import parts, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"


@dataclass(frozen=True)
class Grammar:
    """Productions by nonterminal (what isn't a nonterminal is a role initial); `roles` are those that rows may be given or that may be inserted.
    An item that costs over `slack` more than an accepting one can't win (None: unknown, nothing is dropped)."""

    start: str
    productions: dict[str, tuple[tuple[str, ...], ...]]
    roles: dict[str, str]
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    cut_off: int = 3
    slack: int | None = None
    rules: list = field(init=False, hash=False, compare=False)
    by_head: dict = field(init=False, hash=False, compare=False)

    def __post_init__(self):
        rules = [("", (self.start,)), *((a, body) for a, bodies in self.productions.items() for body in bodies)]
        object.__setattr__(self, "rules", rules)
        object.__setattr__(self, "by_head", {a: [i for i, r in enumerate(rules) if r[0] == a] for a in self.productions})


#: (s?(ua)+)? over role initials. Whatever may follow an item may follow an accepting one too, at the price of deleting a kept opening `s` (4) or
#: of an inserted `u` before an awaited `a` (3).
CONVERSATION = Grammar(
    start="conversation",
    productions={"conversation": ((), ("turns",)), "turns": (("opening", "u", "a"), ("turns", "u", "a")), "opening": ((), ("s",))},
    roles={"u": "user", "a": "assistant"},
    slack=4,
)


class Edits:
    """The edits so far, as a chain from the last one back; chains share what they have in common."""

    __slots__ = ("before", "edit", "role", "n")

    def __init__(self, before: Edits | None, edit: str, role: str | None):
        self.before, self.edit, self.role, self.n = before, edit, role, (before.n if before else 0) + 1

    def since(self, root: Edits | None) -> list[Edits]:
        out, x = [], self
        while x is not None and x is not root:
            out.append(x)
            x = x.before
        return out[::-1]


def _joined(a: Edits | None, b: Edits | None) -> Edits | None:
    if a is None or b is None:
        return b if a is None else a
    for x in b.since(None):
        a = Edits(a, x.edit, x.role)
    return a


def _meeting(a: Edits | None, b: Edits | None) -> tuple[Edits | None, list[str], list[str]]:
    """The last edit that both chains share, and the edits of either behind it."""
    x, y = [], []
    while a is not b:
        if b is None or (a is not None and a.n >= b.n):
            x.append(a.edit)
            a = a.before
        else:
            y.append(b.edit)
            b = b.before
    return a, x[::-1], y[::-1]


def _better(cost: int, edits: Edits | None, than: tuple[int, Edits | None]) -> bool:
    if cost != than[0]:
        return cost < than[0]
    if edits is than[1]:
        return False
    _, x, y = _meeting(edits, than[1])
    return x < y


class Chart:
    """Earley's chart of one conversation, column by column. take() reads a row and returns the edits that are settled; done() the rest."""

    def __init__(self, grammar: Grammar, settle_every: int = 64):
        self.g, self.settle_every, self.read = grammar, settle_every, 0
        self.columns: dict[int, dict] = {}
        self.at, self.root = 0, None
        self.columns[0] = self._closed({(0, 0, 0): (0, None)})

    def _closed(self, items: dict) -> dict:
        """All items of the present column, from those that a row led to: predicted, completed and inserted ones, each at its best."""
        g, now = self.g, self.at
        self.columns[now] = column = {}
        waiting: dict[str, list] = {}  # items of this column before a nonterminal
        agenda = []

        def put(item, cost, edits):
            held = column.get(item)
            if held is None or _better(cost, edits, held):
                column[item] = (cost, edits)
                agenda.append(item)
                if held is None:
                    rule, dot, _ = item
                    body = g.rules[rule][1]
                    if dot < len(body) and body[dot] in g.by_head:
                        waiting.setdefault(body[dot], []).append(item)

        for item, (cost, edits) in items.items():
            put(item, cost, edits)
        while agenda:
            item = agenda.pop()
            cost, edits = column[item]
            rule, dot, origin = item
            head, body = g.rules[rule]
            if dot == len(body):
                if rule:
                    parents = waiting.get(head, []) if origin == now else [i for i in self.columns[origin] if self._next(i) == head]
                    for p in list(parents):
                        p_cost, p_edits = self.columns[origin][p]
                        put((p[0], p[1] + 1, p[2]), p_cost + cost, _joined(p_edits, edits))
                continue
            symbol = body[dot]
            if symbol in g.by_head:
                for r in g.by_head[symbol]:
                    put((r, 0, now), 0, None)
                    whole = (r, len(g.rules[r][1]), now)
                    if whole in column:
                        put((rule, dot + 1, origin), cost + column[whole][0], _joined(edits, column[whole][1]))
            elif symbol in g.roles:
                put((rule, dot + 1, origin), cost + g.insert, Edits(edits, INSERT, g.roles[symbol]))
        return column

    def _next(self, item) -> str | None:
        body = self.g.rules[item[0]][1]
        return body[item[1]] if item[1] < len(body) else None

    def take(self, initial: str, must_delete: bool, cut_off: bool) -> list[Edits]:
        """The next row, by its role's initial; a row that is cut off costs more where it stays."""
        g, items = self.g, {}

        def put(item, cost, edits):
            held = items.get(item)
            if held is None or _better(cost, edits, held):
                items[item] = (cost, edits)

        stay = g.cut_off if cut_off else 0
        for item, (cost, edits) in self.columns[self.at].items():
            symbol = self._next(item)
            if item == (0, 1, 0):  # behind the end only deleted rows may follow
                put(item, cost + g.delete, Edits(edits, DELETE, None))
            elif symbol is not None and symbol not in g.by_head:
                put(item, cost + g.delete, Edits(edits, DELETE, None))
                if not must_delete:
                    after = (item[0], item[1] + 1, item[2])
                    if symbol == initial:
                        put(after, cost + stay, Edits(edits, KEEP, None))
                    elif symbol in g.roles:
                        put(after, cost + g.rerole + stay, Edits(edits, REROLE, g.roles[symbol]))
        self.read += 1
        self.at += 1
        column = self._closed(items)
        if g.slack is not None and (0, 1, 0) in column:
            most = column[(0, 1, 0)][0] + g.slack
            column = self.columns[self.at] = {i: v for i, v in column.items() if v[0] <= most or i[2] == self.at}
        origins = {i[2] for i in column} | {0, self.at}
        for c in [c for c in self.columns if c not in origins]:
            del self.columns[c]
        return self._settled() if self.read % self.settle_every == 0 else []

    def _settled(self) -> list[Edits]:
        """Edits that every item shares, where all begin at the start: they can't change any more."""
        column = self.columns[self.at]
        alive = [v[1] for i, v in column.items() if i[2] != self.at]
        begun = any(v[1] is not None for i, v in self.columns[0].items() if self._next(i) in self.g.by_head)
        if begun or any(0 < i[2] < self.at for i in column) or not alive or any(x is None for x in alive):
            return []
        shared = alive[0]
        for x in alive[1:]:
            shared = _meeting(shared, x)[0]
        if shared is None or shared is self.root:
            return []
        out, self.root = shared.since(self.root), shared
        shared.before = None  # what is settled leaves memory
        return out

    def done(self) -> tuple[int, list[Edits]]:
        cost, edits = self.columns[self.at][(0, 1, 0)]
        return cost, edits.since(self.root) if edits else []


def repaired(rows, grammar: Grammar, remember: dict | None = None) -> Iterator[tuple[str, str, str, int]]:
    """Edits of one conversation: (edit, role, text, -1), at the end ("", "", "", cost). Rows are (role, text, must be deleted, cut off). Short conversations whose rows are alike in all that counts are parsed once, if a dict to remember them in is given."""
    rows, head = iter(rows), []
    for row in rows:
        head.append(row)
        if len(head) > 32:
            break
    key = tuple((r[0][:1], r[2], r[3]) for r in head)
    if len(head) <= 32 and remember is not None and key in remember:
        cost, edits = remember[key]
        yield from _applied(edits, iter(head))
    elif len(head) <= 32:
        chart = Chart(grammar)
        settled = [e for k in key for e in chart.take(*k)]
        cost, rest = chart.done()
        edits = [(e.edit, e.role) for e in settled + rest]
        if remember is not None and len(remember) < 100_000:
            remember[key] = cost, edits
        yield from _applied(edits, iter(head))
    else:
        chart, pending = Chart(grammar), []
        for source in (head, rows):
            for r in source:
                pending.append(r)
                settled = chart.take(r[0][:1], r[2], r[3])
                if settled:
                    used = sum(e.edit != INSERT for e in settled)
                    yield from _applied([(e.edit, e.role) for e in settled], iter(pending[:used]))
                    del pending[:used]
        cost, rest = chart.done()
        yield from _applied([(e.edit, e.role) for e in rest], iter(pending))
    yield "", "", "", cost


def _applied(edits, rows) -> Iterator[tuple[str, str, str, int]]:
    for edit, role in edits:
        if edit == INSERT:
            yield edit, role, "", -1
        else:
            r = next(rows)
            yield edit, r[0] if role is None else role, r[1], -1


BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def faults(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", apart: str | None = None) -> DataFrame:
    """df, its null roles and texts as a space, and fault: the row's first of BLANK, DUPLICATE, TRUNCATED, else 0. Rows are repeats of those with the
    same `apart` only."""
    rows = df.withColumns({role: F.coalesce(role, F.lit(" ")), text: F.coalesce(text, F.lit(" "))})
    ink = F.rtrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    same = [conv, role, F.sha2(F.col(text).cast("binary"), 256), *([apart] if apart else [])]
    earlier = F.row_number().over(Window.partitionBy(*same).orderBy(F.col(turn).asc_nulls_first()))
    return rows.withColumn("fault", F.when(F.length(ink) == 0, BLANK).when(earlier > 1, DUPLICATE).when(~F.substring(ink, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0))


def _in_order(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A conversation's rows in one partition, by turn; equal turns by role and text, repeats last."""
    return df.repartition(parts(df.sparkSession), conv).sortWithinPartitions(F.col(conv).asc_nulls_first(), F.col(turn).asc_nulls_first(), role, text, F.col("fault") == DUPLICATE)


class _Stream:
    """The rows of sorted batches, cut into conversations."""

    def __init__(self, batches, names):
        self.rows = self._all(batches, names)
        self.ahead = next(self.rows, None)

    @staticmethod
    def _all(batches, names):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)

    def conversations(self):
        while self.ahead is not None:
            conv = self.ahead[0]
            rows = self._of(conv)
            yield conv, rows
            for _ in rows:
                pass

    def _of(self, conv):
        while self.ahead is not None and self.ahead[0] == conv:
            row, self.ahead = self.ahead, None
            self.ahead = next(self.rows, None)
            yield row


def repair(df: DataFrame, grammar: Grammar = CONVERSATION, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations, a row for each edit: conv_id, at (from 0), edit, role, text; deleted rows are there too, marked D."""
    schema = T.StructType([T.StructField(conv, df.schema[conv].dataType), T.StructField("at", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("edit", "role", "text"))])

    def run(batches):
        remember: dict = {}
        out = []
        for conv_id, rows in _Stream(batches, (conv, turn, role, text, "fault")).conversations():
            given = ((r[2], r[3], r[4] in (BLANK, DUPLICATE), r[4] == TRUNCATED) for r in rows)
            for at, (edit, new_role, words, cost) in enumerate(repaired(given, grammar, remember)):
                if cost < 0:
                    out.append((conv_id, at, edit, new_role, words))
                if len(out) >= 1024:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return _in_order(faults(df.select(conv, turn, role, text), conv, turn, role, text), conv, turn, role, text).mapInArrow(run, schema)


def _batch(rows, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def reported(df: DataFrame, grammar: Grammar = CONVERSATION, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """A row for each conversation: its gaps and faults, the cost and audit of its repair, and the digest of the repaired rows. Rows for which
    `gone` is true only name their conversation."""
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([T.StructField(conv, df.schema[conv].dataType), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    rows = df.select(conv, turn, role, text, (F.col(gone) if gone else F.lit(False)).alias("__gone"))
    held = faults(rows, conv, turn, role, text, apart="__gone")
    legal = {("s", "u"), ("u", "a"), ("a", "u")}

    def run(batches):
        remember: dict = {}
        out = []
        for conv_id, given in _Stream(batches, (conv, turn, role, text, "fault", "__gone")).conversations():
            count = [0, 0, 0, 0]
            seen = {"illegal": 0, "last": None, "low": None, "high": None, "turns": 0}

            def watched(given=given, count=count, seen=seen):
                for r in given:
                    if r[5]:
                        continue
                    count[r[4]] += 1
                    first = r[2][:1]
                    if seen["last"] is not None and (seen["last"], first) not in legal:
                        seen["illegal"] += 1
                    seen["last"] = first
                    if r[1] is not None and r[1] != seen["high"]:
                        seen["low"] = r[1] if seen["low"] is None else seen["low"]
                        seen["high"] = r[1]
                        seen["turns"] += 1
                    yield r[2], r[3], r[4] in (BLANK, DUPLICATE), r[4] == TRUNCATED

            digest, audit, lines, total = hashlib.sha256(), [], 0, 0
            for edit, new_role, words, cost in repaired(watched(), grammar, remember):
                if cost >= 0:
                    total = cost
                    continue
                audit.append(edit)
                if edit != DELETE:
                    digest.update(("\n" if lines else "").encode() + f"{new_role}:{words}".encode())
                    lines += 1
            gaps = 0 if seen["low"] is None else min(seen["high"] - seen["low"] + 1 - seen["turns"], (1 << 63) - 1)
            out.append((conv_id, gaps, *count[1:], seen["illegal"], total, "".join(audit), digest.hexdigest()))
            if len(out) >= 1024:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return _in_order(held, conv, turn, role, text).mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """The contract's damage, by crc32(conv_id:turn) % 20; dropped rows stay as `gone`, without their text."""
    spot = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(spot.cast("binary")) % 20
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(damaged(table(spark, sf_dir, "conversations")), gone="gone")

"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is to read `(s?(ua)+)?` in the initials of its roles.  Rows may be
kept (cost 0), given the role user or assistant (2) or deleted (3, the only way
for blank and repeated rows); a row without text may be put in anywhere (2); a row
cut off in mid-sentence costs 1 unless it is deleted.  The repair wanted is the
cheapest, and among those the one whose audit, the initials of its edits in
order, comes first in ASCII.

The grammar is an automaton of four states, so the cost of a stretch of rows is
known from four numbers.  A forward pass gives, for each state, the least cost of
reaching it at the middle row and the place of its audit among the four; a
backward pass gives the least cost from there to the end.  The cheapest crossing
with the first audit is fixed, and both halves are solved the same way.  Rows put
in stand before a row, so audits that lead to different states at a row never are
prefixes of each other, and their order at the crossing is the order of the whole.
Memory is one byte a row for what the passes read, and the audit.

Rows travel once: one exchange by conversation, sorted there by turn.  A task
reads its conversations as a stream; texts of a conversation wait for the repair
in a temporary file that leaves memory beyond `HELD` bytes and is gone afterwards,
so a conversation with a large share of all rows is neither collected nor cut.
It is still one row of the result, whose audit and digest only one task can write.
Rows equal to an earlier one are found by a running number within their
conversation, role and text, which that same exchange serves.

Defined results: a null role or text is one blank, a null turn sorts first and is
left out of the gaps, a null conv_id is a conversation of its own; rows of one turn
stand in the order of role, digest of text; repeated rows are duplicates; an empty
role adds no initial and can be kept anywhere; an empty table gives an empty
result.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellvote.llm.common import SPACES

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1  # costs
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
# The role that may be put in from each state, and the state it leads to.
NEXT_ROLE = ["user", "user", "assistant", "user"]
NEXT_STATE = [AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER]
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
HELD = 32 << 20

# What the passes need of a row: where each state goes when the row is kept, and its faults.
OTHER, SYSTEM, USER, ASSISTANT, NO_INITIAL = range(5)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT, "": NO_INITIAL}
KEPT_TO = {
    SYSTEM: {START: AFTER_SYSTEM},
    USER: {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_ASSISTANT: AFTER_USER},
    ASSISTANT: {AFTER_USER: AFTER_ASSISTANT},
    NO_INITIAL: {state: state for state in range(4)},
    OTHER: {},
}
TRUNCATED, MUST_GO = 8, 16


def _row_steps(code: int) -> list[list[tuple[int, str, int]]]:
    """For each state before a row: (cost, letters, state after), rows put in before it included."""
    cut = CUT_OFF if code & TRUNCATED else 0
    own = []
    for state in range(4):
        steps = [(DELETE, "D", state)]
        if not code & MUST_GO:
            to = KEPT_TO[code & 7].get(state)
            if to is not None:
                steps.append((KEEP + cut, "K", to))
            steps.append((REROLE + cut, "R", NEXT_STATE[state]))
        own.append(steps)
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        at = state
        for put_in in range(3):  # a third one could only undo the second
            for cost, letter, to in own[at]:
                option = (INSERT * put_in + cost, "I" * put_in + letter)
                if to not in best or option < best[to]:
                    best[to] = option
            at = NEXT_STATE[at]
        out.append([(cost, letters, to) for to, (cost, letters) in sorted(best.items())])
    return out


STEPS = {code: _row_steps(code) for code in range(32) if code & 7 <= NO_INITIAL}
# Cost and letters from a state after the last row to a complete conversation.
CLOSING = {START: (0, ""), AFTER_SYSTEM: (2 * INSERT, "II"), AFTER_USER: (INSERT, "I"), AFTER_ASSISTANT: (0, "")}


def forward(codes: np.ndarray, state: int) -> tuple[list[int], list[int]]:
    """Least cost of each state after the rows, and the place of its audit among the reached ones."""
    costs, places = [NEVER] * 4, [0] * 4
    costs[state] = 0
    for code in codes.tolist():
        steps = STEPS[code]
        best: list[tuple | None] = [None] * 4
        for before in range(4):
            if costs[before] < NEVER:
                for cost, letters, to in steps[before]:
                    option = (costs[before] + cost, places[before], letters)
                    if best[to] is None or option < best[to]:
                        best[to] = option
        costs = [NEVER if b is None else b[0] for b in best]
        order = sorted({b[1:] for b in best if b is not None})
        places = [0 if b is None else order.index(b[1:]) for b in best]
    return costs, places


def backward(codes: np.ndarray, last: list[int]) -> list[int]:
    """Least cost from each state before the rows, given that of each state after them."""
    for code in codes[::-1].tolist():
        last = [min(cost + last[to] for cost, _, to in steps) for steps in STEPS[code]]
    return last


def crossing(codes: np.ndarray, state: int, last: list[int]) -> tuple[int, int]:
    """The state at the middle of the rows on the repair sought, and the cost of the whole."""
    middle = (len(codes) + 1) // 2
    costs, places = forward(codes[:middle], state)
    rest = backward(codes[middle:], last)
    cost, _, at = min((costs[s] + rest[s], places[s], s) for s in range(4))
    return at, cost


def repair(codes: np.ndarray) -> tuple[int, list[str]]:
    """Cost, and the letters of each row with those put in before it; the last entry closes."""
    last = [CLOSING[s][0] for s in range(4)]
    letters = [""] * (len(codes) + 1)
    costs, places = forward(codes, START) if len(codes) else ([0, NEVER, NEVER, NEVER], [0] * 4)
    cost, _, end = min((costs[s] + last[s], places[s], s) for s in range(4))
    letters[-1] = CLOSING[end][1]
    open_ = [(0, len(codes), START, end)] if len(codes) else []
    while open_:
        low, high, start, end = open_.pop()
        if high - low == 1:
            letters[low] = next(letters_ for _, letters_, to in STEPS[int(codes[low])][start] if to == end)
            continue
        target = [0 if s == end else NEVER for s in range(4)]
        at, _ = crossing(codes[low:high], start, target)
        middle = low + (high - low + 1) // 2
        open_ += [(low, middle, start, at), (middle, high, at, end)]
    return cost, letters


def repaired_turns(letters: Iterable[str], turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation; one more entry of letters than turns."""
    state, turns = START, iter(turns)
    for group in letters:
        for letter in group:
            if letter == "I":
                yield NEXT_ROLE[state], ""
                state = NEXT_STATE[state]
                continue
            role, text = next(turns)
            if letter == "K":
                state = KEPT_TO[INITIALS.get(role[:1], OTHER)][state]
                yield role, text
            elif letter == "R":
                yield NEXT_ROLE[state], text
                state = NEXT_STATE[state]


class _Held:
    """Roles and texts of one conversation, on disk beyond HELD bytes."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=HELD)

    def add(self, role: str, text: str) -> None:
        for value in (role.encode(), text.encode()):
            self.file.write(len(value).to_bytes(8, "little"))
            self.file.write(value)

    def __iter__(self) -> Iterator[tuple[str, str]]:
        self.file.seek(0)
        while size := self.file.read(8):
            role = self.file.read(int.from_bytes(size, "little")).decode()
            yield role, self.file.read(int.from_bytes(self.file.read(8), "little")).decode()


class _Conversation:
    """What is known of one conversation while its rows go by in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes, self.held = bytearray(), _Held()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.initial = 0, None
        self.first = self.turn = None
        self.turns = 0

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.turn
            self.turn = turn
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.initial = initial
        if fault:
            self.counts[fault] += 1
        code = INITIALS.get(initial, OTHER)
        self.codes.append(code | (TRUNCATED if fault == "truncated" else MUST_GO if fault else 0))
        self.held.add(role, text)

    def result(self) -> dict:
        cost, letters = repair(np.frombuffer(bytes(self.codes), np.uint8))
        digest, join = hashlib.sha256(), b""
        for role, text in repaired_turns(letters, self.held):
            digest.update(join + f"{role}:{text}".encode())
            join = b"\n"
        self.held.file.close()
        return {
            "conv_id": self.conv_id,
            "gaps": 0 if self.first is None else self.turn - self.first + 1 - self.turns,
            **self.counts,
            "illegal": self.illegal,
            "cost": cost,
            "audit": "".join(letters),
            "repaired_sha256": digest.hexdigest(),
        }


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: each row of a conversation with what a digest of its place does to it.

    Of crc32(conv_id:turn) mod 20, 0 drops the row (gone; it stays to name its
    conversation), 1 empties its text, 2 takes out its sentence ends, 3 repeats
    it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    place = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)
    )
    named = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (F.crc32(place) % 20).alias("kind"),
    )
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return named.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 0, "").otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def faults(copy_number: Column) -> Column:
    """Name of a row's first fault, null for none.  copy_number: 1 for the first of its role and text."""
    seen = F.rtrim(F.col("text"), F.lit(SPACES))
    cut_off = ~F.substring(seen, -1, 1).isin(".", "!", "?")
    return F.when(seen == "", "blank").when(copy_number > 1, "duplicate").when(cut_off, "truncated")


def result_schema(rows: DataFrame) -> T.StructType:
    longs = [T.StructField(name, T.LongType()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [T.StructField(name, T.StringType()) for name in ("audit", "repaired_sha256")]
    return T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *longs, *texts])


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its repair, digest of the repaired turns.

    rows: conv_id, turn, role, text, and optionally `gone` for rows that only name
    their conversation.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    text_key = F.sha2("text", 256).alias("text_key")
    named = rows.select("conv_id", "turn", "role", "text", gone.alias("gone"), text_key).repartition("conv_id")
    alike = Window.partitionBy("conv_id", "gone", "role", "text_key").orderBy("turn")
    marked = named.withColumn("fault", faults(F.row_number().over(alike)))
    # a null turn stands first here as in the window, and equal rows stand in the order of their numbers
    ordered = marked.sortWithinPartitions("conv_id", "turn", "role", "text_key", F.col("fault") == "duplicate")
    schema = result_schema(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, turn, role, text, gone_, fault in zip(*(column.to_pylist() for column in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                if not gone_:
                    now.add(turn, role, text, fault)
            if done:
                yield result_batch(done)
                done = []
        if now is not None:
            yield result_batch([now.result()])

    id_type = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(schema["conv_id"].dataType, pa.string())

    def result_batch(results: list[dict]) -> pa.RecordBatch:
        columns = {f: [r[f] for r in results] for f in schema.names}
        types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(columns[f], t) for f, t in zip(schema.names, types)], schema.names)

    return ordered.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(work, schema)


ORACLE_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS place
  FROM conversations),
coded AS (
  SELECT *, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(place)),
    lambda i: CAST('0x' || substr(hex(place), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM named),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM (SELECT *, xor(crc, 4294967295) % 20 AS kind FROM coded) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS rn,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen
  FROM damaged),
faulty AS (
  SELECT *, CASE WHEN seen = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
                 WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS before
  FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
-- the best end of a conversation from each of the states 1 start, 2 after s, 3 after u, 4 after a: cost, audit, turns
ends AS (
  SELECT conv_id, n AS rn,
         [{'c': 0, 'e': '', 't': CAST([] AS VARCHAR[])}, {'c': 4, 'e': 'II', 't': ['user:', 'assistant:']},
          {'c': 2, 'e': 'I', 't': ['assistant:']}, {'c': 0, 'e': '', 't': CAST([] AS VARCHAR[])}] AS best
  FROM counted
  UNION ALL
  SELECT conv_id, rn - 1, list_transform([1, 2, 3, 4], lambda p: list_sort([
      own[p],
      {'c': own[nxt[p]].c + 2, 'e': 'I' || own[nxt[p]].e, 't': list_prepend(ins[p], own[nxt[p]].t)},
      {'c': own[nxt[nxt[p]]].c + 4, 'e': 'II' || own[nxt[nxt[p]]].e,
       't': list_prepend(ins[p], list_prepend(ins[nxt[p]], own[nxt[nxt[p]]].t))}])[1])
  FROM (
    SELECT e.conv_id, e.rn, [3, 3, 4, 3] AS nxt, ['user:', 'user:', 'assistant:', 'user:'] AS ins,
      list_transform([1, 2, 3, 4], lambda p: list_sort(list_filter([
        {'c': e.best[p].c + 3, 'e': 'D' || e.best[p].e, 't': e.best[p].t},
        CASE WHEN f.fault NOT IN ('blank', 'duplicate') THEN
          {'c': e.best[[3, 3, 4, 3][p]].c + 2 + CAST(f.fault = 'truncated' AS INTEGER),
           'e': 'R' || e.best[[3, 3, 4, 3][p]].e,
           't': list_prepend(['user:', 'user:', 'assistant:', 'user:'][p] || f.text, e.best[[3, 3, 4, 3][p]].t)} END,
        CASE WHEN f.fault NOT IN ('blank', 'duplicate')
              AND (i = '' OR (i = 's' AND p = 1) OR (i = 'u' AND p <> 3) OR (i = 'a' AND p = 3)) THEN
          {'c': e.best[CASE i WHEN '' THEN p WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c
                + CAST(f.fault = 'truncated' AS INTEGER),
           'e': 'K' || e.best[CASE i WHEN '' THEN p WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].e,
           't': list_prepend(f.role || ':' || f.text,
                             e.best[CASE i WHEN '' THEN p WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].t)} END],
        lambda x: x IS NOT NULL))[1]) AS own
    FROM ends e JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.rn = e.rn)),
solved AS (SELECT conv_id, best[1] AS b FROM ends WHERE rn = 0)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       CAST(coalesce(s.b.c, 0) AS BIGINT) AS cost, coalesce(s.b.e, '') AS audit,
       sha256(coalesce(array_to_string(s.b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""

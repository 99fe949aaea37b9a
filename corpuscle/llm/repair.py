"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``, and an audit of them.

A conversation is a layered graph: nodes are (rows consumed, state), the state being what the repaired turns end in;
arcs keep, rerole, delete or insert a row and cost 0 to 6. Dial's bucket queue, as few buckets as the largest
cost has units, settles the distances to the end, backwards. The walk from the start then takes the arc of the
least letter among the tight ones, which spells the least audit of all cheapest ones.

Rows are shuffled by conversation and stream, sorted, through the tasks. Of a conversation a task holds one code and one
digest a row, and its texts up to HOLD bytes; a larger conversation's repaired text is hashed or emitted in a second pass,
in which its audit comes before its rows and no text is held. The audit itself has a letter a row, in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.session import ship

from .common import written

#: Repaired turns end in: nothing yet, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row that may follow.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (NOTHING, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Bytes of text that a task holds of one conversation.
HOLD = 16 << 20
BLANKS = " \t\n\x0b\x0c\r"


def _row_arcs(initial: str, truncated: bool, gone: bool) -> list[list[tuple[str, int, int]]]:
    """By state: ``(letter, cost, next state)`` of what may be done to a row, letters ascending."""
    more, out = TRUNCATED * truncated, []
    for state in range(4):
        arcs = [("D", DELETE, state)]
        if not gone:
            if initial == "s" and state == NOTHING:
                arcs.append(("K", KEEP + more, SYSTEM))
            elif initial == {USER: "u", ASSISTANT: "a"}[NEXT[state]]:
                arcs.append(("K", KEEP + more, NEXT[state]))
            arcs.append(("R", REROLE + more, NEXT[state]))
        out.append(arcs)
    return out


#: A row's code: its role's initial (x: another), upper case if its end is missing, d if it must go.
ARCS = {c.upper() if cut else c: _row_arcs(c, cut, False) for c in "suax" for cut in (False, True)} | {"d": _row_arcs("x", False, True)}
BACK = {code: [[(s, cost) for s in range(4) for _, cost, t in arcs[s] if t == state] for state in range(4)] for code, arcs in ARCS.items()}
BACK_INSERT = [[s for s in range(4) if NEXT[s] == state] for state in range(4)]
MOST = max(cost for arcs in ARCS.values() for own in arcs for _, cost, _ in own)


def distances(codes: str) -> list[int]:
    """The cost from each node ``4 * rows + state`` to the end, by Dial's queue; -1 where it exceeds the start's."""
    n, far = len(codes), -1
    settled, best = [far] * (4 * (n + 1)), [1 << 60] * (4 * (n + 1))
    buckets: list[list[int]] = [[] for _ in range(MOST + 1)]
    for end in ENDS:
        best[4 * n + end] = 0
        buckets[0].append(4 * n + end)
    now, waiting = 0, len(ENDS)
    while waiting and settled[NOTHING] == far:
        bucket = buckets[now % (MOST + 1)]
        while bucket:  # arcs of cost 0 fill the bucket that is being emptied
            node = bucket.pop()
            waiting -= 1
            if settled[node] != far or best[node] != now:
                continue
            settled[node] = now
            row, state = divmod(node, 4)
            before = [(4 * row + s, INSERT) for s in BACK_INSERT[state]]
            if row:
                before += [(4 * row - 4 + s, cost) for s, cost in BACK[codes[row - 1]][state]]
            for other, cost in before:
                if now + cost < best[other]:
                    best[other] = now + cost
                    buckets[(now + cost) % (MOST + 1)].append(other)
                    waiting += 1
        now += 1
    return settled


def repair_audit(codes: str) -> tuple[int, str]:
    """The least cost and, of the cheapest edits, the audit that is least in ASCII order."""
    left = distances(codes)
    row, state, letters = 0, NOTHING, []
    while left[4 * row + state]:
        here = left[4 * row + state]
        arcs = ARCS[codes[row]][state] if row < len(codes) else []
        options = [(letter, cost, row + 1, s) for letter, cost, s in arcs] + [("I", INSERT, row, NEXT[state])]
        letter, row, state = min((letter, r, s) for letter, cost, r, s in options if left[4 * r + s] >= 0 and left[4 * r + s] + cost == here)
        letters.append(letter)
    while row < len(codes):  # nothing but keeping costs nothing
        letters.append("K")
        row += 1
    return left[NOTHING], "".join(letters)


class Replay:
    """Repaired rows, in order, of an audit and the rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def inserted(self) -> Iterator[tuple[str, str]]:
        """What is inserted before the next row, or at the end."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        self.state = SYSTEM if letter == "K" and role[:1] == "s" else NEXT[self.state]
        yield (role if letter == "K" else NAMES[self.state]), text


class Lines:
    """The digest of ``role:text`` lines joined by line feeds."""

    def __init__(self):
        self.digest, self.any = hashlib.sha256(), False

    def add(self, lines: Iterator[tuple[str, str]]) -> None:
        for role, text in lines:
            self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True


class _Open:
    """What is held of the conversation whose rows are coming."""

    def __init__(self, conv):
        self.conv, self.codes, self.initials, self.seen, self.turns = conv, [], [], set(), []
        self.counts, self.rows, self.size, self.n_turns = {"blank": 0, "duplicate": 0, "truncated": 0}, [], 0, 0

    def add(self, turn, role, text, said, fault) -> None:
        if turn is not None:
            self.n_turns += not self.turns or self.turns[-1] != turn
            self.turns = [self.turns[0] if self.turns else turn, turn]
        initial = role[:1]
        self.initials.append(initial if initial in ("s", "u", "a") else "x")
        what = fault if fault == "blank" else "duplicate" if said in self.seen else fault
        self.seen.add(said)
        if what:
            self.counts[what] += 1
        self.codes.append("d" if what in ("blank", "duplicate") else self.initials[-1].upper() if what == "truncated" else self.initials[-1])
        self.size += len(role) + len(text)
        if self.rows is not None:
            self.rows.append((role, text))
            if self.size > HOLD:
                self.rows = None

    def row(self) -> dict:
        cost, audit = repair_audit("".join(self.codes))
        sha = None
        if self.rows is not None:
            lines, replay = Lines(), Replay(audit)
            for role, text in self.rows:
                lines.add(replay.row(role, text))
            lines.add(replay.inserted())
            sha = lines.digest.hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))
        gaps = self.turns[1] - self.turns[0] + 1 - self.n_turns if self.turns else 0
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
#: Conversations that are emitted at a time.
OUT = 1_000


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _audits(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None
        for batch in batches:
            for conv, turn, role, text, said, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Open(conv)
                    if len(out) >= OUT:
                        yield _emit(out, schema)
                        out = []
                if fault != "gone":
                    now.add(turn, role, text, said, fault)
        if now is not None:
            out.append(now.row())
        if out:
            yield _emit(out, schema)

    return run


def _replayed(schema: pa.Schema, digest: bool):
    """Of rows after their conversation's audit: a digest a conversation, or the repaired rows with their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, replay, lines, place = [], None, None, None, 0

        def take(made: Iterator[tuple[str, str]]) -> None:
            nonlocal place
            if digest:
                lines.add(made)
                return
            for role, text in made:
                out.append({"conv_id": conv, "turn": place, "role": role, "text": text})
                place += 1

        def end() -> None:
            if replay is not None:
                take(replay.inserted())
                if digest:
                    out.append({"conv_id": conv, "sha": lines.digest.hexdigest()})

        for batch in batches:
            for conv_id, audit, gone, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is not None:
                    end()
                    conv, replay, lines, place = conv_id, Replay(audit), Lines(), 0
                elif not gone:
                    take(replay.row(role, text))
            if out:
                yield _emit(out, schema)
                out = []
        end()
        if out:
            yield _emit(out, schema)

    return run


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with a digest of what is said, and blank, truncated or null as fault."""
    bare = F.rtrim("text", F.lit(BLANKS))
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    fault = F.when(F.col("gone"), "gone").when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", said.alias("said"), fault.alias("fault"))


def _schema(rows: DataFrame, fields: list[tuple[str, pa.DataType]]) -> tuple[pa.Schema, str]:
    """As Arrow's and as Spark's, with the type that conv_id has."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    spark_names = {pa.string(): "string", pa.int64(): "long"}
    told = ", ".join([f"conv_id {kind.simpleString()}", *(f"{n} {spark_names[t]}" for n, t in fields)])
    return pa.schema([("conv_id", to_arrow_type(kind)), *fields]), told


def prepared(conversations: DataFrame) -> DataFrame:
    """The four columns; nulls of role and text become one space; ``gone`` marks rows that only name their conversation."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *texts, F.lit(False).alias("gone"))


def damage(conversations: DataFrame) -> DataFrame:
    """Test faults by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties it, 2 removes ends of sentences, 3 repeats it, 4 makes it the user's.

    Dropped rows stay, ``gone``, so that their conversation is known.
    """
    rows = prepared(conversations)

    def told(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = rows.withColumn("code", code).withColumn("times", F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"))


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _second_pass(rows: DataFrame, audits: DataFrame, digest: bool) -> DataFrame:
    """``rows`` of the conversations that ``audits`` (conv_id, audit) has, replayed as a stream."""
    both = rows.select("conv_id", "turn", F.lit(None).cast("string").alias("audit"), "gone", "role", "text").unionByName(
        audits.select("conv_id", F.lit(None).cast("long").alias("turn"), "audit", F.lit(False).alias("gone"), F.lit("").alias("role"), F.lit("").alias("text"))
    )
    both = both.withColumn("later", F.col("audit").isNull())
    fields = [("sha", pa.string())] if digest else [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    schema, told = _schema(rows, fields)
    return _sorted(both, "later", "turn", "role", "text").select("conv_id", "audit", "gone", "role", "text").mapInArrow(_replayed(schema, digest), told)


def audit(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of ``prepared`` rows."""
    ship(rows.sparkSession)
    schema, told = _schema(rows, [*((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    found = written(_sorted(faults(rows), "turn", "role", "text").mapInArrow(_audits(schema), told), "audits")
    large = found.where("repaired_sha256 is null")
    if large.isEmpty():
        return found
    own = rows.join(large.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    again = _second_pass(own, large, True).withColumnRenamed("conv_id", "c")
    both = large.drop("repaired_sha256").join(again, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumnRenamed("sha", "repaired_sha256")
    return found.where("repaired_sha256 is not null").unionByName(both)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: ``(conv_id, turn, role, text)``, turns numbered from 0; those without rows are gone."""
    rows = prepared(conversations)
    return _second_pass(rows, audit(rows).select("conv_id", "audit"), False)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Every conversation's faults after the test damage, the cheapest repair's cost and audit, a digest of what results.

    Rows are taken by turn, null turns first; rows of one turn by role, then text, so repeated rows are adjacent and all
    but one of them duplicates. Null roles and texts count as one space, in the damage's key null ids and turns, too; a
    null conv_id is one conversation. A role is known by its initial, case-sensitively; any but s, u, a (none included)
    can only be reroled or deleted. Blank and long texts count whole. A conversation without rows after the damage has
    zeros, an empty audit and the digest of nothing. Other columns are left out, whatever their names; an empty table
    gives an empty result.
    """
    return audit(damage(conversations))

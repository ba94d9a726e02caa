"""Conversation structure repair by a persistent audit search.

Rows of a conversation are kept, deleted, given another role, or joined by inserted rows until its roles read system? (user assistant)+ at
the least cost; the audit is the cheapest sequence of edits, the ASCII-least among equals. Rows are ranged over (conversation, turn, ...)
and streamed in order, so a conversation of any size lies in consecutive tasks. A task cuts it into blocks; a block keeps, for each pair of
entry and exit state, the cheapest audit. Its edit prefixes are linked nodes that share their beginnings, with binary-lifting ancestors and
rolling hashes: candidates of one cost are compared at the end of their longest common prefix, found by lifting, and equal hashes are
verified by walking to the common node. Blocks of one conversation are then chained in the same way.

Both prefixes of a comparison have consumed the same rows at the same cost, so neither is a proper prefix of the other (the longer one would
hold more paid insertions), and the least prefix stays least under any common continuation.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from carrierlake.session import cut_lineage

from .common import query
from .tokens import slices

#: Costs of edits, faults, and the shape of a well-formed conversation as states (nothing, after system, user, assistant).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ACCEPTED = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: A block ends after so many rows or bytes of text.
BLOCK_ROWS = 4096
BLOCK_BYTES = 16 << 20

PRIME = (1 << 61) - 1
BASE = 1_000_003


def step(state: int, initial: str) -> int | None:
    """The state after a row of that role initial, None where it may not follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return None


class Audits:
    """Edit prefixes as linked nodes; ``lift[n]`` are the ancestors 1, 2, 4, ... letters back."""

    def __init__(self):
        self.parent, self.letter, self.depth, self.hash, self.lift = [], [], [], [], []

    def root(self) -> int:
        return self._add(-1, "", 0, 0, ())

    def extend(self, node: int, letter: str) -> int:
        lift, j = [node], 0
        while j < len(self.lift[lift[j]]):
            lift.append(self.lift[lift[j]][j])
            j += 1
        return self._add(node, letter, self.depth[node] + 1, (self.hash[node] * BASE + ord(letter)) % PRIME, tuple(lift))

    def _add(self, *values) -> int:
        for to, value in zip((self.parent, self.letter, self.depth, self.hash, self.lift), values):
            to.append(value)
        return len(self.parent) - 1

    def text(self, node: int) -> str:
        letters = []
        while self.parent[node] >= 0:
            letters.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(letters))

    def ancestor(self, node: int, depth: int) -> int:
        back = self.depth[node] - depth
        while back:
            j = back.bit_length() - 1
            node = self.lift[node][j]
            back -= 1 << j
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two prefixes of one length are equal, letter by letter down to the node they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether prefix a comes before prefix b in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if x == y or self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self.same(x, y) else self.text(a) < self.text(b)
        for j in reversed(range(len(self.lift[x]))):
            if j < len(self.lift[x]):
                u, v = self.lift[x][j], self.lift[y][j]
                if self.hash[u] != self.hash[v]:
                    x, y = u, v
        if self.same(self.parent[x], self.parent[y]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)  # two different prefixes had one hash


class Search:
    """Cheapest (cost, node) per state, from one entry state; states that nothing reaches are absent."""

    def __init__(self, audits: Audits, entry: int):
        self.audits = audits
        self.best = {entry: (0, audits.root())}
        self.insert(self.best)

    def offer(self, best: dict, state: int, cost: int, node: int, letter: str) -> None:
        if state in best and best[state][0] < cost:
            return
        made = self.audits.extend(node, letter)
        if state not in best or cost < best[state][0] or self.audits.less(made, best[state][1]):
            best[state] = (cost, made)

    def insert(self, best: dict) -> None:
        """Empty rows may stand anywhere: a user row first, then an assistant row; more would only cost."""
        for state in (START, SYSTEM, ASSISTANT):
            if state in best:
                self.offer(best, USER, best[state][0] + INSERT, best[state][1], "I")
        if USER in best:
            self.offer(best, ASSISTANT, best[USER][0] + INSERT, best[USER][1], "I")

    def row(self, initial: str, forced: bool, truncated: bool) -> None:
        extra = TRUNCATED if truncated else 0
        new: dict = {}
        for state, (cost, node) in self.best.items():
            self.offer(new, state, cost + DELETE, node, "D")
            if forced:
                continue
            after = step(state, initial)
            if after is not None:
                self.offer(new, after, cost + KEEP + extra, node, "K")
            self.offer(new, ASSISTANT if state == USER else USER, cost + REROLE + extra, node, "R")
        self.insert(new)
        self.best = new


def chosen(found: dict, less) -> tuple:
    """(state, cost, prefix): the cheaper accepted state, the ASCII-least audit of equal ones."""
    ends = [(s, *found[s]) for s in ACCEPTED if s in found]
    best = ends[0]
    for end in ends[1:]:
        if end[1] < best[1] or (end[1] == best[1] and less(end[2], best[2])):
            best = end
    return best


class Repaired:
    """Digest of repaired rows, fed in order with the letters of the audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.any = audit, 0, START, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = step(self.state, "a" if self.state == USER else "u")
            self.put(ROLE[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = step(self.state, role[:1])
            self.put(role, text)
        elif letter == "R":
            self.state = step(self.state, "a" if self.state == USER else "u")
            self.put(ROLE[self.state], text)

    def close(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


class Block:
    """Consecutive rows of one conversation: counts, the edges that its neighbours need, and the cheapest audits."""

    def __init__(self, key, part: int, seq: int, entries: tuple[int, ...]):
        self.key, self.part, self.seq, self.entries = key, part, seq, entries
        self.audits = Audits()
        self.searches = {s: Search(self.audits, s) for s in entries}
        self.rows: list[tuple[str, str]] = []
        self.bytes = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        seen = text.rstrip(SPACES)
        blank = not seen
        duplicate = repeated and not blank
        truncated = not blank and not duplicate and seen[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        for search in self.searches.values():
            search.row(initial, blank or duplicate, truncated)
        self.rows.append((role, text))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.bytes >= BLOCK_BYTES

    def closed(self, is_open: bool, whole: bool) -> dict:
        """The block as a row. ``whole``: it begins its conversation in this task and no later block of the task goes on with it."""
        out = {"conv_id": self.key, "part": self.part, "seq": self.seq, "is_open": is_open, "illegal": self.illegal, "first": self.first, "last": self.last}
        out |= {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "low", "high", "turns")}
        out |= {"costs": [None] * STATES**2, "audits": [None] * STATES**2, "cost": None, "audit": None, "repaired_sha256": None}
        if is_open:
            for entry, search in self.searches.items():
                for state, (cost, node) in search.best.items():
                    out["costs"][entry * STATES + state] = cost
                    out["audits"][entry * STATES + state] = self.audits.text(node)
        if whole:
            _, out["cost"], node = chosen(self.searches[START].best, self.audits.less)
            out["audit"] = self.audits.text(node)
            repaired = Repaired(out["audit"])
            for role, text in self.rows:
                repaired.row(role, text)
            out["repaired_sha256"] = repaired.close()
        return out


BLOCK_COLUMNS = "part int, seq int, is_open boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, turns bigint, first string, last string, costs array<bigint>, audits array<string>, cost bigint, audit string, repaired_sha256 string"


def emitted(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def blocks_of(ready: DataFrame, schema: StructType) -> DataFrame:
    """Blocks of rows (conv_id, turn, role, text, times, first_turn) that are sorted within tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        everything = tuple(range(STATES))
        block, before, made, conversations = None, None, [], 0
        for batch in batches:
            for piece in slices(batch):
                for r in zip(*[piece.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "is_first")]):
                    key, turn, role, text, times, is_first = r
                    if block is None or key != block.key:
                        if block is not None:
                            # the first conversation of a task may go on from the task before it
                            lone = block.seq == 0
                            made.append(block.closed(is_open=conversations == 1 or not lone, whole=lone))
                        conversations += 1
                        block, before = Block(key, part, 0, everything if conversations == 1 else (START,)), None
                    for copy in range(times):
                        if block.full():
                            made.append(block.closed(is_open=True, whole=False))
                            block = Block(key, part, block.seq + 1, everything)
                        block.add(turn, role, text, copy > 0 or not is_first or before == (turn, role, text))
                        before = (turn, role, text)
                    if len(made) >= 256:
                        yield emitted(made, arrow)
                        made = []
        if block is not None:
            made.append(block.closed(is_open=True, whole=block.seq == 0))
        if made:
            yield emitted(made, arrow)

    return ready.mapInArrow(stream, schema)


class Chain:
    """Audits over blocks as linked segments; a common beginning is shared, the rest is compared segment by segment."""

    def __init__(self, before: "Chain | None", segment: str):
        self.before, self.segment = before, segment

    def text(self, until: "Chain | None" = None) -> str:
        out, node = [], self
        while node is not until:
            out.append(node.segment)
            node = node.before
        return "".join(reversed(out))


def chain_less(a: Chain, b: Chain) -> bool:
    """Whether a comes before b; both have one segment per block, so they meet in step."""
    x, y = a, b
    while x is not y:
        x, y = x.before, y.before
    return a.text(x) < b.text(x)


def chained(blocks: list[dict]) -> dict:
    """One conversation from its blocks in order."""
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    low = high = last = None
    best: dict = {START: (0, None)}
    for b in blocks:
        for k in total:
            total[k] += b[k]
        if last is not None and b["first"] is not None:
            total["illegal"] += last + b["first"] not in LEGAL
        last = b["last"] if b["last"] is not None else last
        if b["low"] is not None:
            total["turns"] -= b["low"] == high
            low, high = b["low"] if low is None else low, b["high"]
        new: dict = {}
        for entry, (cost, chain) in best.items():
            for state in range(STATES):
                more = b["costs"][entry * STATES + state]
                if more is None or (state in new and new[state][0] < cost + more):
                    continue
                made = Chain(chain, b["audits"][entry * STATES + state])
                if state not in new or cost + more < new[state][0] or chain_less(made, new[state][1]):
                    new[state] = (cost + more, made)
        best = new
    _, cost, chain = chosen(best, chain_less)
    out = total | {"gaps": 0 if low is None else high - low + 1 - total.pop("turns"), "cost": cost, "audit": chain.text()}
    return {"repaired_sha256": blocks[0]["repaired_sha256"] if len(blocks) == 1 else None} | out


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
RESULT_COLUMNS = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'bigint'}" for c in RESULT)


def hashes_of_long(ready: DataFrame, long: DataFrame) -> DataFrame:
    """(conv_id, sha): rows of conversations of several blocks, streamed once more behind their audit. One digest is one sequence of bytes,
    so one task reads each such conversation, row by row.
    """
    rows = ready.join(long.select(F.col("conv_id").alias("_id")), F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi").where("times > 0")
    head = long.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("times"), F.lit(0).alias("kind"))
    both = head.unionByName(rows.select("conv_id", "turn", "role", "text", "times", F.lit(1).alias("kind")))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, repaired = None, None
        for batch in batches:
            for piece in slices(batch):
                for i, (kind, role, text, times) in enumerate(zip(*[piece.column(c).to_pylist() for c in ("kind", "role", "text", "times")])):
                    if kind == 0:
                        if repaired is not None:
                            yield pa.RecordBatch.from_arrays([key, pa.array([repaired.close()])], names=["conv_id", "sha"])
                        key, repaired = piece.column("conv_id").slice(i, 1), Repaired(text)
                    for _ in range(times):
                        repaired.row(role, text)
        if repaired is not None:
            yield pa.RecordBatch.from_arrays([key, pa.array([repaired.close()])], names=["conv_id", "sha"])

    return ordered.mapInArrow(stream, StructType().add(ready.schema["conv_id"]).add("sha", "string"))


def repair_conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and the SHA-256 of its repaired rows.

    Rows are taken by turn (nulls first), rows of one turn by role and text. Null role or text counts as one space. ``times`` says how often a
    row stands (adjacent copies), 0 for a row that is gone; a conversation without rows has zeros, an empty audit and the digest of
    nothing. A null conversation id is one conversation. Repeated rows are duplicates. An empty table gives an empty table; other
    columns are ignored, whatever their names.
    """
    narrow = rows.select(
        F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"), (F.lit(1) if times is None else times).cast("int").alias("times"),
    ).withColumn("digest", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # rows of one content are summed before they meet, so a content that fills a conversation is one row here
    seen = narrow.where("times > 0").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(place).alias("_at"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    marked = narrow.join(seen, same, "left").withColumn("is_first", F.coalesce(F.col("turn").eqNullSafe(F.col("_at.turn")), F.lit(True)))
    ready = cut_lineage(marked.select("conv_id", "turn", "role", "text", "times", "is_first"))
    order = ["conv_id", "turn", "role", "text"]
    schema = StructType([ready.schema["conv_id"], *StructType.fromDDL(BLOCK_COLUMNS).fields])
    blocks = cut_lineage(blocks_of(ready.repartitionByRange(*order).sortWithinPartitions(*order), schema))
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("bigint").alias("gaps")
    done = blocks.where(~F.col("is_open")).select("conv_id", gaps, *RESULT[1:])
    result = StructType([ready.schema["conv_id"], *StructType.fromDDL(RESULT_COLUMNS).fields])

    def combine(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = chained(sorted(table.to_pylist(), key=lambda b: (b["part"], b["seq"])))
        kinds = {c: pa.string() if c in ("audit", "repaired_sha256") else pa.int64() for c in RESULT}
        return pa.table({"conv_id": table.column("conv_id").slice(0, 1)} | {c: pa.array([got[c]], kinds[c]) for c in RESULT})

    # at most two conversations of a task, and those longer than a block
    edges = cut_lineage(blocks.where("is_open").groupBy("conv_id").applyInArrow(combine, result))
    long = edges.where("repaired_sha256 is null")
    digests = hashes_of_long(ready, long).withColumnRenamed("conv_id", "_id")
    ended = edges.join(digests, F.col("conv_id").eqNullSafe(F.col("_id")), "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", "sha"))
    return done.unionByName(ended.select("conv_id", *RESULT))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """(rows, times): faults dealt by a checksum of conversation and turn, for trials of the repair."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(blank("role"))
    out = rows.select("conv_id", "turn", "role", "text").withColumn("_fault", fault).select("conv_id", "turn", role.alias("role"), text.alias("text"), "_fault")
    return out, F.when(F.col("_fault") == 0, 0).when(F.col("_fault") == 3, 2).otherwise(1)


@query("op11_conversations")
def op11(spark, folder):
    rows, times = damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    return repair_conversations(rows, times=times)

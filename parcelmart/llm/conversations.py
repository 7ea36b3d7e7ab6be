"""Repair of the turn structure of conversations at least cost.

A conversation should read ``s?(ua)+`` by the first letters of its roles, or be empty. Each row is kept (K, 0), given the
role user or assistant (R, 1) or deleted (D, 2; blank rows and duplicates must be), and empty turns of user or assistant are put
in anywhere (I, 5); a truncated row that stays adds 5. Four states say what has been read: nothing, the system turn, a user turn,
an assistant turn. Of the cheapest edits the ASCII-least string of letters is the audit.

The edits are found by Hirschberg's divide and conquer: forward costs of the first half and backward costs of the second, four
numbers each, meet in the middle, the best crossing state is fixed, and both halves are solved alike. The forward vector also
ranks the states by their least audit. Inserts belong to the row they precede, so two audits of the same rows are never a prefix
of one another, and the rank alone picks the audit-least of several optimal crossings.

A conversation of any length is cut into blocks of rows. The same halving runs over blocks, each standing as a 4 x 4 table of
costs and ranks, and blocks of blocks, so no task holds more than ``BLOCK_ROWS`` rows or ``FAN_IN`` blocks of one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmart.llm.texts import limit_batches, written

SPACE = "\x20\x09\x0A\x0B\x0C\x0D"
BLOCK_BITS = 14
BLOCK_ROWS = 1 << BLOCK_BITS
FAN_BITS = 10
FAN_IN = 1 << FAN_BITS

KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 1, 2, 5, 5
STATES = range(4)  # nothing, system, user, assistant
NEXT_TURN = (2, 2, 3, 2)  # the state after one more turn of user or assistant
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
NAMES = {2: "user", 3: "assistant"}
ENDINGS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))  # what completes a conversation that stops in a state
LETTERS = "suao"  # o: any other role
#: One letter per row: role by LETTERS, in four runs: sound, truncated, blank, duplicate.
CODES = "suaoSUAO01234567"
FAR = 1 << 40

Step = tuple[tuple[tuple[int, int], ...], ...]  # [from][to] -> (cost, rank of the least audit among the ends)


# --- one row ---------------------------------------------------------------------------------------------


@functools.cache
def row_step(code: str) -> tuple[Step, dict[tuple[int, int], str]]:
    """What a row of this code does: the table of costs and ranks, and the letters of each cheapest way."""
    fault, letter = divmod(CODES.index(code), 4)
    role, table, ways = LETTERS[letter], [], {}
    for start in STATES:
        best: dict[int, tuple[int, str]] = {}
        state = start
        for inserted in range(3):
            turns = [(DELETE, "D", state)]
            if fault < 2:
                more = STAYS_TRUNCATED * fault
                turns.append((REROLE + more, "R", NEXT_TURN[state]))
                if state in KEPT[role]:
                    turns.append((KEEP + more, "K", KEPT[role][state]))
            for cost, edit, end in turns:
                way = (cost + INSERT * inserted, "I" * inserted + edit)
                best[end] = min(best.get(end, way), way)
            state = NEXT_TURN[state]
        order = sorted(best, key=lambda end: best[end][1])
        table.append(tuple((best[e][0], order.index(e)) if e in best else (FAR, 4) for e in STATES))
        ways.update({(start, end): letters for end, (_, letters) in best.items()})
    return tuple(table), ways


# --- vectors of four states ------------------------------------------------------------------------------


def forward(steps: list[Step], lo: int, hi: int, start: int) -> list[tuple[int, int]]:
    """(cost, rank of the least audit) of each state after the steps lo to hi."""
    vector = [(0, 0) if s == start else (FAR, 4) for s in STATES]
    for i in range(lo, hi):
        step, found = steps[i], []
        for end in STATES:
            cost, rank, last = FAR, 4, 4
            for state in STATES:
                before, order = vector[state]
                there, inner = step[state][end]
                if before < FAR and there < FAR and (before + there, order) < (cost, rank):
                    cost, rank, last = before + there, order, inner
            found.append((cost, rank, last))
        order = {key: i for i, key in enumerate(sorted({(r, k) for c, r, k in found if c < FAR}))}
        vector = [(c, order[(r, k)]) if c < FAR else (FAR, 4) for c, r, k in found]
    return vector


def backward(steps: list[Step], lo: int, hi: int, end: int) -> list[int]:
    """Cost from each state before step lo to ``end`` after step hi - 1."""
    vector = [0 if s == end else FAR for s in STATES]
    for i in range(hi - 1, lo - 1, -1):
        step = steps[i]
        vector = [min(min(step[s][t][0] + vector[t] for t in STATES), FAR) for s in STATES]
    return vector


def crossings(steps: list[Step], start: int, end: int) -> list[int]:
    """States before, between and after the steps on the audit-least of the cheapest ways, by halving."""
    states = [start] + [-1] * (len(steps) - 1) + [end] if steps else [start]
    todo = [(0, len(steps))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        middle = (lo + hi) // 2
        ahead, behind = forward(steps, lo, middle, states[lo]), backward(steps, middle, hi, states[hi])
        states[middle] = min(STATES, key=lambda s: (ahead[s][0] + behind[s], ahead[s][1]))
        todo += [(lo, middle), (middle, hi)]
    return states


def summary(steps: list[Step]) -> Step:
    """The steps as one."""
    return tuple(tuple(forward(steps, 0, len(steps), start)) for start in STATES)


def last_state(step: Step) -> int:
    """Where the cheapest conversation stops: state 0 is its start, its ending is put in."""
    return min(STATES, key=lambda s: (step[0][s][0] + ENDINGS[s][0], step[0][s][1]))


def audit_between(codes: str, start: int, end: int) -> str:
    known = [row_step(c) for c in codes]
    states = crossings([step for step, _ in known], start, end)
    return "".join(ways[states[i], states[i + 1]] for i, (_, ways) in enumerate(known))


def _flat(step: Step) -> list[int]:
    return [number for row in step for entry in row for number in entry]


def _step(numbers: list[int]) -> Step:
    pairs = list(zip(numbers[::2], numbers[1::2], strict=True))
    return tuple(tuple(pairs[4 * s:4 * s + 4]) for s in STATES)


# --- the table of conversations --------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Faults planted by crc32(``conv_id:turn``) mod 20: 0 drops the row, 1 empties its text, 2 takes its full stops, 3 repeats
    it, 4 makes its role user. A null counts as one blank in that key, in role and in text."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows with a number ``pos`` that counts on in the order of their conversation, written as a table.

    Order: turn (nulls first), then, among rows of one turn, role, the first 64 characters and a hash of the text. Range partitions
    are cut within a conversation as well, and rows that are the same in everything are told apart by their place in the
    scan, so that no conversation is one task.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.left("text", F.lit(64)), F.xxhash64("text"),
            F.col("place")]
    sorted_rows = rows.select("conv_id", "turn", known("role"), known("text")).withColumn(
        "place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    letter = F.left("role", F.lit(1))
    role = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    return written(sorted_rows.select(
        F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text", F.md5("text").alias("text_hash"),
        role.alias("role_code"),
        F.when(trimmed == "", 2).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0).alias("fault"),
    ), "conversation-rows")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys, a null equal to a null; the keys come from the left side."""
    other = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    met = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(other, met, how).drop(*[f"_{k}" for k in keys])  # a semi-join has none to drop


def block_codes(rows: DataFrame) -> DataFrame:
    """(conv_id, block, codes): one letter per row, at most BLOCK_ROWS rows; texts are not read.

    Repeated texts are counted per conversation, role and text hash, map-side first; only those seen twice are joined back.
    """
    thin = rows.select("pos", "conv_id", "role", "text_hash", "role_code", "fault")
    firsts = thin.where("fault <> 2").groupBy("conv_id", "role", "text_hash").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = written(firsts, "conversation-repeats")
    marked = _same(thin, firsts, ["conv_id", "role", "text_hash"], "left")
    kind = F.when((F.col("fault") != 2) & (F.col("pos") > F.col("first_pos")), 3).otherwise(F.col("fault"))
    code = F.substring(F.lit(CODES), 4 * kind + F.col("role_code") + 1, F.lit(1))
    return marked.select("conv_id", "pos", F.shiftright("pos", BLOCK_BITS).alias("block"), code.alias("code")).groupBy(
        "conv_id", "block").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda r: r["code"]), "").alias("codes"))


def _per_row(df: DataFrame, schema: str, make) -> DataFrame:
    """``make`` turns each row, as a dictionary, into rows; values are remembered by none but ``make`` itself."""
    from pyspark.sql import types as T

    names = [f.name for f in T.StructType.fromDDL(schema).fields] if isinstance(schema, str) else schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            made = [entry for row in batch.to_pylist() for entry in make(row)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[n] for m in made], kind.field(n).type) for n in names], schema=kind)

    return df.mapInArrow(run, schema)


def _schema(df: DataFrame, extra: str):
    from pyspark.sql import types as T

    return T.StructType([df.schema["conv_id"], *T.StructType.fromDDL(extra).fields])


def _gathered(elements: DataFrame) -> DataFrame:
    """Blocks of the next level: up to FAN_IN neighbouring elements of a conversation in one row, in order."""
    up = elements.withColumn("above", F.shiftright("block", FAN_BITS))
    return up.groupBy("conv_id", "above").agg(F.array_sort(F.collect_list(F.struct("block", "numbers"))).alias("children"))


@functools.lru_cache(maxsize=100_000)
def _code_summary(codes: str) -> tuple[int, ...]:
    return tuple(_flat(summary([row_step(c)[0] for c in codes])))


@functools.lru_cache(maxsize=100_000)
def _code_audit(codes: str, start: int, end: int, closing: bool) -> str:
    return audit_between(codes, start, end) + (ENDINGS[end][1] if closing else "")


def audits(codes: DataFrame) -> DataFrame:
    """(conv_id, block, codes, audit): the letters of each block's edits; the last block has the conversation's ending.

    Levels of block tables go up until every conversation is one element, then crossing states come down. Each level
    is written, so a lost executor repeats a level, not the whole.
    """
    codes = written(codes, "conversation-codes")
    blocks = written(_per_row(codes, _schema(codes, "block bigint, numbers array<bigint>"), lambda r: [
        {"conv_id": r["conv_id"], "block": r["block"], "numbers": list(_code_summary(r["codes"]))}]), "conversation-blocks")
    counted = blocks.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("block", "numbers")).alias("only"))
    alone = counted.where("n = 1").select("conv_id", "only.*")
    level = written(_same(blocks, counted.where("n > 1").select("conv_id"), ["conv_id"], "left_semi"), "conversation-level")
    groups = []

    def several(level: DataFrame) -> bool:
        return bool(level.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())

    while several(level):
        group = written(_gathered(level), "conversation-groups")
        groups.append(group)
        level = written(_per_row(group, _schema(level, "block bigint, numbers array<bigint>"), lambda r: [
            {"conv_id": r["conv_id"], "block": r["above"],
             "numbers": _flat(summary([_step(c["numbers"]) for c in r["children"]]))}]), "conversation-level")

    def top(row):
        end = last_state(_step(row["numbers"]))
        return [{"conv_id": row["conv_id"], "block": row["block"], "first": 0, "last": end, "closing": True}]

    def down(row):
        steps = [_step(c["numbers"]) for c in row["children"]]
        states = crossings(steps, row["first"], row["last"])
        return [{"conv_id": row["conv_id"], "block": c["block"], "first": states[i], "last": states[i + 1],
                 "closing": row["closing"] and i == len(steps) - 1} for i, c in enumerate(row["children"])]

    states = _schema(codes, "block bigint, first int, last int, closing boolean")
    solved = _per_row(level, states, top)
    for group in reversed(groups):
        solved = written(solved, "conversation-states")
        named = group.withColumnRenamed("above", "block")
        solved = _per_row(_same(named, solved, ["conv_id", "block"], "inner"), states, down)
    solved = written(solved.unionByName(_per_row(alone, states, top)), "conversation-states")
    return _per_row(_same(codes, solved, ["conv_id", "block"], "inner"), _schema(codes, "block bigint, codes string, audit string"),
                    lambda r: [{"conv_id": r["conv_id"], "block": r["block"], "codes": r["codes"],
                                "audit": _code_audit(r["codes"], r["first"], r["last"], r["closing"])}])


EDITS = "ordinal bigint, edit string, role string, text string, turn bigint, code string"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The edits of every conversation in order: (conv_id, ordinal, edit, role, text, turn, code).

    K and R rows and I rows, read in order, are the repaired conversation; D rows are what it lost. ``code`` is the
    row's letter in CODES (null for an insert), ``turn`` its turn. Rows of a conversation lie together, in order, in one
    partition of the result: they stream through it (Spark sorts them, spilling), none are held.

    Defined cases: a null role or text is one blank, so a null text is blank and a null role neither kept nor sound; null turns
    come first; rows with a null conv_id form one conversation; a row that repeats role and text of an earlier one is a duplicate, be it
    in the same turn or not; other columns are ignored; an empty table gives no rows. Rows of one turn: see ``ordered_rows``.
    """
    limit_batches(rows.sparkSession)
    table = ordered_rows(rows)
    plans = audits(block_codes(table))
    lines = table.select(
        "conv_id", F.shiftright("pos", BLOCK_BITS).alias("block"), "pos", "role", "text", F.col("turn").cast("bigint").alias("turn"),
        F.lit(None).cast("string").alias("codes"), F.lit(None).cast("string").alias("audit"))
    heads = plans.select("conv_id", "block", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), F.lit(None).cast("bigint").alias("turn"), "codes", "audit")
    streams = lines.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
    schema = _schema(rows, EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        nobody = object()
        conv, state, ordinal, letters, codes, left, at = nobody, 0, 0, "", "", 0, 0
        out: list[tuple] = []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(values), kind.field(i).type) for i, values in enumerate(zip(*found, strict=True))], schema=kind)

        def insert() -> None:
            nonlocal state, ordinal, at
            state = NEXT_TURN[state]
            out.append((conv, ordinal, "I", NAMES[state], "", None, None))
            ordinal, at = ordinal + 1, at + 1

        for batch in batches:
            for row in batch.to_pylist():
                if conv is nobody or row["conv_id"] != conv:
                    conv, state, ordinal = row["conv_id"], 0, 0
                if row["audit"] is not None:
                    letters, codes, left, at = row["audit"], row["codes"], 0, 0
                    continue
                while letters[at] == "I":
                    insert()
                edit, role = letters[at], row["role"]
                if edit == "K":
                    state = KEPT[role[:1]][state]
                elif edit == "R":
                    state = NEXT_TURN[state]
                    role = NAMES[state]
                out.append((conv, ordinal, edit, role, row["text"], row["turn"], codes[left]))
                ordinal, at, left = ordinal + 1, at + 1, left + 1
                if left == len(codes):
                    while at < len(letters):
                        insert()
            if out:
                yield batch_of(out)
                out = []

    return streams.mapInArrow(run, schema)


DIGEST = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def repair_digest(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair_conversations``: its faults, its cost, the audit and a hash of the repaired text.

    Reads the edits in the order they lie in, without a shuffle; a hash and a few counts are all that is held (and the audit, which
    is the result's own cell).
    """
    schema = _schema(edits, DIGEST)
    before = {CODES[i]: LETTERS[i % 4] for i in range(16)}
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        nobody = object()
        conv, digest, audit, kept, faults, illegal, cost, last, low, high, distinct = nobody, None, [], 0, [0] * 4, 0, 0, "", None, None, 0

        def result() -> list:
            gaps = high - low + 1 - distinct if distinct else 0
            return [conv, gaps, faults[2], faults[3], faults[1], illegal, cost, "".join(audit), digest.hexdigest()]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if conv is nobody or row["conv_id"] != conv:
                    if conv is not nobody:
                        out.append(result())
                    conv, digest, audit, kept, faults, illegal, cost = row["conv_id"], hashlib.sha256(), [], 0, [0] * 4, 0, 0
                    last, low, high, distinct = "", None, None, 0
                edit, code, turn = row["edit"], row["code"], row["turn"]
                audit.append(edit)
                cost += price[edit]
                if edit != "D":
                    digest.update((("\n" if kept else "") + row["role"] + ":" + row["text"]).encode())
                    kept += 1
                if code is None:
                    continue
                fault, letter = CODES.index(code) // 4, before[code]
                faults[fault] += 1
                cost += STAYS_TRUNCATED if fault == 1 and edit != "D" else 0
                illegal += bool(last) and last + letter not in LEGAL
                last = letter
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), kind.field(i).type) for i, v in enumerate(zip(*out, strict=True))], schema=kind)
        if conv is not nobody:
            yield pa.RecordBatch.from_arrays([pa.array([v], kind.field(i).type) for i, v in enumerate(result())], schema=kind)

    return edits.mapInArrow(run, schema)


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The digest of ``rows`` repaired, for every conv_id of ``conversations``; one that has no rows left gives zeros."""
    found = written(repair_digest(repair_conversations(rows)), "conversation-digests")
    ids = conversations.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return _same(ids, found, ["conv_id"], "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))

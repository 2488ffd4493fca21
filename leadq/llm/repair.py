"""Conversation structure repair: the cheapest edits to a legal order of roles, by Hirschberg's divide and conquer."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from leadq.llm.frames import without
from leadq.session import staged

#: What has been said so far ends here: nothing, the system, the user, the assistant.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Rows of a block, a power of two: what one task holds of a conversation at a time. Only the plan depends on it.
BLOCK_ROWS = 4096
#: Blocks, and then nodes, that a node of the tree above holds, as a power of two.
FAN_BITS = 6
#: Leading characters by which rows of one turn are ordered before their hash decides.
TIE_CHARS = 64
#: Row of a node as stored: 16 costs and 16 ranks by (entry, exit), -1 for no way.
NODE = "cost array<bigint>, rank array<bigint>, head string, tail string, illegal bigint"

Table = list[list[tuple[int, int, object]]]


# --- one row, and a run of rows, as a table: for each entry state the exits with cost and audit-least way ---


def _spoken(state: int) -> int:
    """The state after an inserted or reroled turn, whose role is the only one that may follow."""
    return ASSISTANT if state == USER else USER


@lru_cache
def moves(code: str) -> Table:
    """Edits that one row allows. A code is the role's initial (x for others), upper case if the text is truncated,
    a digit instead if the row must go, or a point for the end of the conversation."""
    table: Table = []
    for entry in STATES:
        best: dict[int, tuple[int, str]] = {}
        at, letters = entry, ""
        for inserted in range(3):  # a third insert would come back to the state after the first
            spent = INSERT * inserted
            found = []
            if code == ".":
                found += [(START, spent, letters)] if at in (START, ASSISTANT) else []
            else:
                found.append((at, spent + DELETE, letters + "D"))
            if code.isalpha():
                extra = TRUNCATED * code.isupper()
                after = {"s": SYSTEM if at == START else None, "u": USER if at != USER else None, "a": ASSISTANT if at == USER else None}.get(code.lower())
                if after is not None:
                    found.append((after, spent + extra, letters + "K"))
                found.append((_spoken(at), spent + extra + REROLE, letters + "R"))
            for to, cost, way in found:
                best[to] = min(best.get(to, (cost, way)), (cost, way))
            at, letters = _spoken(at), letters + "I"
        table.append([(to, cost, way) for to, (cost, way) in sorted(best.items())])
    return table


def forward(tables: Iterable[Table], entry: int) -> dict[int, tuple[int, int]]:
    """{state: (cost, rank)} after all tables; ranks order the audit-least cheapest ways to the states. No way is the
    beginning of another, since each ends with the letter of its last row, so ranks carry over."""
    vector = {entry: (0, 0)}
    for table in tables:
        found: dict[int, tuple] = {}
        for state, (spent, rank) in vector.items():
            for to, cost, way in table[state]:
                key = (spent + cost, rank, way)
                if to not in found or key < found[to]:
                    found[to] = key
        order = sorted(found, key=lambda s: found[s][1:])
        vector = {state: (found[state][0], rank) for rank, state in enumerate(order)}
    return vector


def backward(tables: list[Table], exit: int) -> dict[int, int]:
    """{state: cost} of the cheapest ways from each state before the tables to `exit`."""
    vector = {exit: 0}
    for table in reversed(tables):
        costs = {s: [cost + vector[to] for to, cost, _ in table[s] if to in vector] for s in STATES}
        vector = {s: min(c) for s, c in costs.items() if c}
    return vector


def crossings(tables: list[Table], entry: int, exit: int) -> list[int]:
    """The states before, between and after the tables on the audit-least cheapest way from `entry` to `exit`.

    Hirschberg: forward and backward cost vectors meet in the middle, the cheapest crossing is chosen, of equal ones
    that with the least audit, and both halves are solved alike. Space is linear: two vectors of four states at a time.
    """
    if len(tables) == 1:
        return [entry, exit]
    middle = len(tables) // 2
    there, back = forward(tables[:middle], entry), backward(tables[middle:], exit)
    at = min(there.keys() & back.keys(), key=lambda s: (there[s][0] + back[s], there[s][1]))
    return crossings(tables[:middle], entry, at) + crossings(tables[middle:], at, exit)[1:]


@lru_cache(1 << 14)
def edits(codes: str, entry: int, exit: int) -> tuple[list[str], list[str]]:
    """(letters, made) by row: the edits' initials, and the turns that come of them: u, a inserted, U, A reroled, K kept."""
    tables = [moves(code) for code in codes]
    states = crossings(tables, entry, exit)
    ways = [next(way for to, _, way in table[a] if to == b) for table, a, b in zip(tables, states, states[1:], strict=False)]
    made = []
    for at, way in zip(states, ways, strict=False):
        turns = ""
        for letter in way:
            if letter == "K":
                turns += "K"
            elif letter != "D":
                at = _spoken(at)
                turns += ("u" if letter == "I" else "U") if at == USER else ("a" if letter == "I" else "A")
        made.append(turns)
    return ways, made


def _summary(tables: list[Table], edges: list[tuple[str, str, int]]) -> tuple:
    """NODE of a run of tables; `edges` are (head, tail, illegal): first and last initial and illegal pairs inside."""
    cost, rank = [-1] * 16, [-1] * 16
    for entry in STATES:
        for state, (spent, place) in forward(tables, entry).items():
            cost[4 * entry + state], rank[4 * entry + state] = spent, place
    head = tail = ""
    illegal = 0
    for first, last, inside in edges:
        illegal += inside + (bool(tail and first) and tail + first not in ("su", "ua", "au"))
        head, tail = head or first, last or tail
    return cost, rank, head, tail, illegal


@lru_cache(1 << 14)
def _block(codes: str) -> tuple:
    initials = [("suax"[int(c)] if c.isdigit() else c.lower()) for c in codes if c != "."]
    return _summary([moves(c) for c in codes], [(c, c, 0) for c in initials])


def _table(node: dict) -> Table:
    return [[(s, node["cost"][4 * e + s], node["rank"][4 * e + s]) for s in STATES if node["cost"][4 * e + s] >= 0] for e in STATES]


# --- Spark: rows in order, blocks of them, a tree over the blocks of long conversations ---


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by the checksum of `conv_id:turn`, modulo 20: 0 drops the row, 1 empties its
    text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row, 4 gives it the role user. Nulls become one space, except in conv_id and turn,
    where they count so in the checksum only."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        conversations.withColumn("__kind", kind)
        .filter("__kind != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("__kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
            F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy"),
        )
        .drop("__copy")
    )


def _rows(rows: DataFrame, conv_ids: DataFrame | None, block_rows: int) -> DataFrame:
    """Rows in order, staged: conv_id, turn, role, text, ord, node, and last, the last visible character. Each conversation has an end row.

    One range-cut shuffle orders them, so a long conversation spans several tasks. Its last key is the row's number, which cuts
    equal rows apart; they are interchangeable. A node is a block of at most `block_rows` rows.
    """
    said = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("end")
    )
    ids = (rows if conv_ids is None else conv_ids).select("conv_id").distinct()
    ends = ids.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("end"))
    keys = {
        "__role": F.substring("role", 1, TIE_CHARS),
        "__text": F.substring("text", 1, TIE_CHARS),
        "a": F.xxhash64("role", "text"),
        "b": F.xxhash64(F.lit(13), "text", "role"),
        "__row": F.monotonically_increasing_id(),
    }
    order = ["conv_id", "end", "turn", *keys]
    dealt = said.unionByName(ends).withColumns(keys).repartitionByRange(*order).sortWithinPartitions(*order)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    told = dealt.withColumn("ord", F.monotonically_increasing_id()).withColumn("last", last).drop("__role", "__text", "__row")
    told = staged(told, "repair-rows")
    inside = F.col("ord").bitwiseAND(F.lit((1 << 33) - 1))
    bits = block_rows.bit_length() - 1
    most = told.agg(F.max(F.shiftright(inside, bits))).first()[0] or 0
    return told.withColumn("node", F.shiftleft(F.shiftright("ord", 33), most.bit_length()) + F.shiftright(inside, bits))


def _judged(told: DataFrame) -> DataFrame:
    """conv_id, turn, ord, node, code, fault of every row: narrow, no text moves."""
    rows = told.select("conv_id", "turn", "end", "ord", "node", "a", "b", "last", F.substring("role", 1, 1).alias("initial"))
    # only a row whose words and role come more than once in its conversation needs to know the first
    firsts = rows.filter("not end").groupBy("conv_id", "a", "b").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("__id"), F.col("a").alias("__a"), F.col("b").alias("__b"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("__id")) & (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")) & ~F.col("end")
    fault = (
        F.when(F.col("end"), None).when(F.col("last") == "", "blank").when(F.col("ord") > F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    )
    place = F.when(F.col("initial").isin("s", "u", "a"), F.instr(F.lit("sua"), F.col("initial"))).otherwise(4)
    code = (
        F.when(F.col("end"), ".")
        .when(F.col("fault").isin("blank", "duplicate"), F.substring(F.lit("0123"), place, F.lit(1)))
        .when(F.col("fault") == "truncated", F.substring(F.lit("SUAX"), place, F.lit(1)))
        .otherwise(F.substring(F.lit("suax"), place, F.lit(1)))
    )
    judged = rows.join(firsts, same, "left").withColumn("fault", fault)
    return judged.select("conv_id", "turn", "ord", "node", code.alias("code"), "fault")


def _mapped(df: DataFrame, work: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows (conv_id, node, ...) through `work` in batches. The columns conv_id and node are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += work(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(column, types[i]) for i, column in enumerate(zip(*out, strict=True))], names)

    kind = df.schema["conv_id"].dataType.simpleString()
    full = f"conv_id {kind}, node bigint, {schema}"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], full).schema)
    types, names = arrow.types, arrow.names
    return df.mapInArrow(run, full)


def _climb(blocks: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels, roots): `levels[i]` holds the nodes above `levels[i - 1]` with their children, `roots[i]` the conversations that one node of
    level i covers, with total cost and illegal pairs. There are as many levels as 64-fold cuts of the longest conversation."""
    node = lambda r: (r["conv_id"], r["node"])
    nodes = staged(_mapped(blocks, lambda r: [(*node(r), *_block(r["codes"]))], NODE), "repair-nodes")
    levels, roots = [blocks], []
    while True:
        wide = nodes.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("__id"))
        mine = F.col("conv_id").eqNullSafe(F.col("__id"))
        roots.append(nodes.join(wide, mine, "left_anti").select("conv_id", "node", F.get("cost", F.lit(4 * START + START)).alias("cost"), "illegal"))
        more = nodes.join(wide, mine, "left_semi")
        if more.isEmpty():
            return levels, roots
        child = F.struct("node", "cost", "rank", "head", "tail", "illegal")
        above = more.groupBy("conv_id", F.shiftright("node", FAN_BITS).alias("node")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        above = staged(above, "repair-level")
        levels.append(above)

        def join_children(r: dict) -> list[tuple]:
            return [(*node(r), *_summary([_table(c) for c in r["children"]], [(c["head"], c["tail"], c["illegal"]) for c in r["children"]]))]

        nodes = staged(_mapped(above, join_children, NODE), "repair-nodes")


def _descend(levels: list[DataFrame], roots: list[DataFrame]) -> DataFrame:
    """conv_id, node, letters, made of every block: from the roots down each node tells its children where to begin and to end."""

    def ways(level: DataFrame, goals: DataFrame) -> DataFrame:
        goals = goals.select(F.col("conv_id").alias("__id"), F.col("node").alias("__node"), "entry", "exit")
        return level.join(goals, F.col("conv_id").eqNullSafe(F.col("__id")) & (F.col("node") == F.col("__node"))).drop("__id", "__node")

    def share(r: dict) -> list[tuple]:
        states = crossings([_table(c) for c in r["children"]], r["entry"], r["exit"])
        return [(r["conv_id"], c["node"], a, b) for c, a, b in zip(r["children"], states, states[1:], strict=False)]

    whole = lambda df: df.select("conv_id", "node", F.lit(START).alias("entry"), F.lit(START).alias("exit"))
    goals = whole(roots[-1])
    for level, root in zip(levels[:0:-1], roots[-2::-1], strict=True):
        goals = whole(root).unionByName(staged(_mapped(ways(level, goals), share, "entry int, exit int"), "repair-goals"))
    return _mapped(ways(levels[0], goals), lambda r: [(r["conv_id"], r["node"], r["first"], *edits(r["codes"], r["entry"], r["exit"]))], "first bigint, letters array<string>, made array<string>")


def repair(rows: DataFrame, conv_ids: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(turns, report) of conversations given as rows conv_id, turn, role, text.

    `turns` holds the repaired conversations: conv_id, ord, step (their order), edit (K kept, R reroled, I inserted), turn, role, text.
    `report` has a row per conversation of `rows`, or of `conv_ids`, where all may be named: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit.

    Rows go by turn, null first; rows of one turn by role and text (their first 64 characters, then a hash). A row's first fault
    counts: blank (no visible character), duplicate (its role and text came earlier in the conversation), truncated (the last visible
    character is none of `.!?`). Blank and duplicate rows are deleted (3). Other rows are kept (0), reroled to user or assistant (2) or
    deleted (3); a truncated one that stays costs 1. Empty turns may be inserted anywhere (2). The result is empty or an optional system
    turn, then user and assistant in turn, by the initials of the roles; `audit` lists the edits' initials, the least of the cheapest lists. A role of
    another or no initial can't be kept.

    Null role and text count as one space; rows without conv_id are one conversation; repeated rows are duplicates. Other columns are ignored. No
    rows: no report, unless conv_ids names some, which then have zeros and an empty audit. Long texts pass through the sort and one join and
    are never gathered. A conversation is cut into blocks of `block_rows` rows; a task holds the codes of one block, or 64 tables of the
    tree above, whatever the conversation's length. The audit is one letter a row, so it is limited to 2^31 rows.
    """
    ordered = _rows(rows, conv_ids, block_rows)
    told = staged(_judged(ordered), "repair-judged")
    entry = F.struct("ord", "code")
    blocks = told.groupBy("conv_id", "node").agg(F.sort_array(F.collect_list(entry)).alias("rows"), F.min("ord").alias("first"))
    blocks = staged(blocks.select("conv_id", "node", "first", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes")), "repair-blocks")
    levels, roots = _climb(blocks)
    ways = staged(_descend(levels, roots), "repair-edits")

    audit = F.struct("node", F.array_join("letters", "").alias("letters"))
    audits = ways.groupBy(F.col("conv_id").alias("__a")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(audit)), lambda x: x["letters"]), "").alias("audit"))
    costs = roots[0]
    for root in roots[1:]:
        costs = costs.unionByName(root)
    costs = costs.select(F.col("conv_id").alias("__c"), "illegal", "cost")
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    report = (
        told.groupBy("conv_id")
        .agg(gaps, count("blank"), count("duplicate"), count("truncated"))
        .join(costs, F.col("conv_id").eqNullSafe(F.col("__c")))
        .join(audits, F.col("conv_id").eqNullSafe(F.col("__a")))
        .drop("__c", "__a")
    )
    return _repaired(ordered, ways), report


def _repaired(ordered: DataFrame, ways: DataFrame) -> DataFrame:
    done = ways.select(F.col("conv_id").alias("__id"), F.col("node").alias("__node"), "first", "made")
    rows = ordered.join(done, F.col("conv_id").eqNullSafe(F.col("__id")) & (F.col("node") == F.col("__node")))
    made = F.get("made", (F.col("ord") - F.col("first")).cast("int"))
    each = rows.withColumn("__made", made).filter("__made != ''").select("*", F.posexplode(F.split("__made", "")).alias("step", "__turn"))
    new = F.col("__turn").isin("u", "a")
    return each.select(
        "conv_id",
        "ord",
        "step",
        F.when(new, "I").when(F.col("__turn") == "K", "K").otherwise("R").alias("edit"),
        F.when(~new, F.col("turn")).alias("turn"),
        F.when(F.col("__turn") == "K", F.col("role")).when(F.lower("__turn") == "u", "user").otherwise("assistant").alias("role"),
        F.when(new, "").otherwise(F.col("text")).alias("text"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the lines `role:text` of every conversation that has turns.

    Only this digest needs a conversation's turns one after the other: they are sorted within hash partitions and streamed, so a task
    holds one batch of rows, but the turns of one very long conversation pass through one task.
    """

    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, repaired_sha256 string"
    arrow = to_arrow_schema(turns.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for conv_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or conv_id != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), arrow.types, strict=True)], arrow.names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], arrow.types[0]), pa.array([digest.hexdigest()])], arrow.names)

    lines = turns.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "ord", "step")
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "ord", "step").select("conv_id", "line").mapInArrow(run, schema)


def damage_report(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of every conversation, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Nulls, ties, repeated rows, long texts and empty tables are as in `damage` and `repair`; a conversation without rows after the damage
    has zeros, an empty audit and the digest of the empty text.
    """
    turns, report = repair(damage(conversations), conversations, block_rows)
    told = digests(turns).select(F.col("conv_id").alias("__id"), "repaired_sha256")
    sha: Column = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    joined = report.join(told, F.col("conv_id").eqNullSafe(F.col("__id")), "left").withColumn("repaired_sha256", sha)
    return without(joined, "__id")

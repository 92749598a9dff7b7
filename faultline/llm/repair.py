"""Conversation structure repair: the cheapest edits to a legal order of roles, by iterative-deepening A*.

Legal orders are ``(s?(ua)+)?`` over the initials of system, user and assistant. Turns are
cut into chunks of bounded length; a search gives a chunk's cheapest edits between two
states of that automaton, and chunks are put together pair of states by pair of states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.ordinals import number_rows
from faultline.session import materialise

CHUNK = 64  # turns searched at once
FAN_IN = 32  # chunks put together at once
#: Costs of the edits, and of a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: White space that does not count, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant; the end stands for an accepting one.
EMPTY, SYSTEM, USER, ASSISTANT, END = range(5)
ACCEPTING = (EMPTY, ASSISTANT)
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one state that an inserted or renamed turn can lead to.
SPOKEN = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Steps tell the new role: I, R user and J, S assistant; an audit has I and R for both.
ASCII = str.maketrans("JS", "IR")
RESULT = "array<struct<entry:int,exit:int,cost:long,steps:string>>"


@lru_cache(maxsize=1 << 16)
def cheapest(codes: str, entry: int, goal: int) -> tuple[int, str] | None:
    """Cost and steps of the cheapest edits of a chunk from state ``entry`` to ``goal``.

    ``codes`` has two letters a turn: the role's initial (s, u, a or -) and its fault (b blank,
    d duplicate, t truncated or .). Depth-first search under a bound that rises to the
    least cost seen beyond it. Edits are tried in the order D, I, K, R, so the first path
    to the goal is the least in ASCII of the cheapest. ``need`` is the transposition table:
    the least cost still to pay from (turn, state), as far as failed searches have shown.
    None if the state can't be reached: edits that can be done cost no more than deleting all
    turns, keeping one instead, and two inserts.
    """
    n = len(codes) // 2
    goals = ACCEPTING if goal == END else (goal,)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if codes[2 * i + 1] != "." else 0)
    need: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def search(i: int, state: int, left: int) -> int:
        """0 when the goal is reached within ``left``, else what it takes at least more."""
        if i == n and state in goals:
            return 0
        low = need.get((i, state), least[i])
        if low > left:
            return low - left
        low = 1 << 60
        edits = []
        spoken = SPOKEN[state]
        if i < n:
            edits.append(("D", DELETE, i + 1, state))
        edits.append(("I" if spoken == USER else "J", INSERT, i, spoken))
        if i < n and codes[2 * i + 1] not in "bd":
            stays = TRUNCATED if codes[2 * i + 1] == "t" else 0
            kept = KEPT.get((state, codes[2 * i]))
            if kept is not None:
                edits.append(("K", stays, i + 1, kept))
            edits.append(("R" if spoken == USER else "S", REROLE + stays, i + 1, spoken))
        for letter, cost, j, after in edits:
            if cost > left:
                more = cost + need.get((j, after), least[j]) - left
            else:
                path.append(letter)
                more = search(j, after, left - cost)
                if not more:
                    return 0
                path.pop()
            low = min(low, more)
        need[i, state] = max(left + low, need.get((i, state), 0))
        return low

    bound = least[0]
    while bound <= DELETE * n + TRUNCATED + 2 * INSERT:
        more = search(0, entry, bound)
        if not more:
            return bound, "".join(path)
        bound += more
    return None


def join_tables(tables: list[list[dict]]) -> list[dict]:
    """The cheapest edits through consecutive chunks, for each pair of outer states.

    Ties go to the ASCII-least audit. No audit over the same turns is the beginning of
    another of the same cost, so the least of parts is the least of the whole.
    """
    whole = {(r["entry"], r["exit"]): (r["cost"], r["steps"]) for r in tables[0]}
    for table in tables[1:]:
        further: dict[tuple[int, int], tuple[int, str]] = {}
        for r in table:
            for (entry, middle), (cost, steps) in whole.items():
                if middle != r["entry"]:
                    continue
                new, pair = (cost + r["cost"], steps + r["steps"]), (entry, r["exit"])
                old = further.get(pair)
                if old is None or new[0] < old[0] or new[0] == old[0] and new[1].translate(ASCII) < old[1].translate(ASCII):
                    further[pair] = new
        whole = further
    return [{"entry": e, "exit": x, "cost": c, "steps": s} for (e, x), (c, s) in sorted(whole.items())]


def _search_chunks(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, n, codes, first, last to the table of cheapest edits of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = []
            for row in batch.select(["codes", "first", "last"]).to_pylist():
                pairs = [
                    (e, x)
                    for e in ((EMPTY,) if row["first"] else range(4))
                    for x in ((END,) if row["last"] else range(4))
                ]
                found = [(e, x, cheapest(row["codes"], e, x)) for e, x in pairs]
                tables.append([{"entry": e, "exit": x, "cost": y[0], "steps": y[1]} for e, x, y in found if y])
            yield _with_table(batch, ["conv_id", "chunk", "n"], tables)

    return chunks.mapInArrow(run, _schema(chunks))


def _join_chunks(groups: DataFrame) -> DataFrame:
    """conv_id, chunk, n, tables (in order) to one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [join_tables(x.as_py()) for x in batch.column("tables")]
            yield _with_table(batch, ["conv_id", "chunk", "n"], tables)

    return groups.mapInArrow(run, _schema(groups))


def _schema(df: DataFrame) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}, chunk long, n long, found {RESULT}"


def _with_table(batch: pa.RecordBatch, names: list[str], tables: list[list[dict]]) -> pa.RecordBatch:
    kind = pa.list_(
        pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("steps", pa.string())])
    )
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in names), pa.array(tables, kind)], [*names, "found"]
    )


def coded_turns(turns: DataFrame) -> DataFrame:
    """Light rows: conv_id, turn, row, place, n, initial (of the role), fault."""
    stripped = F.rtrim("text", F.lit(SPACE))
    role = F.col("role")
    light = turns.select(
        "conv_id",
        "turn",
        "row",
        F.substring("role", 1, 1).alias("initial"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, "text"), 256).alias("mark"),
        (stripped == "").alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    placed = materialise(number_rows(light, ["conv_id"], ["turn", "mark"], total="n"), "turns-placed")
    first = placed.groupBy("conv_id", "mark").agg(F.min("place").alias("_place"))
    first = first.select(F.col("conv_id").alias("_conv"), "_place")
    # by conversation and place, not by mark: a text that repeats a lot is spread
    same = placed["conv_id"].eqNullSafe(first["_conv"]) & (placed["place"] == first["_place"])
    fault = (
        F.when(F.col("blank"), "b")
        .when(F.col("_place").isNull(), "d")
        .when(F.col("open"), "t")
        .otherwise(".")
    )
    told = placed.join(first, same, "left").select(
        "conv_id", "turn", "row", "place", "n", "initial", fault.alias("fault")
    )
    return materialise(told, "turns-coded")


def plan_edits(coded: DataFrame) -> DataFrame:
    """conv_id, cost, steps: the cheapest edits of each conversation that has a turn."""
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    entry = F.struct("place", F.concat(letter, "fault").alias("code"))
    chunk = F.floor(F.col("place") / CHUNK).cast("long")
    chunks = coded.groupBy("conv_id", chunk.alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list(entry))["code"], "").alias("codes"), F.max("n").alias("n")
    )
    chunks = chunks.select(
        "conv_id",
        "chunk",
        F.ceil(F.col("n") / CHUNK).cast("long").alias("n"),
        "codes",
        (F.col("chunk") == 0).alias("first"),
        (F.col("chunk") == F.ceil(F.col("n") / CHUNK) - 1).alias("last"),
    )
    level = materialise(_search_chunks(chunks), "repair-chunks")
    most = level.agg(F.max("n").alias("n")).take(1)[0].n or 1
    done = level.where("n = 1")
    while most > 1:
        most = -(-most // FAN_IN)
        groups = level.where("n > 1").groupBy("conv_id", F.floor(F.col("chunk") / FAN_IN).cast("long").alias("chunk"))
        groups = groups.agg(
            F.sort_array(F.collect_list(F.struct(F.col("chunk").alias("k"), "found"))).alias("c"), F.max("n").alias("n")
        ).select("conv_id", "chunk", F.ceil(F.col("n") / FAN_IN).cast("long").alias("n"), F.col("c.found").alias("tables"))
        level = materialise(_join_chunks(groups), "repair-chunks")
        done = done.unionByName(level.where("n = 1"))
    best = F.element_at("found", 1)
    return done.select("conv_id", best["cost"].alias("cost"), best["steps"].alias("steps"))


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and their repaired turns, from ``conv_id, turn, role, text``.

    The first: conv_id, gaps (turn numbers missing), blank, duplicate, truncated (turns by
    their first fault), illegal (neighbours whose initials are not su, ua or au), cost and
    audit (the initials of the cheapest edits, ties ASCII-least). The second: conv_id, place,
    step, edit, role and text, in order of place and step; deleted turns are left out, inserted
    ones have an empty text.

    Turns are in the order of turn, null first; of equal turns by a digest of role and text,
    so equal rows stand side by side. Null role and text count as one space; null
    conv_id is one conversation. Extra columns are not looked at; texts of any length are
    read once and joined back to the edits by row. An empty table gives no rows.

    A conversation may hold any share of all rows: places are counted by ranges, the first
    holder of a text by a grouping, the search works on chunks of 64 turns. Only its
    audit, one value of the result, is a single string.
    """
    body = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    body = materialise(body.withColumn("row", F.monotonically_increasing_id()), "turns")
    coded = coded_turns(body)
    plan = materialise(plan_edits(coded), "repair-plan")

    def count(fault: str) -> Column:
        return F.count(F.when(F.col("fault") == fault, True))

    # the next turn's initial by a join on the place, which spreads a long conversation
    after = coded.select(
        F.col("conv_id").alias("_conv"), (F.col("place") - 1).alias("_place"), F.col("initial").alias("_next")
    )
    paired = coded.join(after, coded["conv_id"].eqNullSafe(after["_conv"]) & (coded["place"] == after["_place"]), "left")
    legal = F.concat("initial", "_next").isin("su", "ua", "au")
    tallies = paired.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count("b").alias("blank"),
        count("d").alias("duplicate"),
        count("t").alias("truncated"),
        F.count(F.when(~legal, True)).alias("illegal"),
    )
    told = plan.select(F.col("conv_id").alias("_conv"), "cost", F.translate("steps", "JS", "IR").alias("audit"))
    conversations = tallies.join(told, tallies["conv_id"].eqNullSafe(told["_conv"])).drop("_conv")
    return conversations, _apply(body, coded, plan)


def _apply(body: DataFrame, coded: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired turns: edits cut to their turns, turns joined by place, texts by row."""
    cut = F.regexp_extract_all("steps", F.lit("[IJ]*[DKRS]|[IJ]+"), F.lit(0))
    edits = plan.select(F.col("conv_id").alias("_conv"), F.posexplode(cut).alias("_place", "edits"))
    same = edits["_conv"].eqNullSafe(coded["conv_id"]) & (edits["_place"] == coded["place"])
    edits = edits.join(coded.select("conv_id", "place", "row"), same, "left")
    edits = edits.select(
        F.col("_conv").alias("conv_id"),
        F.col("_place").cast("long").alias("place"),
        "row",
        F.posexplode(F.split("edits", "")).alias("step", "edit"),
    )
    edits = edits.where(~F.col("edit").isin("D", ""))
    fresh = F.col("edit").isin("I", "J")
    new = F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("J", "S"), "assistant")
    names = ["conv_id", "place", "step", F.translate("edit", "JS", "IR").alias("edit")]
    texts = body.select("row", F.col("role").alias("_role"), "text")
    kept = edits.where(~fresh).join(texts, "row")
    kept = kept.select(*names, F.coalesce(new, "_role").alias("role"), "text")
    return kept.unionByName(edits.where(fresh).select(*names, new.alias("role"), F.lit("").alias("text")))


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 (hex) of ``role:text`` of its turns in order, joined by newlines.

    A digest is one pass over its conversation in order, so one task reads it; it holds the
    state of the hash and a batch, not the conversation. Conversations without a turn have no row.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    lines = repaired.select("conv_id", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = None, None
        for batch in batches:
            ids, out = batch.column("conv_id"), []
            for conv, line in zip(ids.to_pylist(), batch.column("line"), strict=True):
                if sha is None or conv != own:
                    if sha is not None:
                        out.append((own, sha.hexdigest()))
                    own, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.as_buffer())
            yield _digests(out, ids.type)
        if sha is not None:
            yield _digests([(own, sha.hexdigest())], ids.type)

    return lines.mapInArrow(run, f"conv_id {kind}, sha256 string")


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "sha256"]
    )

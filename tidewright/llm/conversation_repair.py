"""Cheapest repair of conversations to ``system? (user assistant)+`` by dynamic programming over grammar-compressed sequences.

A conversation is a sequence of symbols, one for each row, that say all the repair needs: the role's initial and the fault. The pairs of neighbouring symbols that
are most frequent in all conversations become rules (Re-Pair), pairs of rules become rules again, and every conversation is rewritten with them.
Each rule has one transfer matrix over the four states of the wanted form (nothing yet, after s, after u, after a), in which an entry
is the cheapest way between two states: its cost and its edits, as a rope that shares the ropes of the rule's two parts. Matrices are multiplied bottom-up, minimum
for sum and concatenation for product, once for all conversations; a conversation then takes one step for each symbol that is left of it.

Ties go to the edits that come first in ASCII order. Two ways through the same rows at the same cost are never a proper prefix of one another (the rest
would be inserts, which cost), so the least of a concatenation is the concatenation of the least, and matrices may keep one way only.

Rows are ordered by turn (nulls first), then role, then a digest of role and text. Equal rows of one turn travel as one row and a count. A conversation of any length is cut
into fragments by a range shuffle; fragments are rewritten and counted in parallel and met in order. Its repaired text has one SHA-256, which takes
the rows of a conversation one after the other, in constant memory.

Defined results: a null role or text counts as one blank, so does a null conversation or turn where ``damaged`` draws; rows with a null conversation are one
conversation; only the first character of a role counts for the form, in its own case. A conversation without rows has zeros, an empty audit and no repaired rows. ``gaps`` ends
at the largest long. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut_lineage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: States of the wanted form.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
#: Where each initial leads to.
STEPS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: A row that has to go; others are their initial (o for any other), in capitals if the row is truncated.
GONE = "x"
#: Symbols of a fragment at most.
FRAGMENT = 4096
#: Rounds of Re-Pair and rules of each; they bound the grammar, and so the work that conversations share. Results don't depend on them.
ROUNDS, RULES = 6, 48
FIRST_RULE = 0x100
LARGEST = (1 << 63) - 1


def or_blank(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, times: rows damaged as the crc32 of ``conv:turn`` modulo 20 says. 0 drops a row, 1 empties its text, 2 takes ``.!?``
    out of it, 3 repeats it, 4 makes its role user."""
    conv, turn = F.col(conv_col), F.col(turn_col)
    kind = F.crc32(F.concat(or_blank(conv), F.lit(":"), or_blank(turn))) % 20
    text = or_blank(F.col(text_col))
    return df.filter(kind != 0).select(
        conv.alias("conv"),
        turn.alias("turn"),
        F.when(kind == 4, "user").otherwise(or_blank(F.col(role_col))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def as_rows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Undamaged conversations in the form of ``damaged``."""
    return df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), or_blank(F.col(role_col)).alias("role"), or_blank(F.col(text_col)).alias("text"), F.lit(1).cast("long").alias("times"))


# --- symbols


def distinct_rows(rows: DataFrame) -> DataFrame:
    """conv, turn, role, same (a digest of conversation, role and text), n (equal rows), text, symbol and blank."""
    name = F.coalesce(F.col("conv").cast("string"), F.lit(""))
    named = F.concat(F.when(F.col("conv").isNull(), "-").otherwise("+"), F.length(name).cast("string"), F.lit(":"), name)
    same = F.unhex(F.md5(F.concat(named, F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    grouped = rows.withColumn("same", same).groupBy("conv", "turn", "role", "same").agg(F.sum("times").alias("n"), F.any_value("text").alias("text"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return grouped.withColumns({"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "symbol": F.when(whole, kind).otherwise(F.upper(kind))})


def turn_order() -> Column:
    """Orders turns, nulls first."""
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def with_late(rows: DataFrame) -> DataFrame:
    """rows without their text, and whether role and text stand at an earlier turn of the conversation."""
    narrow = rows.drop("text")
    several = narrow.groupBy("same").agg(F.min(turn_order()).alias("first"), F.count(F.lit(1)).alias("turns")).filter(F.col("turns") > 1)
    return narrow.join(several.drop("turns"), "same", "left").withColumn("late", F.coalesce(turn_order() > F.col("first"), F.lit(False))).drop("first")


FRAGMENT_FIELDS = "seq string, blank long, duplicate long, truncated long, illegal long, head string, tail string, lowest long, highest long, turns long, opened long, closed long"


def fragments(marked: DataFrame) -> DataFrame:
    """conv, part, nth and what ``FRAGMENT_FIELDS`` says of each fragment of a conversation, in order of part and nth.

    head and tail are the outer initials, opened and closed the outer turns.
    """
    order = ["conv", "turn", "role", "same"]
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, own = TaskContext.get().partitionId(), 0, None
        conv, out, kind = None, [], pa.null()

        def end():
            out.append((conv, part, nth, "".join(own["seq"]), *(own[k] for k in ("blank", "duplicate", "truncated", "illegal", "head", "tail", "lowest", "highest", "turns", "opened", "closed"))))

        for batch in batches:
            kind = batch.schema.field("conv").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "n", "blank", "symbol", "late")]
            for name, turn, role, n, blank, symbol, late in zip(*columns, strict=True):
                initial, done = role[:1], 0
                while done < n:
                    if own is None or conv != name or len(own["seq"]) >= FRAGMENT:
                        if own is not None:
                            end()
                            nth += 1
                        conv = name
                        own = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"seq": [], "head": initial, "lowest": turn, "opened": turn, "tail": None, "closed": None, "highest": None}
                    takes = min(n - done, FRAGMENT - len(own["seq"]))
                    whole = 0 if blank or late or done else 1
                    if blank:
                        own["blank"] += takes
                    else:
                        own["duplicate"] += takes - whole
                        own["truncated"] += whole and symbol.isupper()
                    own["illegal"] += takes - 1 + (own["tail"] is not None and (own["tail"], initial) not in LEGAL)
                    if turn is not None and (own["closed"] != turn or not own["seq"]):
                        own["turns"] += 1
                    if own["lowest"] is None:
                        own["lowest"] = turn
                    own["seq"].extend([symbol] * whole + [GONE] * (takes - whole))
                    own["tail"], own["closed"], own["highest"] = initial, turn, turn
                    done += takes
            if len(out) >= 2000:
                yield table(out, kind)
                out = []
        if own is not None:
            end()
        if out:
            yield table(out, kind)

    kind = marked.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part int, nth long, {FRAGMENT_FIELDS}"
    names = [field.split()[0] for field in schema.split(", ")]

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        fields = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
        typed = {k: pa.array(v, pa.string() if k in ("seq", "head", "tail") else pa.int32() if k == "part" else pa.int64()) for k, v in fields.items() if k != "conv"}
        return pa.RecordBatch.from_pydict({"conv": pa.array(fields["conv"], kind)} | typed)

    return ordered.select("conv", F.col("turn").cast("long").alias("turn"), "role", "n", "blank", "symbol", "late").mapInArrow(run, schema)


# --- Re-Pair


def rewritten(seq: str, rules: list[str]) -> str:
    """The sequence with each rule's pair replaced, left to right, in the order of the rules."""
    for k, pair in enumerate(rules):
        if pair in seq:
            seq = seq.replace(pair, chr(FIRST_RULE + k))
    return seq


def grammar(sequences: DataFrame, rounds: int = ROUNDS, most: int = RULES) -> list[str]:
    """The pairs that rules stand for: each round the ``most`` frequent pairs of neighbours in all distinct sequences, which earlier rules have rewritten.

    A list of fixed length at most, whatever the input.
    """
    distinct = cut_lineage(sequences.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "sequences")
    rules: list[str] = []
    for _ in range(rounds):
        known = list(rules)

        def pairs(batches: Iterator[pa.RecordBatch], known: list[str] = known) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for seq, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    short = rewritten(seq, known)
                    for pair, times in Counter(map(str.__add__, short, short[1:])).items():
                        found[pair] += n * times
            yield pa.RecordBatch.from_pydict({"pair": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        counted = distinct.mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
        best = [r.pair for r in counted.orderBy(F.desc("n"), "pair").limit(most).collect()]
        if not best:
            break
        rules += best
    return rules


# --- ropes and matrices


def leaves(rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        one = stack.pop()
        if isinstance(one, str):
            if one:
                yield one
        else:
            stack += (one[1], one[0])


def joined(a, b):
    return b if a == "" else a if b == "" else (a, b)


def before(a, b) -> bool:
    """Whether the text of rope a comes before that of b; beginnings that both share are skipped."""
    while a is not b and isinstance(a, tuple) and isinstance(b, tuple) and a[0] is b[0]:
        a, b = a[1], b[1]
    if a is b:
        return False
    one, other, x, y = leaves(a), leaves(b), "", ""
    while True:
        x, y = x or next(one, None), y or next(other, None)
        if x is None or y is None:
            return x is None and y is not None
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x < y
        x, y = x[n:], y[n:]


def better(a, b) -> bool:
    """Whether way a (cost, rope) is to be taken rather than b; None is no way."""
    if a is None or b is None:
        return b is None and a is not None
    return a[0] < b[0] or a[0] == b[0] and before(a[1], b[1])


def through(row: list, ways: list):
    """The best of one way of ``row`` followed by the way of ``ways`` from where it ends."""
    best = None
    for a, b in zip(row, ways, strict=True):
        if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
            way = (a[0] + b[0], joined(a[1], b[1]))
            if better(way, best):
                best = way
    return best


def product(a: list[list], b: list[list]) -> list[list]:
    columns = list(zip(*b, strict=True))
    return [[through(row, column) for column in columns] for row in a]


def inserts() -> list[list]:
    """Ways by inserts alone, between any two states: three at most lead anywhere."""
    unit = [[(0, "") if i == j else None for j in STATES] for i in STATES]
    one = [[(INSERT_COST, INSERT) if j in (STEPS["u"].get(i), STEPS["a"].get(i)) else None for j in STATES] for i in STATES]
    ways, power = unit, unit
    for _ in range(3):
        power = product(power, one)
        ways = [[p if better(p, w) else w for w, p in zip(x, y, strict=True)] for x, y in zip(ways, power, strict=True)]
    return ways


def row_ways(symbol: str) -> list[list]:
    """Ways of one row: inserts before it, then one edit of the row."""
    ways = [[(DELETE_COST, DELETE) if i == j else None for j in STATES] for i in STATES]
    if symbol != GONE:
        more = TRUNCATED_COST if symbol.isupper() else 0
        edits = [(role, more + REROLE_COST, REROLE) for role in ("u", "a")] + [(symbol.lower(), more, KEEP)]
        for role, cost, edit in edits:
            for i, j in STEPS.get(role, {}).items():
                if better((cost, edit), ways[i][j]):
                    ways[i][j] = (cost, edit)
    return product(inserts(), ways)


class Solver:
    """The cheapest way through sequences, with one matrix for each symbol and rule."""

    def __init__(self, rules: list[str], remembered: int = 50_000):
        self.rules, self.known, self.remembered = rules, {}, remembered
        self.matrices = {s: row_ways(s) for s in "suaoSUAO" + GONE}
        for k, (a, b) in enumerate(rules):
            self.matrices[chr(FIRST_RULE + k)] = product(self.matrices[a], self.matrices[b])
        self.last = [min((w for w in (ways[START], ways[AFTER_A]) if w is not None), key=lambda w: w[0]) for ways in inserts()]

    def ahead(self, seq: str, ways: list) -> list:
        """The best ways from each state through ``seq`` and on by ``ways``."""
        for symbol in reversed(rewritten(seq, self.rules)):
            ways = [through(row, ways) for row in self.matrices[symbol]]
        return ways

    def solve(self, seq: str) -> tuple[int, str]:
        """Cost and edits of a whole conversation."""
        if seq not in self.known:
            if len(self.known) >= self.remembered:
                self.known.clear()
            cost, rope = self.ahead(seq, self.last)[START]
            self.known[seq] = cost, "".join(leaves(rope))
        return self.known[seq]


PLAN_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair_plan(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """conv and ``PLAN_FIELDS`` of each conversation of ``rows`` (as ``distinct_rows`` gives them), and of each in ``convs``."""
    pieces = cut_lineage(fragments(cut_lineage(with_late(rows), "marked")), "fragments")
    rules = grammar(pieces.select("seq"))
    kind = rows.schema["conv"].dataType.simpleString()
    every = (rows if convs is None else convs).select("conv").distinct()
    met = pieces.unionByName(every.withColumns({"part": F.lit(-1), "nth": F.lit(-1).cast("long")}), allowMissingColumns=True)
    # From its last fragment to its first; a row without fragment ends each conversation.
    met = met.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, held = Solver(rules), []

        def finish(conv) -> tuple:
            if not held:
                return (conv, 0, 0, 0, 0, 0, 0, "")
            cost, audit = solver.solve(held[0]["seq"]) if len(held) == 1 else chained()
            sums = {k: sum(f[k] for f in held) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
            for later, earlier in zip(held, held[1:], strict=False):
                sums["illegal"] += (earlier["tail"], later["head"]) not in LEGAL
                sums["turns"] -= later["opened"] is not None and later["opened"] == earlier["closed"]
            lows, highs = ([f[k] for f in held if f[k] is not None] for k in ("lowest", "highest"))
            gaps = min(max(highs) - min(lows) + 1 - sums["turns"], LARGEST) if highs else 0
            return (conv, gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], cost, audit)

        def chained() -> tuple[int, str]:
            ways = solver.last
            for f in held:
                ways = solver.ahead(f["seq"], ways)
            return ways[START][0], "".join(leaves(ways[START][1]))

        names = ["conv", *(f.split()[0] for f in PLAN_FIELDS.split(", "))]
        types = [None, *[pa.int64()] * 6, pa.string()]
        for batch in batches:
            out = []
            for f in batch.to_pylist():
                if f["part"] >= 0:
                    held.append(f)
                else:
                    out.append(finish(f["conv"]))
                    held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t or batch.schema.field("conv").type) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return met.mapInArrow(run, f"conv {kind}, {PLAN_FIELDS}")


# --- repaired rows


def edited(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired conversation in order, given its rows as (role, text, equal rows)."""
    state, at = START, 0

    def inserted():
        nonlocal state, at
        while at < len(audit) and audit[at] == INSERT:
            initial = "a" if state == AFTER_U else "u"
            state, at = STEPS[initial][state], at + 1
            yield INSERT, "assistant" if initial == "a" else "user", ""

    for role, text, n in rows:
        for _ in range(n):
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == DELETE:
                continue
            if edit == REROLE:
                role_now = "assistant" if state == AFTER_U else "user"
            else:
                role_now = role
            state = STEPS[role_now[:1]][state]
            yield edit, role_now, text
    yield from inserted()


def with_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each plan followed by the rows of its conversation in order."""
    fields = [f.split()[0] for f in PLAN_FIELDS.split(", ")]
    heads = plans.withColumn("step", F.lit(0))
    both = heads.unionByName(rows.select("conv", "turn", "role", "same", "text", "n", F.lit(1).alias("step")), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "step", "turn", "role", "same").select("conv", "step", *fields, "role", "text", "n")


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, int]]]]:
    """(plan, its rows) for each conversation of a task; the rows are to be used up before the next."""
    rows = (row for batch in batches for start in range(0, batch.num_rows, 500) for row in batch.slice(start, 500).to_pylist())
    ahead = next(rows, None)

    def own():
        nonlocal ahead
        ahead = next(rows, None)
        while ahead is not None and ahead["step"] == 1:
            yield ahead["role"], ahead["text"], ahead["n"]
            ahead = next(rows, None)

    while ahead is not None:
        yield ahead, own()


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv, place (from 0), edit, role, text of the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out = None, []

        def batch_of():
            conv, place, edit, role, text = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(place, pa.int64()), pa.array(edit), pa.array(role), pa.array(text)], names=["conv", "place", "edit", "role", "text"])

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        for plan, own in conversations(typed()):
            for place, (edit, role, text) in enumerate(edited(plan["audit"], own)):
                out.append((plan["conv"], place, edit, role, text))
                if len(out) >= 1000:
                    yield batch_of()
                    out = []
        if out:
            yield batch_of()

    kind = rows.schema["conv"].dataType.simpleString()
    return with_plans(rows, plans).mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")


def with_digests(rows: DataFrame, plans: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The plans and repaired_sha256, of ``role:text`` lines joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []

        def typed():
            for batch in batches:
                kinds[:] = [batch.schema.field(n).type for n in names]
                yield batch

        out = []
        for plan, own in conversations(typed()):
            digest, first = hashlib.sha256(), True
            for _, role, text in edited(plan["audit"], own):
                digest.update(("" if first else "\n").encode() + role.encode() + b":" + text.encode())
                first = False
            out.append((*(plan[n] for n in names), digest.hexdigest()))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [*kinds, pa.string()], strict=True)], names=[*names, "sha"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [*kinds, pa.string()], strict=True)], names=[*names, "sha"])

    names = ["conv", *(f.split()[0] for f in PLAN_FIELDS.split(", "))]
    kind = rows.schema["conv"].dataType.simpleString()
    found = with_plans(rows, plans).mapInArrow(run, f"conv {kind}, {PLAN_FIELDS}, sha string")
    return found.select(F.col("conv").alias(conv_col), *names[1:], F.col("sha").alias("repaired_sha256"))


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired rows of ``df``: conv, place, edit, role, text."""
    rows = cut_lineage(distinct_rows(as_rows(df, conv_col, turn_col, role_col, text_col)), "conversation-rows")
    return repaired_rows(rows, repair_plan(rows))


def damaged_and_repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation of ``df``: what the damage of ``damaged`` left to repair, the edits, and the digest of the result."""
    rows = cut_lineage(distinct_rows(damaged(df, conv_col, turn_col, role_col, text_col)), "conversation-rows")
    plans = cut_lineage(repair_plan(rows, df.select(F.col(conv_col).alias("conv"))), "plans")
    return with_digests(rows, plans, conv_col)

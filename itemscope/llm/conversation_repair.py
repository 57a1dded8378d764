"""Repair of conversations by cheapest edits.

A conversation is legal when the initials of its roles give (s?(ua)+)?. Rows are kept, given another
role or deleted, and empty turns inserted. The cheapest edits are the least path through a graph
whose nodes are (row, what the roles so far end with). A path's weight is one integer: the cost in
the high digits, below it one digit of three bits for each letter of the audit, the first letter
highest, zeros after the last. So an ordinary minimum of integers decides cost and ties at once, and
a shorter audit comes before its continuations.

The graph is walked from the end: an edge in front of a path moves the path's letters down and puts
its own on top. Long conversations are walked in blocks: a block's least paths between every two
states become edges of many letters, so that wide integers are met once a block. Two paths between
the same states over the same rows that cost the same never begin with each other, since only an
insertion has a letter of its own; so the least parts make the least whole.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window, functions as F

from itemscope.llm.common import arrow, bounded_batches
from itemscope.session import written

DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = " DIKR"
#: What the roles so far end with: nothing, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn that is added in a state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
BITS = 3
#: Rows of a block.
BLOCK = 512

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def _after(state, initial):
    """The state after a kept row, or None where its role is not legal."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _before(weight, digits, cost, letters, count):
    """The weight of a path with an edge of `count` letters in front."""
    if weight is None:
        return None
    wide = digits * BITS
    high, low = weight >> wide, weight & ((1 << wide) - 1)
    return (high + cost << wide) | (letters << wide - count * BITS) | (low >> count * BITS)


def _least(*weights):
    return min((w for w in weights if w is not None), default=None)


def _inserted(weights, digits):
    """Weights by state before up to two insertions. More lead to no state that fewer do not."""
    once = [_before(weights[NEXT[s]], digits, 2, INSERT, 1) for s in range(4)]
    twice = [_before(once[NEXT[s]], digits, 2, INSERT, 1) for s in range(4)]
    return [_least(*w) for w in zip(weights, once, twice)]


def _row(weights, digits, initial, fault):
    """Weights by state before a row, and insertions before it, from those after it."""
    more, out = int(fault == TRUNCATED), []
    for s in range(4):
        ways = [_before(weights[s], digits, 3, DELETE, 1)]
        if fault not in (BLANK, DUPLICATE):
            ways.append(_before(weights[NEXT[s]], digits, 2 + more, REROLE, 1))
            kept = _after(s, initial)
            if kept is not None:
                ways.append(_before(weights[kept], digits, more, KEEP, 1))
        out.append(_least(*ways))
    return _inserted(out, digits)


def _letters(weight, digits):
    """The cost of a weight, its letters as a number and how many they are."""
    wide = digits * BITS
    low = weight & ((1 << wide) - 1)
    empty = (low & -low).bit_length() - 1 if low else wide
    count = digits - empty // BITS
    return weight >> wide, low >> (digits - count) * BITS, count


def cheapest_edits(initials, faults):
    """(cost, audit) of the cheapest edits of a conversation; ties go to the ASCII-least audit.

    `initials` has the first character of each row's role, `faults` a number for each row.
    """
    n = len(initials)
    digits = 3 * n + 2
    # After the last row, insertions may still follow.
    weights = [0 if s in (START, ASSISTANT) else None for s in range(4)]
    weights = _inserted(weights, digits)
    if n <= BLOCK:
        for i in reversed(range(n)):
            weights = _row(weights, digits, initials[i], faults[i])
    else:
        for end in range(n, 0, -BLOCK):
            begin = max(0, end - BLOCK)
            inner = 3 * (end - begin)
            edges = []
            for t in range(4):
                ways = [0 if s == t else None for s in range(4)]
                for i in reversed(range(begin, end)):
                    ways = _row(ways, inner, initials[i], faults[i])
                edges.append(ways)
            weights = [_least(*(_before(weights[t], digits, *_letters(edges[t][s], inner))
                                for t in range(4) if edges[t][s] is not None)) for s in range(4)]
    cost, letters, count = _letters(weights[START], digits)
    text = f"{letters:o}" if count else ""    # no letter is zero
    return cost, text.translate(str.maketrans("1234", LETTERS[1:]))


class Repaired:
    """Rows of a conversation as its audit repairs them, one after the other, hashed at once."""

    def __init__(self, audit):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def _put(self, role, text):
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def inserts(self):
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self._put(ROLES[self.state], "")
            yield ROLES[self.state], "", "I"

    def row(self, role, text):
        """The turns (role, text, letter) that a row becomes, insertions before it included."""
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        self.state = NEXT[self.state] if letter == "R" else _after(self.state, role[:1])
        role = ROLES[self.state] if letter == "R" else role
        self._put(role, text)
        yield role, text, letter


#: What text ends with is looked for before these.
_WHITE = " \t\n\x0b\x0c\r"
_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations):
    """Rows of `conversations` as the checksum of conv_id:turn damages them; NULL is one space."""
    space = F.lit(" ")
    number = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                              F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    return bounded_batches(conversations).where(number != 0).select(
        "conv_id", "turn",
        F.when(number == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(number == 1, "").when(number == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(number == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        .alias("copy")).drop("copy")


def with_faults(rows):
    """`rows` (conv_id, turn, role, text) with place and fault; NULL counts as one space.

    place counts a conversation's rows by turn, NULL first, then by role and text. fault is 1 for a
    blank row, 2 where an earlier one has the same role and text, 3 for a truncated row, else 0.
    """
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    last = F.substring(F.rtrim("text", F.lit(_WHITE)), -1, 1)
    return rows.repartition("conv_id").withColumn("place", F.row_number().over(order).cast("long")) \
        .withColumn("fault", F.when(last == "", BLANK).when(F.row_number().over(same) > 1, DUPLICATE)
                    .when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0))


def _columns(batch, names):
    return zip(*(batch.column(name).to_pylist() for name in names))


class _Marks:
    """What is counted of a conversation, from its rows in order. A row is held as two bytes."""

    def __init__(self, conv):
        self.conv, self.faults, self.initials = conv, bytearray(), bytearray()
        self.turns, self.first, self.last, self.illegal = 0, None, None, 0

    def row(self, turn, initial, fault):
        # Initials of no role are alike: none of them is legal anywhere.
        initial = initial if initial in ("s", "u", "a") else " "
        if self.initials and chr(self.initials[-1]) + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initials.append(ord(initial))
        self.faults.append(fault)
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn

    def report(self):
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit = cheapest_edits(self.initials.decode(), self.faults)
        return (self.conv, gaps, *(self.faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)),
                self.illegal, cost, audit)


def _audited(batches):
    """Conversations one after the other; each begins with a row of place 0."""
    marks = kind = None
    for batch in batches:
        out, kind = [], batch.schema.field("conv_id").type
        for conv, place, turn, initial, fault in _columns(
                batch, ("conv_id", "place", "turn", "initial", "fault")):
            if place:
                marks.row(turn, initial, fault)
                continue
            if marks:
                out.append(marks.report())
            marks = _Marks(conv)
        if out:
            yield _reports(out, kind)
    if marks:
        yield _reports([marks.report()], kind)


def _reports(rows, kind):
    columns = list(zip(*rows))
    return arrow(conv_id=(columns[0], kind),
                 **{name: (columns[1 + i], pa.int64()) for i, name in enumerate(_STATS)},
                 audit=(columns[-1], pa.string()))


def _walked(turns):
    """Rows in order behind their conversation's audit, as repaired turns or as reports with a hash."""
    def work(batches):
        report = repaired = kind = None
        place, out = 0, []

        def add(made):
            nonlocal place
            for turn in made:
                place += 1
                if turns:
                    out.append((report[0], place, *turn))

        def close():
            add(repaired.inserts())
            if not turns:
                out.append((*report, repaired.hash.hexdigest()))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, at, role, text, audit, *stats in _columns(
                    batch, ("conv_id", "place", "role", "text", "audit", *_STATS)):
                if at:
                    add(repaired.row(role, text))
                    continue
                if repaired:
                    close()
                report, repaired, place = (conv, *stats, audit), Repaired(audit), 0
            if out:
                yield _walked_batch(kind, out, turns)
                out.clear()
        if repaired:
            close()
        if out:
            yield _walked_batch(kind, out, turns)
    return work


def _walked_batch(kind, rows, turns):
    columns = list(zip(*rows))
    if turns:
        return arrow(conv_id=(columns[0], kind), place=(columns[1], pa.int64()),
                     **{name: (columns[2 + i], pa.string()) for i, name in enumerate(("role", "text", "edit"))})
    return arrow(conv_id=(columns[0], kind),
                 **{name: (columns[1 + i], pa.int64()) for i, name in enumerate(_STATS)},
                 audit=(columns[-2], pa.string()), repaired_sha256=(columns[-1], pa.string()))


def _in_order(rows):
    """Conversations in order. The number of tasks is given, since small rows mean much work here."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "place")


def _repair(rows, ids, turns):
    kind = rows.schema["conv_id"].dataType.simpleString()
    stats = ", ".join(f"{name} long" for name in _STATS)
    rows = written(with_faults(rows), "repair-rows")
    heads = ids.select("conv_id").distinct().withColumn("place", F.lit(0).cast("long"))
    marks = rows.select("conv_id", "place", F.col("turn").cast("long").alias("turn"),
                        F.substring("role", 1, 1).alias("initial"), "fault")
    audits = written(
        _in_order(marks.unionByName(heads, allowMissingColumns=True)).mapInArrow(
            _audited, f"conv_id {kind}, {stats}, audit string"),
        "repair-audits").withColumn("place", F.lit(0).cast("long"))
    walk = rows.select("conv_id", "place", "role", "text").unionByName(audits, allowMissingColumns=True)
    shape = "place long, role string, text string, edit string" if turns else \
        f"{stats}, audit string, repaired_sha256 string"
    return _in_order(walk).mapInArrow(_walked(turns), f"conv_id {kind}, {shape}")


def repaired_turns(rows):
    """(conv_id, place, role, text, edit) of the turns that the cheapest edits of `rows` leave.

    edit is K (kept), R (another role) or I (inserted). Conversations of which nothing is left
    have no rows. See `repair_report` for what is repaired.
    """
    return _repair(rows, rows, True)


def repair_report(rows, ids=None):
    """One row per conv_id of `ids` (of `rows` where none is given): what its repair costs and gives.

    gaps (turns that are missing between the first and the last), blank, duplicate, truncated,
    illegal (neighbours whose initials are not su, ua or au), cost, audit and repaired_sha256, of
    the repaired role:text lines. Every `ids` row's conv_id has a row, NULL too; without rows it has
    zeros, an empty audit and the hash of nothing. Rows of one turn are ordered by role and text;
    a NULL role or text is one space. Further columns are dropped. A conversation's audit is one
    value and its hash sequential, so one task reads its rows, in a stream that holds two bytes a
    row and the audit, however long the texts.
    """
    return _repair(rows, rows if ids is None else ids, False)

"""Repair of the role structure of conversations, by an error-correcting Earley parse.

The grammar says which sequences of role initials are whole: ``(s?(ua)+)?``.  Beside keeping a row, a parse may delete
a row, give it another role, or insert one, each at a cost; the chart keeps the least (cost, audit) of each item, an
audit being the initials of the edits so far, and the completed chart's audit is the repair.  Of two audits that take
the same rows, one begins the other only if it costs less, so comparing them item by item is exact.

On Spark: rows get their places and faults, a conversation becomes a string with one letter a row (assembled by
stretches), the chart turns it into an audit, and the texts, sorted, stream past their audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Memo
from tideline.llm.scratch import Scratch
from tideline.llm.turns import digest, positions

#: Left-recursive, so that every item begins at the first column and a column holds few of them.
GRAMMAR = (("talk", ()), ("talk", ("body",)), ("body", ("head", "u", "a")), ("body", ("body", "u", "a")), ("head", ()), ("head", ("s",)))
START = "talk"
HEADS = {head for head, _ in GRAMMAR}
REROLED = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
CLASSES, STATES = "sua-", ("whole", "truncated", "blank", "duplicate")
PLACES = 4096
REMEMBERED = 24
FOLD = 256
SPACE = " \t\n\x0b\x0c\r"

Item = tuple[int, int, int]
Value = tuple[int, str]


class Chart:
    """One column of the chart at a time, and the items that wait for a symbol in the columns before."""

    def __init__(self) -> None:
        self.place = 0
        self.waiting: dict[tuple[int, str], dict[Item, Value]] = {}
        self.folds: list[list[str]] = []
        self.column: dict[Item, Value] = {}
        self._close({(p, 0, 0): (0, "") for p, (head, _) in enumerate(GRAMMAR) if head == START})

    def _close(self, items: dict[Item, Value]) -> None:
        """Predicts, completes and inserts until nothing gets cheaper."""
        column = self.column = dict(items)
        agenda = list(items)

        def offer(item: Item, value: Value) -> None:
            if item not in column or value < column[item]:
                column[item] = value
                agenda.append(item)

        while agenda:
            item = agenda.pop()
            (production, dot, origin), (cost, audit) = item, column[item]
            head, body = GRAMMAR[production]
            if dot == len(body):
                for (p, d, o), (c, a) in list(self.waiting.get((origin, head), {}).items()):
                    offer((p, d + 1, o), (c + cost, a + audit))
            elif body[dot] in HEADS:
                self.waiting.setdefault((self.place, body[dot]), {})[item] = column[item]
                for p, (h, b) in enumerate(GRAMMAR):
                    if h == body[dot]:
                        offer((p, 0, self.place), (0, ""))
                        if (p, len(b), self.place) in column:
                            c, a = column[p, len(b), self.place]
                            offer((production, dot + 1, origin), (cost + c, audit + a))
            elif body[dot] in REROLED:
                offer((production, dot + 1, origin), (cost + INSERT, audit + "I"))

    def read(self, role: str, must_go: bool, truncated: bool) -> None:
        """Takes in one row: its role initial (one of ``CLASSES``) and what is wrong with it."""
        following: dict[Item, Value] = {}

        def offer(item: Item, value: Value) -> None:
            if item not in following or value < following[item]:
                following[item] = value

        for item, (cost, audit) in self.column.items():
            production, dot, origin = item
            head, body = GRAMMAR[production]
            if dot == len(body):
                if head == START:
                    offer(item, (cost + DELETE, audit + "D"))
            elif body[dot] not in HEADS:
                offer(item, (cost + DELETE, audit + "D"))
                if not must_go:
                    late = CUT_SHORT * truncated
                    if body[dot] == role:
                        offer((production, dot + 1, origin), (cost + late, audit + "K"))
                    if body[dot] in REROLED:
                        offer((production, dot + 1, origin), (cost + REROLE + late, audit + "R"))
        self.place += 1
        if self.place % FOLD == 0:
            # all these audits end with this row's edit, so none begins another: their ranks may stand for them
            told = sorted({audit for _, audit in following.values()})
            self.folds.append(told)
            rank = {audit: chr(i) for i, audit in enumerate(told)}
            following = {item: (cost, rank[audit]) for item, (cost, audit) in following.items()}
        self._close(following)

    def repair(self) -> Value:
        """The least cost and audit of a whole conversation."""
        cost, audit = min(v for (p, d, o), v in self.column.items() if GRAMMAR[p][0] == START and d == len(GRAMMAR[p][1]) and o == 0)
        parts = []
        for told in reversed(self.folds):
            parts.append(audit[1:])
            audit = told[ord(audit[0])]
        return cost, audit + "".join(reversed(parts))


def letter(role: int, state: int) -> str:
    return chr(ord("A") + len(STATES) * role + state)


def parse(symbols: str) -> Value:
    """(cost, audit) of a conversation that is given by one letter a row."""
    chart = Chart()
    for x in symbols:
        role, state = divmod(ord(x) - ord("A"), len(STATES))
        chart.read(CLASSES[role], state > 1, state == 1)
    return chart.repair()


LEGAL = {a + b for a, b in ("su", "ua", "au")}


def tallies(symbols: str) -> tuple[int, int, int, int]:
    """Counts of blank, duplicate and truncated rows, and of neighbours whose roles may not follow each other."""
    rows = [divmod(ord(x) - ord("A"), len(STATES)) for x in symbols]
    states = [s for _, s in rows]
    roles = [CLASSES[r] for r, _ in rows]
    return states.count(2), states.count(3), states.count(1), sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))


def edited(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of what ``audit`` leaves of ``rows``, in order; one row is held at a time."""
    rows, following, n = iter(rows), "u", 0
    for edit in audit:
        if edit != "I":
            role, text = next(rows)
            if edit == "D":
                continue
        if edit == "K":
            began = n == 0 and role[:1] == "s"
        else:
            role, began = REROLED[following], False
            text = "" if edit == "I" else text
        yield role, text, edit
        n += 1
        if not began:
            following = "a" if following == "u" else "u"


def marked(rows: DataFrame) -> DataFrame:
    """Adds to (key, turn, role, text): ``digest``, ``role_class`` and ``state`` (duplicates count as whole or truncated yet)."""
    visible = F.rtrim(F.col("text"), F.lit(SPACE))
    state = F.when(visible == "", 2).when(F.substring(visible, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.withColumns({"digest": digest(F.col("role"), F.col("text")), "role_class": role, "state": state})


def symbol_strings(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``key``, ``symbols`` (one letter a row) and ``gaps`` of each conversation of ``rows`` (key, turn, role, text)."""
    narrow = marked(rows).select("key", "turn", "role", "digest", "role_class", "state")
    turns = scratch.table("turns", positions(narrow, "key").select("key", "pos", "turn", "digest", "role_class", "state"))
    ordinal = F.col("role_class") * len(STATES) + ord("A")
    again = F.when(F.col("state") == 2, 2).otherwise(3)
    places = turns.select("key", "pos", F.lit(1).alias("kind"), F.char(ordinal + F.col("state")).alias("first"), F.char(ordinal + again).alias("again"))
    firsts = turns.groupBy("key", "digest").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(0).alias("kind"), F.lit("").alias("first"), F.lit("").alias("again"))
    stretch = F.floor(F.col("pos") / PLACES).alias("stretch")
    listed = places.unionByName(firsts).groupBy("key", stretch).agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "first", "again"))).alias("rows"))
    told = F.expr("transform(rows, (x, i) -> CASE WHEN x.kind = 0 THEN '' WHEN i > 0 AND rows[i - 1].kind = 0 THEN x.first ELSE x.again END)")
    pieces = listed.select("key", "stretch", F.array_join(told, "").alias("piece"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("stretch", "piece"))), lambda x: x["piece"])
    symbols = pieces.groupBy("key").agg(F.array_join(whole, "").alias("symbols"))
    gaps = turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    return symbols.join(gaps, "key", "left")


def audits(symbols: DataFrame) -> DataFrame:
    """Counts, ``cost`` and ``audit`` of each row of (key, conv_id, gaps, symbols)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(parse)
        for batch in batches:
            strings = batch.column("symbols").to_pylist()
            counts = [tallies(s) for s in strings]
            parsed = [known[s] if len(s) <= REMEMBERED else parse(s) for s in strings]
            long = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            columns = [batch.column("key"), batch.column("conv_id"), batch.column("gaps"), *long, pa.array([c for c, _ in parsed], pa.int64()), pa.array([a for _, a in parsed], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return symbols.select("key", "conv_id", "gaps", "symbols").mapInArrow(run, "key string, conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


FOUND = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def by_conversation(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """(audit row, its texts) of sorted batches; texts that are not taken are skipped."""
    def flat() -> Iterator[dict]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                yield from batch.slice(start, 512).to_pylist()

    rows = flat()
    ahead = next(rows, None)

    def texts() -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while (ahead := next(rows, None)) is not None and ahead["audit"] is None:
            yield ahead["role"], ahead["text"]

    while ahead is not None:
        found, own = ahead, texts()
        yield found, own
        for _ in own:
            pass


def repair(rows: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns) of ``rows`` (conv_id, turn, role, text without nulls in role and text).

    Every distinct conv_id of ``conversations`` is reported, null being one of them; one without rows has zeros,
    an empty audit and the hash of nothing.  ``report``: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost``, ``audit``, ``repaired_sha256``.  ``turns``: ``conv_id``, ``place``, ``role``, ``text``, ``edit`` of what the
    repair leaves.  Rows are ordered by turn (null first), role and digest; equal rows are duplicates of each other.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    rows = rows.select(key.alias("key"), "turn", "role", "text")
    everyone = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn("key", key)
    strings = everyone.join(symbol_strings(rows, scratch), "key", "left")
    found = scratch.table("audits", audits(strings.fillna({"gaps": 0, "symbols": ""})))
    heads = found.select("key", F.lit(0).alias("kind"), *FOUND, *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("digest", "binary"), ("text", "string"))))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in found.select(*FOUND).dtypes]
    texts = marked(rows).select("key", F.lit(1).alias("kind"), *nothing, "turn", "role", "digest", "text")
    order = ["key", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = heads.unionByName(texts).repartition("key").sortWithinPartitions(*order).select(*FOUND, "role", "text")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for found, own in by_conversation(batches):
            state = hashlib.sha256()
            for n, (role, text, _) in enumerate(edited(own, found["audit"])):
                state.update(("\n" * (n > 0) + role + ":" + text).encode("utf-8", "surrogatepass"))
            done.append({c: found[c] for c in FOUND} | {"repaired_sha256": state.hexdigest()})
            if len(done) == 1024:
                yield pa.RecordBatch.from_pylist(done, schema=report_schema)
                done = []
        yield pa.RecordBatch.from_pylist(done, schema=report_schema)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, own in by_conversation(batches):
            done = []
            for n, (role, text, edit) in enumerate(edited(own, found["audit"])):
                done.append({"conv_id": found["conv_id"], "place": n, "role": role, "text": text, "edit": edit})
                if len(done) == 256:
                    yield pa.RecordBatch.from_pylist(done, schema=turns_schema)
                    done = []
            yield pa.RecordBatch.from_pylist(done, schema=turns_schema)

    report_schema = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in FOUND] + [("repaired_sha256", pa.string())])
    turns_schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    report = dealt.mapInArrow(hashed, ", ".join(f"{c} {'string' if c == 'audit' else 'bigint'}" for c in FOUND) + ", repaired_sha256 string")
    return report, dealt.mapInArrow(kept, "conv_id bigint, place bigint, role string, text string, edit string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults that the hash of a row's ids decides: rows lost, emptied, without end marks, repeated, of another role.

    A null counts as one space, in the hash too.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), word("role").alias("role"), word("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")

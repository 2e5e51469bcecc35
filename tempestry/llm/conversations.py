"""Operator 11: repair of a conversation's structure, by a scan of min-plus matrices.

1. Rows without their texts are put in order of conversation and turn by a range sort, which gives each a place; runs of
   RUN places are as much as a task holds of a conversation at once. Duplicates are known by the first place of their
   role and text. Each row is then a letter: its role's initial and its fault.
2. The states of an output are nothing yet, s, u and a. A letter is a 4x4 matrix of (cost, audit): what the cheapest
   edit of this row costs from one state to another and how it is written, with the closure of inserts before it. Sums
   of costs and concatenation multiply, the smaller (cost, audit) adds. Equally cheap audits of the same rows are never
   prefixes of each other, so the smallest one goes on being the smallest whatever follows, and the product is
   associative.
3. A run's letters are multiplied as a tree, the runs of a conversation by FAN at a time until one matrix is left, a
   shuffle for each level. Only conversations of several runs go through levels.
4. The texts meet their conversation's audit in one sorted pass, which holds a row and the audit. A conversation's text
   is read by one task there: a hash of all of it can't be had in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm import common

#: Rows of one run, as a power of two; matrices multiplied by a task of the tree.
RUN_BITS, FAN = 12, 16
#: Rows and bytes of text of an output batch.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 22
ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]

#: States: nothing yet, after s, after u, after a. An output may end in the first and the last.
START, S, U, A = range(4)
ENDS = (START, A)
#: Where each initial leads, from the states that it may follow.
MOVES = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
#: A row's letter: initial (x: another), as it is, truncated, blank, duplicate.
LETTERS = ("suax", "SUAX", "1234", "5678")
INITIAL = {c: "suax"[i] for kind in LETTERS for i, c in enumerate(kind)}
LEGAL = ("su", "ua", "au")


def better(x: Element, y: Element) -> Element:
    return x if y is None or (x is not None and x <= y) else y


def times(x: Matrix, y: Matrix) -> Matrix:
    """Concatenations are made for the cheapest ways only."""
    out: list[Element] = []
    for i in range(4):
        row = x[4 * i : 4 * i + 4]
        for j in range(4):
            ways = [(a[0] + b[0], a, b) for a, b in zip(row, y[j::4], strict=True) if a is not None and b is not None]
            least = min((w[0] for w in ways), default=None)
            out.append(None if least is None else (least, min(a[1] + b[1] for cost, a, b in ways if cost == least)))
    return tuple(out)


def matrix(entries: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(entries.get((i, j)) for i in range(4) for j in range(4))


IDENTITY = matrix({(i, i): (0, "") for i in range(4)})
_ONE_INSERT = matrix({(i, i): (0, "") for i in range(4)} | {(i, j): (INSERT, "I") for c in ROLES for i, j in MOVES[c].items()})
#: Any number of inserts; after two, every state that inserts lead to has been reached.
CLOSURE = times(_ONE_INSERT, _ONE_INSERT)


@lru_cache(maxsize=None)  # as many as there are letters
def letter_matrix(letter: str) -> Matrix:
    initial = INITIAL[letter]
    ways: dict[tuple[int, int], Element] = {(i, i): (DELETE, "D") for i in range(4)}
    if letter in "suaxSUAX":
        extra = TRUNCATED if letter.isupper() else 0
        edits = [(initial, extra, "K")] * (initial in MOVES) + [(c, extra + REROLE, "R") for c in ROLES]
        for c, cost, name in edits:
            for i, j in MOVES[c].items():
                ways[i, j] = better(ways.get((i, j)), (cost, name))
    return times(CLOSURE, matrix(ways))


def tree(matrices: Sequence[Matrix]) -> Matrix:
    """The product, by neighbours, so that audits are copied once a level."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else IDENTITY


@lru_cache(maxsize=50_000)
def piece_matrix(letters: str) -> Matrix:
    return tree([letter_matrix(c) for c in letters])


def run_matrix(letters: str, piece: int = 8) -> Matrix:
    return tree([piece_matrix(letters[i : i + piece]) for i in range(0, len(letters), piece)])


def cheapest(product: Matrix) -> tuple[int, str]:
    """From nothing to a state where an output may end, with inserts after the last row."""
    last = times(product, CLOSURE)[:4]
    return reduce(better, (last[j] for j in ENDS))  # type: ignore[return-value]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as op11's contract spoils them, by crc32 of conv_id:turn modulo 20.

    0 drops a row, 1 empties its text, 2 takes . ! ? out of it, 3 repeats it, 4 makes its role user. Nulls are one
    space, in the crc too, but a null conv_id is a conversation of its own and a null turn stays without a place.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("fault")
    seen = rows.select(F.col("conv_id"), F.col("turn"), one("role").alias("role"), one("text").alias("text"), fault).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times_ = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return seen.select("conv_id", "turn", role.alias("role"), text.alias("text"), times_.alias("copy")).drop("copy")


def prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, h: the rows with nulls as one space, and the hash that orders equal turns and roles."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text")).withColumn("h", F.xxhash64("text"))


ORDER = ("turn", "role", "h")


def lettered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place, letter of each row; a written table of the rows in order lies below it."""
    body = F.btrim("text", F.lit(common.ASCII_SPACE))
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv_id", *ORDER, F.xxhash64(F.lit(7), "text").alias("h2"), F.monotonically_increasing_id().alias("salt"),
        (F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)).alias("initial"),
        F.when(body == "", "blank").when(~F.endswith(body, F.lit(".")) & ~F.endswith(body, F.lit("!")) & ~F.endswith(body, F.lit("?")), "truncated").otherwise("").alias("fault"),
    )
    # the salt splits rows that are equal in everything; their order doesn't matter
    order = ["conv_id", *ORDER, "salt"]
    spread = narrow.repartitionByRange(common.partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = common.written(spread.withColumn("place", F.monotonically_increasing_id()).drop("salt"), "turns")
    firsts = placed.where("fault != 'blank'").groupBy("conv_id", "role", "h", "h2").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = placed.join(firsts, "place", "left")
    kind = F.when(F.col("fault") == "blank", LETTERS[2]).when(F.col("first").isNull(), LETTERS[3]).when(F.col("fault") == "truncated", LETTERS[1]).otherwise(LETTERS[0])
    return marked.select("conv_id", "turn", "place", F.substring(kind, F.col("initial"), F.lit(1)).alias("letter"))


FIGURES = ("blank", "duplicate", "truncated", "illegal", "gaps", "cost")


def counted(letters: str, before: str | None) -> tuple[int, int, int, int]:
    """Rows by fault, and pairs of neighbours that no conversation has; before is the last letter of the run before."""
    said = [INITIAL[c] for c in (before or "") + letters]
    faults = [sum(map(letters.count, kind)) for kind in (LETTERS[2], LETTERS[3], LETTERS[1])]
    return (*faults, sum(x + y not in LEGAL for x, y in zip(said, said[1:], strict=False)))


MATRIX = "costs array<long>, audits array<string>"
_COSTS, _AUDITS = pa.list_(pa.int64()), pa.list_(pa.string())


def unpacked(m: Matrix | None) -> tuple[list | None, list | None]:
    return (None, None) if m is None else ([e and e[0] for e in m], [e and e[1] for e in m])


def packed(costs: list, audits: list) -> Matrix:
    return tuple(None if c is None else (c, a) for c, a in zip(costs, audits, strict=True))


def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run's counts, and its matrix; of a conversation of one run the cheapest audit instead."""
    for batch in batches:
        figures, answers, matrices = [], [], []
        for letters, before, runs in zip(*(batch.column(c).to_pylist() for c in ("letters", "before", "runs")), strict=True):
            product = run_matrix(letters)
            figures.append(counted(letters, before))
            answers.append(cheapest(product) if runs == 1 else (None, None))
            matrices.append(unpacked(product if runs > 1 else None))
        columns = [pa.array(x, pa.int64()) for x in zip(*figures, strict=True)]
        (costs, audits), (m_costs, m_audits) = zip(*answers, strict=True), zip(*matrices, strict=True)
        kept = [batch.column(c) for c in ("conv_id", "k", "runs")]
        yield pa.RecordBatch.from_arrays(
            [*kept, *columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(m_costs, _COSTS), pa.array(m_audits, _AUDITS)],
            ["conv_id", "k", "runs", *FIGURES[:4], "cost", "audit", "costs", "audits"],
        )


def merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring matrices of one conversation, in order, as their product."""
    for batch in batches:
        products = [unpacked(tree([packed(p["costs"], p["audits"]) for p in parts])) for parts in batch.column("parts").to_pylist()]
        costs, audits = zip(*products, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("k"), pa.array(costs, _COSTS), pa.array(audits, _AUDITS)], ["conv_id", "k", "costs", "audits"])


def answer_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        answers = [cheapest(packed(*m)) for m in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist(), strict=True)]
        costs, audits = zip(*answers, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["conv_id", "cost", "audit"])


def plans(rows: DataFrame, known: DataFrame | None = None, run_bits: int = RUN_BITS, fan: int = FAN) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit of each conversation of rows and of known.

    rows: conv_id, turn, role, text; known: a conv_id each, for conversations that may have no row. Other columns are
    ignored. A conversation's rows go by turn, nulls first; rows of one turn by role, then by the hash of their text.
    Rows without a conv_id are one conversation, of conv_id null. Null roles and texts are one space, so such a text is
    blank and such a role has to be edited. Repeated rows are duplicates, or blank. No rows: zeros and an empty audit.
    """
    common.short_batches(rows.sparkSession)
    letters = lettered(prepared(rows))
    run = F.shiftright("place", run_bits)
    texts = letters.groupBy("conv_id", run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "letter"))).alias("x"))
    texts = texts.select("conv_id", "run", F.array_join("x.letter", "").alias("letters"))
    ordered = Window.partitionBy("conv_id").orderBy("run")  # a row for each run
    numbered = texts.select("conv_id", (F.row_number().over(ordered) - 1).cast("long").alias("k"), F.count("*").over(Window.partitionBy("conv_id")).alias("runs"), F.lag(F.right("letters", F.lit(1))).over(ordered).alias("before"), "letters")
    figures = ", ".join(f"{c} long" for c in (*FIGURES[:4], "cost"))
    runs = common.written(numbered.mapInArrow(run_task, f"conv_id long, k long, runs long, {figures}, audit string, {MATRIX}"), "runs")

    nodes = runs.where("runs > 1").select("conv_id", "k", "costs", "audits")
    left = runs.agg(F.max("runs")).first()[0] or 0
    while left > 1:
        grouped = nodes.groupBy("conv_id", F.floor(F.col("k") / fan).alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "costs", "audits"))).alias("parts"))
        nodes = grouped.mapInArrow(merge_task, f"conv_id long, k long, {MATRIX}")
        left = -(-left // fan)
    roots = nodes.mapInArrow(answer_task, "conv_id long, cost long, audit string")

    turns = letters.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    parts = [runs.select("conv_id", *FIGURES[:4], "cost", "audit"), roots, turns]
    parts += [known.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()] if known is not None else []
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return every.groupBy("conv_id").agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in FIGURES), F.coalesce(F.max("audit"), F.lit("")).alias("audit"))


class Output:
    """One conversation's outputs, row by row, from its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def next_role(self) -> str:
        return "a" if self.state == U else "u"

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.put("I", self.next_role(), ROLES[self.next_role()], "")

    def put(self, edit: str, initial: str, role: str, text: str) -> tuple[str, str, str]:
        self.at, self.state = self.at + 1, MOVES[initial][self.state]
        return edit, role, text

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the inserts before this row and of the row, if it stays."""
        yield from self.inserts()
        edit = self.audit[self.at]
        if edit == "K":
            yield self.put("K", role[0], role, text)
        elif edit == "R":
            yield self.put("R", self.next_role(), ROLES[self.next_role()], text)
        else:
            self.at += 1


def in_order(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, conversations whole in a task."""
    spark = rows.sparkSession
    common.short_batches(spark)
    heads = planned.withColumn("kind", F.lit(0))
    both = heads.unionByName(prepared(rows).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(common.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, position, edit, turn, role, text of the repaired conversations: rows kept (K) or with another role (R),
    and inserts (I), which have no turn and an empty text. rows and planned as in plans(), of the same rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, n, conv, output = [], 0, 0, None, Output("")
        put = lambda items, turn: out.extend((conv, n + i, edit, turn if edit != "I" else None, role, text) for i, (edit, role, text) in enumerate(items))
        for batch in batches:
            for kind, conv_id, turn, role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("kind", "conv_id", "turn", "role", "text", "audit")), strict=True):
                before = len(out)
                if kind == 0:
                    put(output.inserts(), None)
                    conv, n, output, before = conv_id, 0, Output(audit), len(out)
                else:
                    put(output.row(role, text), turn)
                n, held = n + len(out) - before, held + len(text or "")
                if len(out) >= BATCH_ROWS or held > BATCH_BYTES:
                    yield output_batch(out)
                    out, held = [], 0
        put(output.inserts(), None)
        yield output_batch(out)

    return in_order(rows, planned).mapInArrow(task, "conv_id long, position long, edit string, turn long, role string, text string")


def output_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"conv_id": pa.int64(), "position": pa.int64(), "edit": pa.string(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))


def digest(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """planned with repaired_sha256: the hash of the repaired role:text lines, joined by \\n."""

    plan = list(planned.columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, output, fresh = None, hashlib.sha256(), Output(""), True

        def add(items: Iterator[tuple[str, str, str]]) -> None:
            nonlocal fresh
            for _, role, text in items:
                sha.update(("" if fresh else "\n").encode() + f"{role}:{text}".encode())
                fresh = False

        def ended() -> list[tuple]:
            add(output.inserts())
            return [] if head is None else [(*head, sha.hexdigest())]

        for batch in batches:
            done, columns = [], {c: batch.column(c).to_pylist() for c in ("kind", "role", "text", *plan)}
            for i, kind in enumerate(columns["kind"]):
                if kind == 0:
                    done += ended()
                    head, sha, fresh = tuple(columns[c][i] for c in plan), hashlib.sha256(), True
                    output = Output(columns["audit"][i])
                else:
                    add(output.row(columns["role"][i], columns["text"][i]))
            yield of(done)
        yield of(ended())

    names = [*plan, "repaired_sha256"]
    types = [pa.string() if c in ("audit", "repaired_sha256") else pa.int64() for c in names]
    of = lambda done: pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
    return in_order(rows, planned).mapInArrow(task, ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in zip(names, types, strict=True)))


def oracle_sql() -> str:
    """The digest in DuckDB's SQL, row by row for each conversation, without matrices; rows have distinct conv_id and turn.

    A way is its cost in nine digits and its audit, so that ways compare as texts; NULL is none.
    """
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(k) + 1), lambda i: ascii(substr(k, i::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, j: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    add = lambda x, cost, edit: f"CASE WHEN {x} IS NOT NULL THEN lpad((substr({x}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{edit}' END"
    least = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda way: way IS NOT NULL))"
    into_u = least("u", add("z", INSERT, "I"), add("s", INSERT, "I"), add("a", INSERT, "I"))
    into_a = least("a", add("u", INSERT, "I"), add("z", 2 * INSERT, "II"), add("s", 2 * INSERT, "II"))
    more = f"(CASE WHEN kind = 'truncated' THEN {TRUNCATED} ELSE 0 END)"
    kept, free = lambda x, c: f"CASE WHEN NOT gone AND initial = '{c}' THEN {add(x, more, 'K')} END", lambda x: f"CASE WHEN NOT gone THEN {add(x, f'{REROLE} + {more}', 'R')} END"
    return rf"""
    WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    faults AS (SELECT *, {crc} % 20 AS fault FROM named),
    rows_ AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM faults, range(0, 2) c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM rows_),
    kinds AS (SELECT *, substr(role, 1, 1) AS initial, trim(text, {space}) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS seen FROM placed),
    lines AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind, body = '' OR seen > 1 AS gone,
      lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM kinds),
    ways AS (SELECT DISTINCT conv_id, 0::BIGINT AS rn, '000000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM lines
      UNION ALL SELECT conv_id, rn, {add("z", DELETE, "D")}, {least(add("s", DELETE, "D"), kept("z", "s"))}, {least(add("into_u", DELETE, "D"), kept("free_u", "u"), free("free_u"))}, {least(add("into_a", DELETE, "D"), kept("into_u", "a"), free("into_u"))}
      FROM (SELECT *, {least("z", "s", "into_a")} AS free_u FROM (SELECT w.conv_id, l.rn, l.initial, l.kind, l.gone, z, s, {into_u} AS into_u, {into_a} AS into_a FROM ways w JOIN lines l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.rn = w.rn + 1))),
    best AS (SELECT conv_id, {least("z", into_a)} AS way FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) AS last FROM ways) WHERE last = 1),
    edits AS (SELECT conv_id, i, substr(substr(way, 10), i::INT, 1) AS edit FROM best, LATERAL (SELECT unnest(range(1, strlen(way) - 8)) AS i)),
    used AS (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS rn FROM edits),
    outs AS (SELECT u.conv_id, i, edit, l.role, l.text, row_number() OVER (PARTITION BY u.conv_id ORDER BY i) AS o FROM used u LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM u.conv_id AND l.rn = u.rn AND edit <> 'I' WHERE edit <> 'D'),
    turns AS (SELECT *, max((o = 1 AND edit = 'K' AND role[1] = 's')::INT) OVER (PARTITION BY conv_id) AS lead FROM outs),
    texts AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS sha FROM turns GROUP BY 1),
    counts AS (SELECT conv_id, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated,
      count(*) FILTER (rn > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM lines GROUP BY 1),
    every AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT e.conv_id, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(gaps, 0)::BIGINT AS gaps,
      coalesce(substr(way, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(way, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM every e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id"""

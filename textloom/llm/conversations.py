"""Repair of the structure of conversations: the cheapest edits after which roles alternate.

A conversation is its rows by turn (null turns first; rows of one turn by role, then by the digest of their text).
A row's fault is the first that holds: blank (nothing but white space), duplicate (role and text of an earlier
row of the conversation), truncated (the last character that isn't white space ends no sentence).

1. Each conversation becomes a signature: a letter for each row that says whether its role begins with
   ``s``, ``u``, ``a`` or something else (a capital where it is truncated), or that it has to go.
2. Each distinct signature is solved once, from its end backwards: what a rest of it costs from each state of the
   wanted pattern follows from its first letter and the costs of what comes after. That step is remembered by
   letter and cost differences, of which there are few, so all signatures of a task share them. Each kind of
   edit has its own letter, so of edits equally cheap the smallest letter decides.
3. The edits go back to the conversations by a join, and each replays them over its rows.

Rows stream through the tasks by conversation and place. A task holds a conversation's letters and 32 bytes for each distinct row, never its
texts: these go into the hash as they pass. A result holds a string of letters for each conversation, so the rows of one
pass one task; signatures are combined before their shuffle, and common ones are solved once.

Defined cases: null roles and texts count as one blank, null ids and turns as one blank where the damage is chosen; rows with a null
conv_id make one conversation; rows alike in all columns are rows each, the later ones duplicates; a conversation without
rows has no faults and the hash of the empty text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import saved, table
from textloom.llm.runs import CRC32_OF, CRC32_SQL

#: A row that has to go; otherwise its role's initial, or OTHER, in capitals where the row is truncated.
GONE, OTHER = "x", "o"
#: The pattern (s?(ua)+)? as states (nothing yet, after s, u, a): the state that a role leads to.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: What edits cost, by their letters; a truncated row that stays costs one more.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: Roles that edits give.
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 60
FAULTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def given(state: int) -> str:
    """The role that an inserted or changed row gets in a state: the only one there that edits give."""
    return next(r for r in STEPS[state] if r in ROLES)


class Solver:
    """The cheapest edits of signatures. What it remembers is bounded by the letters and the cost differences, which are small numbers."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.end = self._settled([{KEEP: 0} if s in ENDS else {} for s in range(4)])

    def _settled(self, own: list[dict[str, int]]) -> tuple[tuple[int, ...], tuple[str, ...]]:
        """(costs, letters) of the states, given the costs of all edits but insertions; two insertions in a row reach all that can be reached."""
        least = [min(o.values(), default=NEVER) for o in own]
        best = list(least)
        for _ in range(2):
            best = [min(least[s], COST[INSERT] + best[STEPS[s][given(s)]]) for s in range(4)]
        letters = [min(e for e, c in (*own[s].items(), (INSERT, COST[INSERT] + best[STEPS[s][given(s)]])) if c == best[s]) for s in range(4)]
        return tuple(best), tuple(letters)

    def before(self, letter: str, rest: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
        """(costs, letters) of the states in front of a row, given those behind it."""
        low = min(rest)
        key = (letter, tuple(c - low for c in rest))
        if key not in self.known:
            self.known[key] = self._settled([self._edits(letter, s, key[1]) for s in range(4)])
        costs, letters = self.known[key]
        return tuple(c + low for c in costs), letters

    @staticmethod
    def _edits(letter: str, state: int, rest: tuple[int, ...]) -> dict[str, int]:
        own = {DELETE: COST[DELETE] + rest[state]}
        if letter != GONE:
            extra, role = int(letter.isupper()), letter.lower()
            own[REROLE] = extra + COST[REROLE] + rest[STEPS[state][given(state)]]
            if role in STEPS[state]:
                own[KEEP] = extra + COST[KEEP] + rest[STEPS[state][role]]
        return own

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, letters of the edits) of a signature."""
        costs, plan = self.end[0], [self.end[1]]
        for letter in reversed(signature):
            costs, letters = self.before(letter, costs)
            plan.append(letters)
        plan.reverse()
        out, state, at = [], 0, 0
        while at < len(signature) or state not in ENDS:
            edit = plan[at][state]
            out.append(edit)
            if edit == INSERT:
                state = STEPS[state][given(state)]
                continue
            if edit != DELETE:
                state = STEPS[state][signature[at].lower() if edit == KEEP else given(state)]
            at += 1
        return costs[0], "".join(out)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and there (false: dropped) after the damage that each row's id and turn choose."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    found = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("how"))
    how = F.col("how")
    found = found.withColumns({"text": F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(how == 4, "user").otherwise(F.col("role"))})
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(how == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text", (how != 0).alias("there"))


def as_rows(rows: DataFrame) -> DataFrame:
    """The rows as they are, all there, with nulls as one blank."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(True).alias("there"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of FAULTS and signature of each conversation of rows (conv_id, turn, role, text, there)."""
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    ended = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    thin = rows.select("conv_id", "turn", "role", _digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~ended).alias("cut"), "there")
    kind = dict(rows.dtypes)["conv_id"]

    def told(conv, turns, counts, letters):
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return conv, gaps, *counts, "".join(letters)

    def run(batches):
        conv, begun = None, False
        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in ("turn", "digest", "initial", "blank", "cut", "there")]
            for key, turn, digest, initial, empty, cut, there in zip(b.column("conv_id").to_pylist(), *columns, strict=True):
                if not begun or key != conv:
                    if begun:
                        out.append(told(conv, turns, counts, letters))
                    conv, begun, turns, counts, letters, seen, last = key, True, None, [0, 0, 0, 0], [], set(), None
                if not there:
                    continue
                if turn is not None and (turns is None or turn != turns[1]):
                    turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + 1)
                if last is not None and last + initial not in ("su", "ua", "au"):
                    counts[3] += 1
                last = initial
                fault = 0 if empty else 1 if digest in seen else 2 if cut else None
                seen.add(digest)
                if fault is not None:
                    counts[fault] += 1
                role = initial if initial in ("s", "u", "a") else OTHER
                letters.append(GONE if fault in (0, 1) else role.upper() if fault == 2 else role)
            id_type = b.schema.field("conv_id").type
            yield batch(out, id_type)
        if begun:
            yield batch([told(conv, turns, counts, letters)], id_type)

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]

    def batch(out, id_type):
        cols = list(zip(*out, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [id_type, *[pa.int64()] * 5, pa.string()], strict=True)], names)

    return _by_conversation(thin, "turn", "role", "digest").mapInArrow(run, f"conv_id {kind}, {FAULTS}, signature string")


def solved(found: DataFrame) -> DataFrame:
    """signature, cost and audit of each distinct signature."""

    def run(batches):
        solver = Solver()
        for b in batches:
            answers = [solver.solve(s) for s in b.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array([c for c, _ in answers], pa.int64()), pa.array([a for _, a in answers], pa.string())], ["signature", "cost", "audit"])

    return found.select("signature").distinct().mapInArrow(run, "signature string, cost long, audit string")


class Replay:
    """The edits of one conversation over its rows as they pass; take() gets each repaired (role, text)."""

    def __init__(self, audit: str, take) -> None:
        self.audit, self.at, self.state, self.take = audit, 0, 0, take

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self._stays(given(self.state), ROLES[given(self.state)], "")

    def _stays(self, initial: str, role: str, text: str) -> None:
        self.state = STEPS[self.state][initial]
        self.at += 1
        self.take(role, text)

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        if edit == DELETE:
            self.at += 1
        elif edit == KEEP:
            self._stays(role[0], role, text)
        else:
            self._stays(given(self.state), ROLES[given(self.state)], text)

    def end(self) -> None:
        self._inserted()


class _Sha256:
    """The hash of role:text lines, joined by line feeds."""

    def __init__(self) -> None:
        self.hash, self.lines = hashlib.sha256(), 0

    def take(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """audits (a row for each conversation of rows: conv_id, counts, cost, audit) with repaired_sha256."""
    names = [c for c in audits.columns if c != "conv_id"]
    head = audits.select("conv_id", F.lit(0).alias("part"), F.struct(*names).alias("told"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", dict(rows.dtypes)["turn"]), ("role", "string"), ("digest", "binary"), ("text", "string"))))
    body = rows.where("there").select("conv_id", F.lit(1).alias("part"), F.lit(None).cast(head.schema["told"].dataType).alias("told"), "turn", "role", _digest().alias("digest"), "text")

    def run(batches):
        told = replay = None
        for b in batches:
            ids, facts = [], []
            columns = [b.column(c).to_pylist() for c in ("conv_id", "part", "told", "role", "text")]
            for key, part, facts_of, role, text in zip(*columns, strict=True):
                if part:
                    replay.row(role, text)
                    continue
                if told is not None:
                    replay.end()
                    ids.append(told[0])
                    facts.append(told[1] | {"repaired_sha256": sink.hash.hexdigest()})
                sink = _Sha256()
                told, replay = (key, facts_of), Replay(facts_of["audit"], sink.take)
            kinds = (b.schema.field("conv_id").type, b.schema.field("told").type)
            yield batch(ids, facts, *kinds)
        if told is not None:
            replay.end()
            yield batch([told[0]], [told[1] | {"repaired_sha256": sink.hash.hexdigest()}], *kinds)

    def batch(ids, facts, id_type, told_type):
        arrays = [pa.array([f[c] for f in facts], told_type.field(c).type) for c in names]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *arrays, pa.array([f["repaired_sha256"] for f in facts], pa.string())], ["conv_id", *names, "repaired_sha256"])

    kinds = dict(audits.dtypes)
    return _by_conversation(head.unionByName(body), "part", "turn", "role", "digest").mapInArrow(run, f"conv_id {kinds['conv_id']}, " + ", ".join(f"{c} {kinds[c]}" for c in names) + ", repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text, there): counts of FAULTS, cost, audit, repaired_sha256."""
    found = saved(signatures(rows), "signatures")
    audits = saved(found.join(solved(found), "signature").drop("signature"), "audits")
    return replayed(rows, audits)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def _more_sql(cost: str, letter: str, rest: str) -> str:
    """A path in SQL: its cost in nine digits, then its letters; smaller texts are better paths."""
    return f"(printf('%09d', left({rest}, 9)::BIGINT + {cost}) || '{letter}' || substr({rest}, 10))"


ORACLE_SQL = f"""
WITH RECURSIVE {CRC32_SQL},
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {CRC32_OF.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS how FROM conversations, crc_table),
d AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
             CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM r, range(2) c(k) WHERE how <> 0 AND (k = 0 OR how = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM d),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS last,
             CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 0 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 1
                  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 2 END AS fault FROM n),
l AS MATERIALIZED (SELECT *, CASE WHEN fault < 2 THEN 'x' WHEN fault = 2 THEN upper(CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END)
             WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS letter FROM f),
c AS MATERIALIZED (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate,
             count(*) FILTER (fault = 2) AS truncated, count(*) FILTER (last || initial NOT IN ('su', 'ua', 'au')) AS illegal, string_agg(letter, '' ORDER BY i) AS signature FROM l GROUP BY conv_id),
p(signature, k, r0, r1, r2, r3) AS (
    SELECT DISTINCT signature, length(signature), '000000000', '000000004II', '000000002I', '000000000' FROM c
    UNION ALL
    SELECT signature, k, least(o0, {_more_sql("2", "I", "b2")}), least(o1, {_more_sql("2", "I", "b2")}), least(o2, {_more_sql("2", "I", "b3")}), least(o3, {_more_sql("2", "I", "b2")})
    FROM (SELECT *, least(o2, {_more_sql("2", "I", "o3")}) AS b2, least(o3, {_more_sql("2", "I", "o2")}) AS b3 FROM (
        SELECT signature, k,
            least({_more_sql("3", "D", "r0")}, CASE WHEN go THEN {_more_sql("2 + cut", "R", "r2")} END, CASE role WHEN 's' THEN {_more_sql("cut", "K", "r1")} WHEN 'u' THEN {_more_sql("cut", "K", "r2")} END) AS o0,
            least({_more_sql("3", "D", "r1")}, CASE WHEN go THEN {_more_sql("2 + cut", "R", "r2")} END, CASE role WHEN 'u' THEN {_more_sql("cut", "K", "r2")} END) AS o1,
            least({_more_sql("3", "D", "r2")}, CASE WHEN go THEN {_more_sql("2 + cut", "R", "r3")} END, CASE role WHEN 'a' THEN {_more_sql("cut", "K", "r3")} END) AS o2,
            least({_more_sql("3", "D", "r3")}, CASE WHEN go THEN {_more_sql("2 + cut", "R", "r2")} END, CASE role WHEN 'u' THEN {_more_sql("cut", "K", "r2")} END) AS o3
        FROM (SELECT signature, k - 1 AS k, r0, r1, r2, r3, lower(signature[k]) AS role, signature[k] <> 'x' AS go, (signature[k] <> lower(signature[k]))::INT AS cut FROM p WHERE k > 0)))),
a AS MATERIALIZED (SELECT conv_id, left(r0, 9)::BIGINT AS cost, substr(r0, 10) AS audit FROM c JOIN p USING (signature) WHERE k = 0),
w(conv_id, audit, j, i, state, line) AS (
    SELECT conv_id, audit, 0, 0, 0, NULL::VARCHAR FROM a
    UNION ALL
    SELECT w.conv_id, audit, j + 1, CASE WHEN e = 'I' THEN w.i ELSE w.i + 1 END,
           CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN CASE l.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
           CASE e WHEN 'D' THEN NULL WHEN 'K' THEN l.role || ':' || l.text ELSE CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN l.text ELSE '' END END
    FROM (SELECT *, audit[j + 1] AS e FROM w WHERE j < length(audit)) w LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1),
s AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS t FROM w GROUP BY conv_id),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM o LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON o.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
"""

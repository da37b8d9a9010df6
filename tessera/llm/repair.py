"""Repair of conversation structure by a least-cost fold over turns.

A conversation is sound if the initials of its roles are `(s?(ua)+)?`.  Faults are
flagged by windows: blank turns, turns whose role and text were seen earlier, and
turns that end without a mark.  One aggregate() over the sorted turns then carries,
for each of the four states (nothing yet, after s, after u, after a), the struct of
the least cost and its audit, the edits' initials; least() picks by cost and then by
the audit.  Two audits of equal cost that reach one state never are each other's
beginnings (each symbol has the cost of the turn it takes, and an insertion is not
free), so picking early is exact.

    K keep 0, R other role (user or assistant) 2, D delete 3, I insert an empty turn 2;
    blank turns and duplicates are deleted; a truncated turn that stays adds 1

A conversation is cut into blocks of `block` turns.  Blocks but the first are folded
from each of the four states, and a second fold chains them: it carries for each
state the cost, the rank of its audit among the four and the states it came from, so
no text grows with the conversation.  One row then holds about 200 bytes for each
block of a conversation.

Rows are taken by turn, nulls first, then by role and text.  Null roles and texts
are one space, hence a null text is blank and a null role has to be changed or
deleted.  Roles count by their initials: `ux` passes as u.  Null identifiers are one
conversation.  Repeated rows are duplicates.  No rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved
from .turns import CRC_TABLE, conversations, crc_sql, folded, key_of, placed

SPACE = " \t\n\x0b\x0c\r"
#: More than any repair costs.
FAR = 1 << 60
STATES = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


@dataclass(frozen=True)
class Settings:
    block: int = 512


def _plus(path: Column, cost, sign: str | Column) -> Column:
    sign = F.lit(sign) if isinstance(sign, str) else sign
    return F.struct((path["cost"] + cost).alias("cost"), F.concat(path["audit"], sign).alias("audit"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _states(paths: list[Column]) -> Column:
    return F.struct(*(p.alias(f"s{i}") for i, p in enumerate(paths)))


def _inserted(acc: Column) -> Column:
    """The states with the insertions before a turn: a user after nothing, s or a, an assistant after u."""
    before = [acc[f"s{i}"] for i in range(STATES)]
    user = F.least(before[2], *(_plus(before[i], INSERT, "I") for i in (0, 1, 3)))
    return _let(user, lambda u: _states([before[0], before[1], u, F.least(before[3], _plus(u, INSERT, "I"))]))


def _taken(acc: Column, turn: Column) -> Column:
    """The states after a turn (initial, must: has to go, cut: truncated)."""
    at = [acc[f"s{i}"] for i in range(STATES)]
    left = [_plus(p, DELETE, "D") for p in at]
    more = F.when(turn["cut"], TRUNCATED).otherwise(0)

    def put(path: Column, initial: str) -> Column:
        same = turn["initial"] == initial
        return F.when(~turn["must"], _plus(path, more + F.when(same, KEEP).otherwise(REROLE), F.when(same, "K").otherwise("R")))

    system = F.when(~turn["must"] & (turn["initial"] == "s"), _plus(at[0], more, "K"))
    return _states([left[0], F.least(left[1], system), F.least(left[2], put(F.least(at[0], at[1], at[3]), "u")), F.least(left[3], put(at[2], "a"))])


def folds(turns: Column, start: Column) -> Column:
    """The four (cost, audit) after an array of turns, begun in a state."""
    path = lambda i: F.struct(F.when(start == i, F.lit(0)).otherwise(F.lit(FAR)).cast("long").alias("cost"), F.lit("").alias("audit"))
    ends = F.aggregate(turns, _states([path(i) for i in range(STATES)]), lambda acc, t: _let(_inserted(acc), lambda c: _taken(c, t)))
    return _let(ends, lambda e: F.array(*(e[f"s{i}"] for i in range(STATES))))


def _flagged(rows: DataFrame) -> DataFrame:
    """The turns without their texts, with their faults.  A duplicate is found within its block, or in an earlier one by a join."""
    own = rows.drop("text").withColumn("again", F.row_number().over(W.partitionBy("key", "block", "digest").orderBy("pos")) > 1)
    late = own.where("block > 0").select("key", "digest", "block").distinct()
    long = late.select("key").distinct()
    first = own.select("key", "digest", "block").join(long, "key", "left_semi").groupBy("key", "digest").agg(F.min("block").alias("first"))
    known = late.join(first, ["key", "digest"]).where("first < block").select("key", "digest", "block", F.lit(True).alias("known"))
    duplicate = F.col("again") | F.coalesce("known", F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(duplicate, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return own.join(known, ["key", "digest", "block"], "left").select("key", "conv_id", "turn", "initial", "pos", "block", fault.alias("fault"))


def _blocks(flagged: DataFrame) -> DataFrame:
    """A row for each block: its counts, its borders, and for each state it can begin in the four ends."""
    turn = F.struct("pos", "initial", F.col("fault").isin("blank", "duplicate").alias("must"), (F.col("fault") == "truncated").alias("cut"), "turn")
    counts = [F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")]
    own = flagged.groupBy("key", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.min("turn").alias("least"), F.max("turn").alias("most"), *counts)
    pairs = F.transform(F.sequence(F.lit(1), F.size("turns") - 1), lambda i: F.concat(F.col("turns")[i - 1]["initial"], F.col("turns")[i]["initial"]))
    illegal = F.when(F.size("turns") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    different = F.size(F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())))
    ends = F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda s: F.when((F.col("block") > 0) | (s == 0), folds(F.col("turns"), s)))
    border = lambda at: F.element_at("turns", at)
    return own.select(
        "key", "block", "least", "most", *("blank duplicate truncated".split()), illegal.cast("long").alias("illegal"), different.cast("long").alias("different"),
        F.struct(border(1)["turn"].alias("turn"), border(1)["initial"].alias("initial")).alias("opens"), F.struct(border(-1)["turn"].alias("turn"), border(-1)["initial"].alias("initial")).alias("closes"),
        ends.alias("ends"),
    )


def _chain(steps: Column) -> Column:
    """How the blocks of a conversation are joined: struct(cost, starts, end, more), `more` being insertions at the end."""
    every = F.sequence(F.lit(0), F.lit(STATES - 1))

    def step(acc, x):
        best = F.transform(every, lambda j: F.array_min(F.transform(every, lambda i: F.struct((acc["costs"][i] + x["costs"][i * STATES + j]).alias("cost"), acc["ranks"][i].alias("rank"), i.alias("via")))))

        def close(b):
            place = lambda j: F.struct(b[j]["rank"], x["ranks"][b[j]["via"] * STATES + j], j)
            ranks = F.transform(every, lambda j: F.size(F.filter(every, lambda k: place(k) < place(j))))
            return F.struct(F.transform(b, lambda e: F.least(e["cost"], F.lit(FAR))).alias("costs"), ranks.alias("ranks"), F.concat(acc["via"], F.array(F.transform(b, lambda e: e["via"]))).alias("via"))

        return _let(best, close)

    none = F.struct(
        F.array(F.lit(0).cast("long"), *[F.lit(FAR).cast("long")] * (STATES - 1)).alias("costs"),
        F.array(*map(F.lit, range(STATES))).alias("ranks"),
        F.array().cast("array<array<int>>").alias("via"),
    )
    ahead = F.aggregate(steps, none, step)

    def final(a):
        ends = [F.struct((a["costs"][s] + INSERT * len(more)).alias("cost"), a["ranks"][s].alias("rank"), F.lit(s).alias("end"), F.lit(more).alias("more")) for s, more in ((0, ""), (3, ""), (2, "I"), (1, "II"))]
        back = lambda e: F.aggregate(F.reverse(a["via"]), F.array(e["end"]), lambda path, via: F.concat(F.array(via[path[0]]), path))
        return _let(F.least(*ends), lambda e: F.struct(e["cost"].alias("cost"), e["more"].alias("more"), back(e).alias("path")))

    return _let(ahead, final)


@dataclass(frozen=True)
class Repaired:
    """`report`: a row for each conversation with turns, by its key (turns.key_of); `rows`: the repaired turns (key, pos, sub, role, text, edit) in the order of pos, sub."""

    report: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, settings: Settings = Settings()) -> Repaired:
    """Repairs the conversations of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    own = rows.select(F.col("conv_id"), key_of(F.col("conv_id")).alias("key"), F.col("turn"), role.alias("role"), text.alias("text"))
    inked = F.rtrim(F.col("text"), F.lit(SPACE))
    own = own.withColumns({
        "initial": F.substring("role", 1, 1), "blank": inked == "", "cut": ~F.right(inked, F.lit(1)).isin(*".!?"),
        "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256),
    })
    turns = placed(own, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], settings.block)
    blocks = saved(_blocks(_flagged(turns)), "blocks")

    audits = lambda e: F.transform(e, lambda x: x["audit"])
    ranked = lambda e: F.transform(audits(e), lambda a: F.size(F.filter(audits(e), lambda b: b < a)))
    nowhere, level = F.array_repeat(F.lit(FAR).cast("long"), STATES), F.sequence(F.lit(0), F.lit(STATES - 1))
    costs = F.flatten(F.transform("ends", lambda e: F.coalesce(F.transform(e, lambda x: x["cost"]), nowhere)))
    ranks = F.flatten(F.transform("ends", lambda e: F.coalesce(ranked(e), level)))
    step = F.struct("block", costs.alias("costs"), ranks.alias("ranks"), "opens", "closes", "different")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "different")]
    chains = blocks.groupBy("key").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.min("least").alias("least"), F.max("most").alias("most"), *sums)
    borders = lambda test: F.when(F.size("steps") > 1, F.size(F.filter(F.sequence(F.lit(1), F.size("steps") - 1), lambda i: test(F.col("steps")[i - 1]["closes"], F.col("steps")[i]["opens"])))).otherwise(0)
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("different") + borders(lambda a, b: a["turn"] == b["turn"]), F.lit(0))
    broken = F.col("illegal") + borders(lambda a, b: ~F.concat(a["initial"], b["initial"]).isin("su", "ua", "au"))
    chained = saved(chains.select("key", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", broken.cast("long").alias("illegal"), _chain(F.col("steps")).alias("way")), "chains")

    ways = chained.select("key", F.col("way.more").alias("more"), F.size("way.path").alias("n"), F.posexplode(F.arrays_zip(F.slice("way.path", F.lit(1), F.size("way.path") - 1).alias("start"), F.slice("way.path", F.lit(2), F.size("way.path") - 1).alias("end"))).alias("block", "way"))
    ways = ways.select("key", F.col("block").cast("long").alias("block"), "way.start", "way.end", F.when(F.col("block") == F.col("n") - 2, F.col("more")).otherwise("").alias("more"))
    audit = F.col("ends")[F.col("start")][F.col("end")]["audit"]
    odd = F.length(F.translate(audit, "D", "")) % 2 == 1
    system = (F.col("start") == 0) & ((F.col("end") == 1) | (F.col("end") == 2) & ~odd | (F.col("end") == 3) & odd)  # a system turn was kept
    turned = system | (F.col("start") == 2)
    audited = saved(blocks.select("key", "block", "ends").join(ways, ["key", "block"]).select("key", "block", F.concat(audit, F.col("more")).alias("audit"), turned.cast("int").alias("turned")), "audits")

    whole = audited.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    report = chained.select("*", F.col("way.cost").alias("cost")).join(whole, "key").select("key", *COUNTS, "audit")
    return Repaired(report, _edited(turns, audited, settings))


def _edited(turns: DataFrame, audited: DataFrame, settings: Settings) -> DataFrame:
    """The repaired turns.  An edit that ends with an insertion stands at the end and has no turn.

    Users and assistants alternate, so the place among a block's remaining turns tells the role; `turned`: from odd
    places on a user, as after a system turn or in a block that begins after a user.
    """
    edits = F.regexp_extract_all("audit", F.lit("(I*[KRD]|I+)"), F.lit(1))
    lengths = F.transform(edits, lambda e: F.length(F.translate(e, "D", "")))
    outs = F.transform(edits, lambda e, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, b: a + b))
    pieces = audited.select("key", "block", "turned", F.posexplode(F.arrays_zip(edits.alias("edit"), outs.alias("out"))).alias("i", "piece"))
    sign = F.regexp_extract("piece.edit", "[KRD]$", 0)
    inserted = F.length("piece.edit") - F.length(sign)
    pieces = pieces.select(F.col("key").alias("__key"), (F.col("block") * settings.block + F.col("i")).alias("__pos"), sign.alias("sign"), inserted.alias("inserted"), (F.col("piece.out") + F.col("turned")).alias("at"))
    named = lambda place: F.when(place % 2 == 0, "user").otherwise("assistant")
    new = F.transform(F.when(F.col("inserted") > 0, F.sequence(F.lit(0), F.col("inserted") - 1)), lambda i: F.struct(named(F.col("at") + i).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    role = F.when(F.col("sign") == "K", F.col("role")).otherwise(named(F.col("at") + F.col("inserted")))
    kept = F.when(F.col("sign").isin("K", "R"), F.array(F.struct(role.alias("role"), F.col("text"), F.col("sign").alias("edit"))))
    empty = F.array().cast("array<struct<role:string,text:string,edit:string>>")
    found = pieces.join(turns.select("key", "pos", "role", "text"), (F.col("key") == F.col("__key")) & (F.col("pos") == F.col("__pos")), "left")
    out = found.select(F.col("__key").alias("key"), F.col("__pos").alias("pos"), F.posexplode(F.concat(F.coalesce(new, empty), F.coalesce(kept, empty))).alias("sub", "turn"))
    return out.select("key", "pos", "sub", "turn.role", "turn.text", "turn.edit")


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text; nulls: one space) with the faults that crc32(`conv_id:turn`) % 20 deals out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return own.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


class _Digest:
    """SHA-256 of `role:text` of turns, joined by new lines."""

    def __init__(self):
        self.hash, self.first = hashlib.sha256(), True

    def add(self, row: dict) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{row['role']}:{row['text']}".encode())
        self.first = False

    def end(self) -> tuple:
        return (self.hash.hexdigest(),)


def digests(found: Repaired) -> DataFrame:
    """(key, repaired_sha256) of each conversation that has turns left, read in a stream."""
    return folded(found.rows.select("key", "pos", "sub", "role", "text"), "key", ["pos", "sub"], _Digest, "repaired_sha256 string")


def op13_conversation_repair(spark, sf_dir):
    return repaired(conversations(spark, sf_dir))


def repaired(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each conv_id of rows, which are damaged first: its faults, least cost, audit and the digest of the repaired turns."""
    found = repair(damaged(rows), settings)
    every = rows.select("conv_id", key_of(F.col("conv_id")).alias("key")).distinct()
    out = every.join(found.report, "key", "left").join(digests(found), "key", "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))



def _sql_plus(path: str, cost: str, sign: str, turn: str) -> str:
    return f"CASE WHEN {path} IS NOT NULL THEN {{'c': {path}.c + {cost}, 'a': {path}.a || {sign}, 'o': list_append({path}.o, {turn})}} END"


def _sql_put(path: str, name: str) -> str:
    same = f"role[1] = '{name[0]}'"
    return f"CASE WHEN NOT must THEN {_sql_plus(path, f'cut + CASE WHEN {same} THEN 0 ELSE 2 END', f"CASE WHEN {same} THEN 'K' ELSE 'R' END", f"CASE WHEN {same} THEN role ELSE '{name}' END || ':' || text")} END"


def _sql_delete(path: str) -> str:
    return f"CASE WHEN {path} IS NOT NULL THEN {{'c': {path}.c + 3, 'a': {path}.a || 'D', 'o': {path}.o}} END"


_SQL_USER = f"list_min([s2, {', '.join(_sql_plus(p, '2', chr(39) + 'I' + chr(39), chr(39) + 'user:' + chr(39)) for p in ('s0', 's1', 's3'))}])"
_SQL_ASSISTANT = f"list_min([s3, {_sql_plus('u', '2', chr(39) + 'I' + chr(39), chr(39) + 'assistant:' + chr(39))}])"

OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
        regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS inked, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d),
t AS (SELECT *, inked = '' OR again AS must, CASE WHEN inked = '' OR again OR regexp_matches(inked, '[.!?]$') THEN 0 ELSE 1 END AS cut,
        lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS behind FROM r),
e AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (inked = '') AS blank, count(*) FILTER (inked <> '' AND again) AS duplicate, sum(cut) AS truncated,
        count(*) FILTER (behind IS NOT NULL AND behind[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id),
f AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR[]) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR[]) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR[]) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations) AS q
  UNION ALL
  SELECT conv_id, pos, {_sql_delete("s0")},
         list_min([{_sql_delete("s1")}, CASE WHEN NOT must AND role[1] = 's' THEN {_sql_plus("s0", "cut", "'K'", "role || ':' || text")} END]),
         list_min([{_sql_delete("u")}, {_sql_put("b", "user")}]),
         list_min([{_sql_delete("a")}, {_sql_put("u", "assistant")}])
  FROM (SELECT *, list_min([s0, s1, a]) AS b FROM (SELECT *, {_SQL_ASSISTANT} AS a FROM (SELECT t.conv_id, t.pos, t.role, t.text, t.must, t.cut, s0, s1, s2, s3, {_SQL_USER} AS u FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.pos = f.pos + 1) AS x) AS y) AS z),
g AS (SELECT conv_id, list_min([s0, a]) AS best FROM (SELECT *, {_SQL_ASSISTANT} AS a FROM (SELECT *, {_SQL_USER} AS u FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS late FROM f) AS w WHERE late = 1) AS x) AS y)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM g LEFT JOIN e ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""


__all__ = ["OP13_SQL", "Repaired", "Settings", "damaged", "digests", "op13_conversation_repair", "repair", "repaired"]

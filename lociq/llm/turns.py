"""Repair of conversations: the cheapest edits that make their roles a system turn, if any, and pairs of user and assistant.

1. Facts of rows (order, faults, legal neighbours) come from windows over a conversation; windows hold digests of texts,
   not the texts, and spill.
2. Each row becomes one letter of its conversation's code, which holds all that the cost of an edit depends on. One
   conversation's code is searched depth first, by branch and bound (`cheapest`).
3. Texts follow their conversation's audit in one sorted stream and are hashed as they pass, so that neither texts nor
   repaired texts of a conversation are ever held together. A conversation stays in one task, since the digest of its
   text is of one sequence; what is held of it are its code and audit, as long as the audit that is returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.shared import keep

DELETE, INSERT, KEEP, REROLE = "DIKR"
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED = 3
#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: State after a user or assistant turn that is put in or given its role, and that role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Letters of a code: a row that must go, and by its role's initial a whole or a truncated row ("o": any other role).
MUST_GO = "x"
LAST = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"


def kept_as(letter: str, state: int) -> int | None:
    """State after a row that is kept, or None if its role can't stand there."""
    role = letter.lower()
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return None if state == USER else USER
    return ASSISTANT if role == "a" and state == USER else None


def edits(letter: str, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows passed, next state) of each edit at a row, in order of their initials; "" is the end."""
    out = [(DELETE, COSTS[DELETE], 1, state)] if letter else []
    out.append((INSERT, COSTS[INSERT], 0, NEXT[state]))
    if letter and letter != MUST_GO:
        more = TRUNCATED if letter.isupper() else 0
        if (kept := kept_as(letter, state)) is not None:
            out.append((KEEP, COSTS[KEEP] + more, 1, kept))
        out.append((REROLE, COSTS[REROLE] + more, 1, NEXT[state]))
    return out


def suffix_bounds(code: str) -> list[list[int]]:
    """For each row and state a lower bound of what the rows from there on cost.

    A bound is the least over a row's own edits, with as many turns put in before it as lead from one state to
    another; the end asks for a turn more after the system's or a user's.
    """
    after = [0 if s in ENDS else COSTS[INSERT] * (2 if s == SYSTEM else 1) for s in range(4)]
    out = [after]
    for letter in reversed(code):
        own = [min(cost + after[to] for _, cost, passed, to in edits(letter, s) if passed) for s in range(4)]
        for _ in range(3):  # a state is at most three turns from another
            own = [min(c, COSTS[INSERT] + own[NEXT[s]]) for s, c in enumerate(own)]
        after = own
        out.append(after)
    return out[::-1]


def cheapest(code: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, the least audit among equally cheap ones, for one conversation's code.

    Depth first with a stack of its own: a prefix of edits goes on while its cost and the bound of its suffix are below
    the incumbent's cost, or equal to it if its audit may still be less, and while no better prefix has come to its row
    and state. At one row and state no prefix of equal cost begins another, so the less of two audits stays the less
    whatever follows. The search ends when the stack is empty: then nothing cheaper, or equally cheap and less, is left.
    An audit is a link to what it continues and an edit.
    """
    bounds = suffix_bounds(code)
    n = len(code)
    best: dict[tuple[int, int], tuple[int, tuple]] = {}
    least, audit_of_least, path = None, (), {}
    stack: list[tuple[int, int, int, tuple]] = [(0, START, 0, ())]
    while stack:
        row, state, cost, audit = stack.pop()
        bound = cost + bounds[row][state]
        if least is not None and (bound > least or (bound == least and not may_be_less(audit, audit_of_least, path))):
            continue
        known = best.get((row, state))
        if known and (known[0] < cost or (known[0] == cost and written(known[1]) <= written(audit))):
            continue
        best[row, state] = (cost, audit)
        if row == n and state in ENDS:
            least, audit_of_least, path = cost, audit, followers(audit)
            continue
        # The edit of the least bound is tried first, and of several the least letter.
        found = [(c + cost + bounds[row + p][to], e, c + cost, row + p, to) for e, c, p, to in edits(code[row : row + 1], state)]
        for _, edit, c, at, to in sorted(found, reverse=True):
            stack.append((at, to, c, (audit, edit)))
    return least, written(audit_of_least)


def written(audit: tuple) -> str:
    out = []
    while audit:
        audit, edit = audit
        out.append(edit)
    return "".join(reversed(out))


def followers(audit: tuple) -> dict[int, str]:
    """The edit that follows each beginning of an audit, by the beginning's identity."""
    out = {}
    while audit:
        out[id(audit[0])] = audit[1]
        audit = audit[0]
    return out


def may_be_less(prefix: tuple, whole: tuple, path: dict[int, str]) -> bool:
    """Whether an audit that begins with `prefix` may come before `whole`, whose followers() are `path`."""
    if not prefix:
        return True
    if (follows := path.get(id(prefix[0]))) is not None:
        return prefix[1] < follows
    own, other = written(prefix), written(whole)
    return own < other or other.startswith(own)


def key_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text of the rows of `conversations` (conv_id, turn, role, text) after damage.

    conv is conv_id as text behind a sign, so that null ids are one conversation; a null role or text is one space, and
    so is a null id or turn in the text that decides on the damage.
    """
    kind = F.crc32(F.concat(key_text("conv_id"), F.lit(":"), key_text("turn")).cast("binary")) % 20
    role, text = key_text("role"), key_text("text")
    rows = conversations.select(
        conv_key().alias("conv"), "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).where("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def conv_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def facts(rows: DataFrame) -> DataFrame:
    """One row for each conv of `rows` (conv, turn, role, text): gaps, blank, duplicate, truncated, illegal, code.

    Rows stand by turn, nulls first; rows of one turn by role and the text's digest.
    """
    initial = F.substring("role", 1, 1)
    seen = rows.select("conv", "turn", "role", initial.alias("initial"), F.sha2("text", 256).alias("digest"), F.regexp_extract("text", LAST, 1).alias("last"))
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    before = Window.partitionBy("conv").orderBy(*order)
    same = Window.partitionBy("conv", "role", "digest").orderBy("at")
    seen = seen.withColumn("at", F.row_number().over(before)).withColumn("left", F.lag("initial").over(before)).withColumn("copy", F.row_number().over(same))
    blank = F.col("last") == ""
    duplicate = ~blank & (F.col("copy") > 1)
    truncated = ~blank & ~duplicate & ~F.col("last").isin(".", "!", "?")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(blank | duplicate, MUST_GO).when(truncated, F.upper(known)).otherwise(known)
    illegal = F.col("left").isNotNull() & ~F.concat("left", "initial").isin("su", "ua", "au")
    number = lambda c: F.sum(c.cast("long"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", letter.alias("letter")))), lambda x: x["letter"]), "")
    plain = seen.groupBy("conv").agg(
        number(blank).alias("blank"), number(duplicate).alias("duplicate"), number(truncated).alias("truncated"), number(illegal).alias("illegal"),
        code.alias("code"), F.max("turn").alias("most"), F.min("turn").alias("least"),
    )
    turns = seen.groupBy("conv", "turn").count().groupBy("conv").agg(F.count("turn").alias("turns"))
    return plain.join(turns, "conv").withColumn("gaps", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))).drop("most", "least", "turns")


def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    short = lru_cache(10_000)(cheapest)
    for b in batches:
        found = [(short if len(code) <= 32 else cheapest)(code) for code in b["code"]]
        yield b.drop(columns="code").assign(cost=[c for c, _ in found], audit=[a for _, a in found])


class Repaired:
    """The digest of a conversation's repaired lines, which come one row after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.first = audit, 0, START, hashlib.sha256(), True

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def put_in(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.state = NEXT[self.state]
            self.line(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.put_in()
        edit = self.audit[self.at]
        self.at += 1
        if edit == REROLE:
            self.state = NEXT[self.state]
            self.line(ROLES[self.state], text)
        elif edit == KEEP:
            self.state = kept_as(role[0], self.state)
            self.line(role, text)

    def hex(self) -> str:
        self.put_in()
        return self.digest.hexdigest()


def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by conv, the audit's before its texts; gives conv and digest."""
    conv, now = None, None
    for b in batches:
        done = []
        for c, audit, role, text in zip(b["conv"], b["audit"], b["role"], b["text"], strict=True):
            if conv is None or c != conv:
                if now:
                    done.append((conv, now.hex()))
                conv, now = c, Repaired(audit)
            else:
                now.row(role, text)
        yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
    if now:
        yield pd.DataFrame([(conv, now.hex())], columns=["conv", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id.

    `conversations` (conv_id, turn, role, text) is damaged first, see `damaged`. Null ids are one conversation, which
    is returned with a null id; null turns come first and don't count as turns for gaps; rows that are repeated are
    duplicates. A role counts by its first letter, an empty or unknown one can't be kept. A conversation of which no row
    is left has zeros, an empty audit and the digest of nothing. Further columns are ignored; an empty table gives
    an empty result.
    """
    rows = damaged(conversations)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal")
    plans = keep(facts(rows).mapInPandas(searched, "conv string, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"))
    none = F.lit(None).cast("string")
    heads = plans.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), "audit")
    texts = rows.select("conv", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", none.alias("audit"))
    lined = heads.unionByName(texts).withColumn("digest", F.sha2("text", 256)).repartition("conv")
    lined = lined.sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest").select("conv", "audit", "role", "text")
    digests = lined.mapInPandas(hashed, "conv string, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct().withColumn("conv", conv_key())
    out = ids.join(plans, "conv", "left").join(digests, "conv", "left")
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*counts, "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

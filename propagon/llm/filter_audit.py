"""How filters of documents interact: what every filter removes at every place of every order.

The states of a permutation trie are sets of filters that have been applied. A depth-first walk applies one filter more
to the persisted survivors of a state; a set that another order has reached is not walked again, since survivors do not
depend on the order. Each state counts, in one aggregate, what every filter still left would remove; the counts of the
edges are written as they are made.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propagon.llm.common import new_path, saved, text_bytes

FILTERS = "ABCDE"
#: Words of a text are read in pieces of about so many bytes.
PIECE = 1 << 20
SYMBOLS = b"#$%&*|"
NOT_CAPITAL, NOT_FIRST_BYTE, NOT_SYMBOL = (bytes(x for x in range(256) if not keep(x)) for keep in (lambda x: 65 <= x <= 90, lambda x: x & 0xC0 != 0x80, lambda x: x in SYMBOLS))


def _pieces(data: bytes):
    """The text in pieces that end before white space."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def _failed(data: bytes) -> tuple[bool, bool, bool, bool]:
    words, distinct, capitals, symbols, points = 0, set(), 0, 0, 0
    for piece in _pieces(data):
        # without an argument bytes split at \x20 and \x09-\x0D
        found = piece.split()
        words += len(found)
        distinct.update(found)
        capitals += len(piece.translate(None, NOT_CAPITAL))
        symbols += len(piece.translate(None, NOT_SYMBOL))
        points += len(piece.translate(None, NOT_FIRST_BYTE))
    return words < 200, 100 * len(distinct) < 50 * words, 100 * capitals > 2 * points, symbols > 0


def failures(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row a document: ``part``, ``A`` to ``E`` (whether it fails that filter), ``good``, ``toxic``.

    A null text is empty, a null part is an empty string. A document fails E where a smaller id has the same text; null
    ids have no order and never fail it, and rows of one id do not make each other fail. A document is good or toxic
    where one of its label rows says so. The first document of a text is found by joining on text and id together, so
    a text of many copies is no hot key.
    """
    given = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_bytes(text).alias("data"))
    id_type = given.schema["id"].dataType.simpleString()

    def read(batches):
        for b in batches:
            rows = [_failed(x.as_buffer().to_pybytes()) for x in b.column("data")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), b.column("same"), *(pa.array([r[i] for r in rows], pa.bool_()) for i in range(4))], names=["id", "part", "same", *"ABCD"])

    # a digest stands for the text
    rows = saved(given.withColumn("same", F.unhex(F.sha2("data", 256))).mapInArrow(read, f"id {id_type}, part string, same binary, A boolean, B boolean, C boolean, D boolean"), "failures")
    named = rows.where("id is not null")
    first = named.groupBy("same").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    named = named.join(first, ["same", "id"], "left").withColumn("E", F.col("first").isNull()).drop("first")
    if labels is None:
        named = named.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
        named = named.join(marks, "id", "left").na.fill(False, ["good", "toxic"])
    nameless = rows.where("id is null").withColumns({k: F.lit(False) for k in ("E", "good", "toxic")})
    columns = ["part", *FILTERS, "good", "toxic"]
    return saved(named.select(*columns).unionByName(nameless.select(*columns)), "failures")


def walk(rows: DataFrame, filters: str, visit: Callable[[str, str, DataFrame], None]) -> None:
    """Depth-first over the sets of ``filters``: ``visit`` gets the letters applied, those left and the survivors.

    ``rows`` has a boolean column for each letter, true where the row fails. Survivors of a state are persisted while
    its branch is walked, so at most one DataFrame a level is held; a lost one is made again from the rows.
    """
    seen: set[str] = set()

    def go(state: str, survivors: DataFrame) -> None:
        seen.add(state)
        left = "".join(f for f in filters if f not in state)
        if not left:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        visit(state, left, survivors)
        for f in left:
            after = "".join(x for x in filters if x in state or x == f)
            if after not in seen:
                go(after, survivors.where(~F.col(f)))
        survivors.unpersist()

    go("", rows)


def edges(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, state and filter applied next: ``survivors`` of the state, ``removed`` of them, ``good_lost`` and
    ``toxic_lost`` among those. Parts without survivors have no row in a state."""
    path = new_path(rows.sparkSession, "edges")

    def visit(state: str, left: str, survivors: DataFrame) -> None:
        counts = [F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good_lost"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost")) for f in left]
        per = survivors.groupBy("part").agg(F.count("*").alias("survivors"), F.array(*counts).alias("x"))
        per.select("part", F.lit(state).alias("state"), "survivors", F.inline("x")).write.mode("append").parquet(path)

    walk(rows, filters, visit)
    return rows.sparkSession.read.schema("part string, state string, survivors long, filter string, removed long, good_lost long, toxic_lost long").parquet(path)


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every part, order of ``filters`` and step, zeros included: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. An empty table has no part and gives no rows; repeated rows count as often as they come."""
    e = edges(rows, filters)
    orders = [("".join(p), i + 1, f, "".join(x for x in filters if x in p[:i])) for p in permutations(filters) for i, f in enumerate(p)]
    steps = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, filter string, state string")
    count: list[Column] = [F.coalesce(F.col(k), F.lit(0)).alias(k) for k in ("survivors", "removed", "good_lost", "toxic_lost")]
    parts = e.where("state = ''").select("part").distinct()
    factor = [factorial(i) for i in range(len(filters) + 1)]
    states = sorted({(x, f) for _, _, f, x in orders})
    every_edge = F.explode(F.array(*(F.struct(F.lit(x).alias("state"), F.lit(f).alias("filter"), F.lit(factor[len(x)] * factor[len(filters) - 1 - len(x)]).alias("orders")) for x, f in states)))
    full = parts.select("part", every_edge.alias("x")).select("part", "x.*").join(e, ["part", "state", "filter"], "left").select("part", "state", "filter", "orders", *count)
    alone = F.sum(F.when(F.length("state") == len(filters) - 1, F.col("removed")).otherwise(0))
    every = F.sum(F.when(F.length("state") == 0, F.col("removed")).otherwise(0))
    totals = full.groupBy("part", "filter").agg(alone.alias("unique_fails"), every.alias("fails"), F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    known = full.drop("orders").join(totals, ["part", "filter"])
    # five rows an order
    out = known.join(F.broadcast(steps), ["state", "filter"])
    number = {"kept": F.col("survivors") - F.col("removed"), "removed": F.col("removed"), "redundant": F.col("fails") - F.col("removed"), "unique_fails": F.col("unique_fails"), "good_lost": F.col("good_lost"), "toxic_lost": F.col("toxic_lost"), "shapley": F.col("shapley")}
    return out.select("part", "filter_order", "step", *(v.cast("long").alias(k) for k, v in number.items()))

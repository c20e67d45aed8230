from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelathe.llm import divergence as dv

SF = "/root/testdata/sf0.001"


def brute(rows, least, top):
    """(lang, source, part, item, value, rank) by plain loops over documents."""
    docs = [((lang or ""), (source or ""), ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t in seen if seen[t] >= least)
        counts = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if t in set(kept))
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(sum(abs(share(c, t) - share(o, t)) for t in kept), name) for name, o in counts.items() if name != s]
            terms = [(share(c, t) - share(whole, t), t) for t in kept if c[t] > 0 and share(c, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "lang string, source string, text string, n long, term string")


@pytest.mark.parametrize("block,shard", [(8, 4096), (2, 3), (3, 1)])
def test_audit_against_loops(spark, monkeypatch, block, shard):
    """Whatever the size of blocks and shards; groups without terms, nulls, repeated rows, ties and long texts."""
    monkeypatch.setattr(dv, "BLOCK", block)
    monkeypatch.setattr(dv, "SHARD_TERMS", shard)
    monkeypatch.setattr(dv, "WINDOW", 50)
    monkeypatch.setattr(dv, "FLUSH", 30)
    r = random.Random(block)
    vocabulary = ["Tree", "élan", "ÉLAN", "日本", "cat", "dog", "x", "Zebra", "b9c", "naïve"]
    rows = [(r.choice(["a", "b", None]), f"s{r.randrange(11)}", " ".join(r.choices(vocabulary, range(1, 11), k=r.choice([0, 1, 5, 60])))) for _ in range(150)]
    rows += [("a", None, "1 2 3"), ("b", "only", None), ("c", "p", "rare"), ("c", "q", "rarer"), ("d", "alone", "words here"), ("a", "s1", "cat " * 900)] * 2
    got = [tuple(x) for x in dv.audit(table(spark, rows), least=4, top=3).collect()]
    want = brute(rows, 4, 3)
    assert len(got) == len(want) and set(got) == want
    assert ("c", "p", "pair", "q", 0, 1) in want


def test_empty(spark):
    assert dv.audit(table(spark, []).limit(0)).collect() == []


def test_every_pair_meets_once(spark):
    """The circle method over 2 to 9 blocks: each pair in one round, at one host, and no block twice in a round."""
    for blocks in range(1, 10):
        rounds = blocks + blocks % 2 - 1
        meetings = Counter()
        for nth in range(rounds):
            b = spark.range(blocks).select(F.col("id").cast("int").alias("b")).withColumn("r", F.lit(rounds))
            met = b.select("b", dv.opponent(F.col("b"), F.col("r"), nth).alias("to")).withColumn("at", dv.host(F.col("b"), F.col("to"))).where(F.col("to") < blocks).collect()
            assert len({x.b for x in met}) == len(met) and {(x.to, x.b) for x in met} == {(x.b, x.to) for x in met}
            meetings.update((min(x.b, x.to), max(x.b, x.to)) for x in met if x.at == x.to)
        assert meetings == Counter(combinations(range(blocks), 2))


def test_residents_are_not_shuffled(spark):
    """A round's plan exchanges the visitors only."""
    rows = spark.createDataFrame([("a", 0, b) for b in range(4)], "lang string, shard int, block int")
    cell = ["lang", "shard", "block"]
    resident = rows.repartition(4, *cell).persist()
    resident.count()
    visitors = rows.withColumn("block", F.col("block") + 1).repartition(4, *cell)
    both = resident.groupBy(*cell).cogroup(visitors.groupBy(*cell)).applyInArrow(lambda k, a, b: a, "lang string, shard int, block int")
    plan = both._jdf.queryExecution().executedPlan().toString()
    resident.unpersist()
    first, rest = plan.split("InMemoryTableScan", 1)
    assert "FlatMapCoGroupsInArrow" in first and "Exchange" not in first and rest.split("== Initial Plan ==")[1].count("Exchange hashpartitioning") >= 1


def test_shares_are_exact():
    r = random.Random(0)
    for total in (7, 10**6 + 3, 10**12 + 39, 8 * 10**15 + 1, 3 * 10**17 + 7):
        n = [0, 1, total - 1, total, *(r.randrange(total) for _ in range(50))]
        assert dv.share(np.array(n), total).tolist() == [1 + 10**9 * x // total for x in n]


def test_vectors_round_trip():
    import pyarrow as pa

    at, n = [[0, 5, 4095], [7], []], [[1, 10**12, 3], [2], []]
    for blob, a, b in zip(dv._pack(pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))).to_pylist(), at, n, strict=True):
        x, y = dv.unpack(blob)
        assert x.tolist() == a and y.tolist() == b


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {tuple(x) for x in con.execute(dv.ORACLE).fetchall()}
    df = dv.op13_divergence(spark, SF)
    got = [tuple(x) for x in df.collect()]
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and len(got) == len(set(got)) and set(got) == want

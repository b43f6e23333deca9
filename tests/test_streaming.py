"""Keyed state: the gate of runs after any split of its input, and the harvest of lists against a plain fold; trees by pointer doubling."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.operators import near_duplicates, threads
from marginalia.streaming import gates, stateful

DOCS = "doc_id long, text string, run string, junk boolean"


def texts(rng, n):
    base = [[f"w{rng.randrange(400)}" for _ in range(40)] for _ in range(4)]
    out = []
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
        out.append(" ".join(own) if rng.random() > 0.1 else None if rng.random() < 0.5 else "too short")
    return out


@pytest.mark.parametrize("cuts", [[], [1, 2, 30], [10, 20]])
def test_gate_of_runs_is_the_batch_gate_after_any_split(spark, tmp_path, cuts):
    rng = random.Random(11)
    rows = [(i, t, rng.choice(["a", "b", None]), rng.random() < 0.2) for i, t in enumerate(texts(rng, 40))]
    source, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    # Each part is a start of its own: what was accepted before comes from the checkpoint.
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[lo:hi], DOCS).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DOCS).parquet(source)
        judged = stateful.gated(near_duplicates.fingerprints(stream, carried=("run", "junk")))
        got = stateful.run_to_end(judged, out, ckpt)
    got = {r.id: (r.disposition, r.named) for r in got.collect()}
    want = {}
    whole = spark.createDataFrame(rows, DOCS)
    for run in ("a", "b", None):
        own = whole.where(F.col("run").eqNullSafe(F.lit(run)))
        flags = own.select(F.col("doc_id").alias("id"), "junk")
        want |= {r.id: (r.disposition, r.named) for r in near_duplicates.gated(near_duplicates.text_groups(own), flags).collect()}
    assert got == want and {x for x, _ in want.values()} == {"accepted", "duplicate", "junk"}


def test_a_small_run_takes_two_calls_to_its_state_a_batch():
    """The gate's processor alone: calls do not grow with features until the run outgrows its one value, and verdicts are the same then."""

    class Kept:
        def __init__(self):
            self.calls, self.value, self.map = 0, None, {}

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def containsKey(self, key):
            self.calls += 1
            return key in self.map

        def getValue(self, key):
            self.calls += 1
            return self.map[key]

        def updateValue(self, key, value):
            self.calls += 1
            self.map[key] = value

    class Handle(dict):
        def getValueState(self, name, *_):
            return self.setdefault(name, Kept())

        getMapState = getValueState

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(-(2**62), 2**62, 200)) for _ in range(12)]
    sets += [np.concatenate([x[: 200 - k], rng.integers(0, 2**62, k)]) for x, k in zip(sets, (0, 5, 20, 60, 10, 3))]
    verdicts, calls = [], []
    for most in (1 << 18, 700, 0):
        gate, handle, got = stateful._Gate(75, most), Handle(), []
        gate.init(handle)
        for lo in range(0, len(sets), 3):
            batch = pd.DataFrame({"id": range(lo, lo + 3), "prints": sets[lo : lo + 3], "junk": [False] * 3})
            got += [tuple(None if pd.isna(x) else x for x in r) for part in gate.handleInputRows(("r",), iter([batch]), None) for r in part.itertuples(index=False)]
        verdicts.append(got)
        calls.append(sum(x.calls for x in handle.values()))
    assert verdicts[0] == verdicts[1] == verdicts[2] and [r[3] for r in verdicts[0][12:]] == [0, 1, 2, None, 4, 5]
    assert calls[0] <= 2 * 6 < 100 < calls[1]


def test_a_batch_reads_no_history_of_other_features(spark, tmp_path):
    """A second start writes verdicts on its own rows only."""
    source, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for first in (0, 50):
        rows = [(first + i, " ".join(f"d{first + i}w{k}" for k in range(12))) for i in range(50)]
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)
        query = gates.gated(spark.readStream.schema("doc_id long, text string").parquet(source), out, lambda b: b.withColumn("junk", F.lit(False)), ckpt)
        query.awaitTermination(120)
        assert sum(p["numInputRows"] for p in query.recentProgress) == 50
    assert spark.read.parquet(out).where("disposition = 'accepted'").count() == 100


LIST = "list string, pass long, seq long, key string, ts timestamp"
START = datetime(2024, 1, 1)


def folded(rows, limit, idle, seconds):
    """Plain harvest: {list: ([(key, pos, pass)], how it ended)}."""
    out = {}
    for name in sorted({r[0] for r in rows}, key=str):
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2]))
        seen, items, ended, quiet, first = set(), [], None, 0, own[0][1]
        scans = {}
        for r in own:
            scans.setdefault(r[1], []).append(r)
        for number in range(own[0][1], own[-1][1] + 1):
            scan = scans.get(number, [])
            if scan and ended is None:
                if idle and quiet >= idle:
                    ended = "idle"
                elif seconds and (scan[0][4] - own[0][4]).total_seconds() > seconds:
                    ended = "deadline"
            if ended:
                break
            added = 0
            for r in scan:
                if r[3] and r[3] not in seen:
                    seen.add(r[3])
                    added += 1
                    items.append((r[3], len(items) + 1, number))
                    if limit and len(items) >= limit:
                        ended = "limit"
                        break
            if ended:
                break
            quiet = 0 if added or number == first else quiet + 1
        out["" if name is None else name] = (items, ended)
    return out


def passes(rng):
    rows = []
    for name in ("a", "b", "c", "d", "e", None):
        step = rng.choice([1, 3])
        number = rng.randrange(3)
        for k in range(8):
            number += rng.choice([1, 1, 1, 2])
            for i in range(rng.randint(1, 5)):
                key = rng.choice([None, "", *[f"k{j}" for j in range(k * step, k * step + 4)]])
                rows.append((name, number, i, key, START + timedelta(minutes=10 * number, seconds=i)))
    return rows


@pytest.mark.parametrize("limit, idle, seconds", [(0, 2, 0), (6, 0, 0), (0, 0, 3600), (9, 2, 4000), (0, 0, 0)])
def test_harvest_is_the_plain_fold(spark, tmp_path, limit, idle, seconds):
    rng = random.Random(limit + idle + seconds)
    rows = passes(rng)
    want = folded(rows, limit, idle, seconds)
    source, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    late = [r for r in rows if r[1] > 5]
    for part in ([r for r in rows if r[1] <= 5], late, late[:5]):  # the third start repeats rows
        spark.createDataFrame(part, LIST).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LIST).parquet(source)
        got = stateful.run_to_end(stateful.harvested(stream, limit, idle, seconds, patience=None), out, ckpt)
    found = {}
    for r in got.collect():
        items, ended = found.setdefault(r["list"], ([], []))
        if r.ended:
            ended.append(r.ended)
        else:
            items.append((r.key, r.pos, r["pass"]))
    assert {k: sorted(v, key=lambda x: x[1]) for k, (v, _) in found.items()} == {k: v for k, (v, _) in want.items() if v or want[k][1]}
    assert {k: (e or [None]) for k, (_, e) in found.items()} == {k: [e] for k, (v, e) in want.items() if v or e}


def test_lists_without_news_end_by_the_watermark(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    parts = [
        [("a", 0, 0, "x", START), ("b", 0, 0, "y", START)],
        [("b", 1, 0, "z", START + timedelta(minutes=5))],
        [("c", 0, 0, "t", START + timedelta(hours=3))],  # moves the watermark
        [("a", 1, 0, "late", START + timedelta(minutes=1)), ("c", 1, 0, "u", START + timedelta(hours=3, minutes=1))],
    ]
    for part in parts:
        spark.createDataFrame(part, LIST).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LIST).parquet(source)
        got = stateful.run_to_end(stateful.harvested(stream, seconds=1800, patience="1 minute"), out, ckpt)
    rows = {(r["list"], r.key, r.ended) for r in got.collect()}
    assert {(a, k) for a, k, e in rows if not e} == {("a", "x"), ("b", "y"), ("b", "z"), ("c", "t"), ("c", "u")}
    assert {(a, e) for a, k, e in rows if e} == {("a", "overdue"), ("b", "overdue")}


# ---------------------------------------------------------------- trees


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 5000
    nodes = spark.createDataFrame([(1, i, i - 1 if i else None, i) for i in range(n)] + [(2, 0, None, 0)], "conv_id int, node_id int, parent_id int, created_at int")
    rounds = []
    real = threads.checkpointed
    monkeypatch.setattr(threads, "checkpointed", lambda df: rounds.append(0) or real(df))
    got = {(r.conv_id, r.node_id): r.depth for r in threads.active_branch(nodes).collect()}
    assert got == {(1, i): n - 1 - i for i in range(n)} | {(2, 0): 0}
    assert len(rounds) <= 2 * 14 + 2  # the branch and the pointers of each round
    rounds.clear()
    comments = spark.createDataFrame([("p", f"c{i}", f"c{i - 1}" if i else None, 0, "t1", "[deleted]" if i % 100 == 7 else "x") for i in range(600)], "post_id string, id string, parent_id string, pos int, kind string, body string")
    paths = {r.id: r.path for r in threads.numbered_comments(comments).collect()}
    assert len(paths) == 594 and max(p.count(".") for p in paths.values()) == 593 and set("".join(paths.values())) == {"1", "."}
    assert len(rounds) <= 2 * 14


def test_comment_trees_are_the_recursion(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for post in ("p", "q", "r"):
        ids = [f"{post}{i}" for i in range(60)]
        parent = {x: None if i == 0 or rng.random() < 0.15 else rng.choice(ids[:i]) for i, x in enumerate(ids)}
        parent[ids[50]], parent[ids[51]], parent[ids[52]] = ids[51], ids[50], ids[51]  # a cycle and what hangs on it
        parent[ids[53]] = "nowhere"
        gone = {x for x in ids if rng.random() < 0.3}
        rows += [(post, x, parent[x], i, "t1", "[removed]" if x in gone else "x") for i, x in enumerate(ids)]
        kids = {}
        for i, x in enumerate(ids):
            kids.setdefault(parent[x], []).append(x)

        def lifted(x):
            return [y for k in kids.get(x, []) for y in (lifted(k) if k in gone else [k])]

        def number(x, path):
            for k, y in enumerate(lifted(x), 1):
                want[y] = f"{path}{k}"
                order.append(y)
                number(y, f"{path}{k}.")

        order = []
        number(None, "")
        want |= {(post, "order"): order}
    df = spark.createDataFrame(rows, "post_id string, id string, parent_id string, pos int, kind string, body string")
    got = threads.numbered_comments(df).collect()
    assert {r.id: r.path for r in got} == {k: v for k, v in want.items() if isinstance(k, str)}
    for post in ("p", "q", "r"):
        assert [r.id for r in sorted((r for r in got if r.post_id == post), key=lambda r: r.ord)] == want[post, "order"]

"""What lets the large runs end: work per row that does not repeat, shipped indexes, batches of many files."""

import math

from helpers import event, frame
from pyspark.sql import functions as F

from nightjar.functions.text import shannon_entropy
from nightjar.operators import intel as I
from nightjar.operators import normalize as N
from nightjar.operators import text_guard as T
from nightjar.plans import catalog  # noqa: F401 - registers in order
from nightjar.plans import queries_streams as Q
from nightjar.streaming.jobs import WaitingRows


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_events_does_not_decode_records_again(spark):
    raw = spark.createDataFrame([(1, '{"type": "execve", "acct": "ann", "uid": 0, "exe": ""}')], "seq long, text string").select("seq", F.parse_json("text").alias("raw"))
    out = N.normalize(raw).where("source = 'linux'").select("user", "privilege", "process_name")
    assert [tuple(r) for r in out.collect()] == [("ann", "root", None)]
    assert plan_of(out).count("parse_json") + plan_of(out).count("parseJson") <= 1
    assert plan_of(out).count("MapType(StringType,VariantType") <= 2


def test_usable_values(spark):
    record = '{"a": 0, "b": "0", "c": false, "d": "false", "e": "", "f": [], "g": {}, "h": null, "i": 0.0, "j": "longer text", "k": [1], "l": 12}'
    row = N.with_texts(spark.range(1).select(F.parse_json(F.lit(record)).alias("raw")), "rec", F.col("raw")).select("rec_usable").first()
    assert row["rec_usable"] == {"b": "0", "d": "false", "j": "longer text", "k": "[1]", "l": "12"}


def test_small_index_is_shipped_by_its_count(spark, monkeypatch):
    iocs = spark.createDataFrame([("10.0.0.1", "ip", "t", "f", 0.5, "low", None, ["x"], None, None, 0), ("10.0.0.0/8", "cidr", "t", "f", 0.5, "low", None, ["x"], None, None, 1)],
                                 "value string, type string, threat string, source string, confidence double, severity string, first_seen string, tags array<string>, reference string, country string, load_seq long")
    seen = spark.createDataFrame([(i, "ip", f"10.0.0.{i}") for i in range(3)], "id long, kind string, observed string")
    found = {}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (I.BROADCAST_ROWS, 0):
            monkeypatch.setattr(I, "BROADCAST_ROWS", rows)
            out = I.match_observables(seen, iocs, ["id"])
            found[rows] = ("strategy=broadcast" in plan_of(out), {r["id"]: r["ioc"]["value"] for r in out.collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    (_, (shipped, first)), (_, (shuffled, second)) = found.items()
    assert shipped and not shuffled and first == second == {0: "10.0.0.0/8", 1: "10.0.0.1", 2: "10.0.0.0/8"}


class State:
    """States of a handle in memory, counting their calls."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getMapState(self, *_):  # noqa: N802 - Spark API
        return self

    def getValueState(self, *_):  # noqa: N802 - Spark API
        return Value(self)

    def updateValue(self, key, value):  # noqa: N802 - Spark API
        self.calls += 1
        self.values[key] = value

    def getValue(self, key):  # noqa: N802 - Spark API
        self.calls += 1
        return self.values[key]

    def removeKey(self, key):  # noqa: N802 - Spark API
        self.calls += 1
        del self.values[key]

    def registerTimer(self, due):  # noqa: N802 - Spark API
        self.timers.add(due)

    def deleteTimer(self, due):  # noqa: N802 - Spark API
        self.timers.discard(due)


class Value:
    def __init__(self, owner):
        self.owner, self.value = owner, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_rows_wait_in_parts_and_come_back_in_order():
    """30,000 rows of ten hours, backwards and in two calls: few state calls, one timer, pieces in order up to the watermark."""
    state = State()
    waiting = WaitingRows(state)
    rows = [(i * 1_200_000, -i % 7, i) for i in range(30_000)]  # 1.2 s apart
    waiting.add(iter(rows[:25_000][::-1]))
    waiting.add(iter(rows[25_000:]))
    assert state.calls < 100 and state.timers == {1}
    got = []
    for upto in (7_200_000, 7_200_001, 20_000_000, 10**9):
        pieces = list(waiting.take(upto))
        assert all(len(p) <= 10_000 for p in pieces)
        assert all(WaitingRows.due(r) <= upto for p in pieces for r in p)
        got += [r for p in pieces for r in p]
        assert len(got) == sum(WaitingRows.due(r) <= upto for r in rows)
    assert got == rows and not state.values and state.calls < 300
    waiting.add(iter([(5_000, None, "a"), (5_000, 1, "b"), (5_000, None, "c")]))
    assert [r[2] for p in waiting.take(6) for r in p] == ["a", "c", "b"]


def test_batches_of_many_files(spark, monkeypatch):
    """Every trigger reads one batch, whatever its number of rows: all rows arrive, in as many triggers as batches."""
    monkeypatch.setattr(Q, "ROWS_PER_FILE", 5)
    rows = [event(i, i * 60) for i in range(40)]
    events = frame(spark, rows).drop("raw")
    batch = F.when(F.col("seq") < 38, 0).when(F.col("seq") < 39, 1).otherwise(2)
    stream = Q.replayed(events, batch, 3)
    seen = []
    query = stream.writeStream.trigger(availableNow=True).foreachBatch(lambda df, n: seen.append({r["seq"] for r in df.where("tenant_id <> '~closing'").select("seq").collect()}))
    query.option("checkpointLocation", Q.folder(spark, "test")).start().awaitTermination()
    assert seen == [set(range(38)), {38}, {39}, set(), set(), set()]


def test_entropy_of_long_texts_equals_the_expression(spark):
    texts = spark.createDataFrame([(t,) for t in ("", "a", "aab", None, "naïve 😀😀 ﷺ", "the quick brown fox " * 50)], "text string")
    got = texts.select(shannon_entropy(F.col("text")).alias("a"), shannon_entropy(F.col("text"), long_texts=True).alias("b"))
    assert all((r["a"] is None) == (r["b"] is None) and (r["a"] is None or math.isclose(r["a"], r["b"], abs_tol=1e-9)) for r in got.collect())
    assert "pandas_udf" in str(got.select("b")._jdf.queryExecution().toString()) or "ArrowEvalPython" in plan_of(got.select("b"))


def test_phases_are_found_behind_the_plain_search(spark):
    """The plain search lets every text through that the patterns match, in any case and with letters that fold to ASCII."""
    told = ["They RAISED their Admin  privileges.", "perſiſtence", "Keeps access", "EVADES notice", "No discovery here", "Screenshots were made", "captured screenshots", "dİscovery", "it moved\nthrough the network"]
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(told)], "text_id string, text string")
    got = {(r["text_id"], r["value"]) for r in T.extract_claims(texts).where("kind = 'phase'").collect()}
    plain = texts.select("text_id", F.explode(F.array_compact(F.array(*[F.when(T.asserts_phase(F.col("text"), p), F.lit(k)) for k, p in T.PHASE_WORDS.items()]))).alias("value"))
    assert got == {(r["text_id"], r["value"]) for r in plain.collect()} and len(got) >= 5
    guarded = texts.select("text_id", F.array(*[T.may_hold(F.col("text"), s) for s in T.PHASE_STEMS.values()]).alias("may"))
    assert not any({r["text_id"]: r["may"] for r in guarded.collect()}["5"])

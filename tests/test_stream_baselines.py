from helpers import event, frame
from pyspark.sql import functions as F

from nightjar.operators import baselines as B, rules as R
from nightjar.operators.text_guard import known_user_claims
from nightjar.schema import EVENT_SCHEMA
from nightjar.streaming import jobs as J
from nightjar.streaming.baselines import stream_baselines

HOUR, DAY = 3_600, 86_400


def login(seq, seconds, **more):
    return event(seq, seconds, action="login_success", user="Ann", host="A", **more)


def replay(spark, folder, parts, idle=None):
    columns = [c for c in EVENT_SCHEMA.names if c != "raw"]
    for part in parts:
        frame(spark, part).select(columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    for n in (1, 2, 3):  # later rows of another tenant move the watermark
        frame(spark, [login(9_000 + n, 400 * n * DAY, tenant_id="~")]).select(columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frame(spark, parts[0]).select(columns).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    J.run_available(stream_baselines(stream, "1 second", idle), f"{folder}/cp", J.append_to(f"{folder}/out")).awaitTermination()
    return {(r["rule_id"], r["evidence_event_ids"][0], r["description"], r["score"]) for r in spark.read.parquet(f"{folder}/out").where("tenant_id <> '~'").collect()}


def test_replay_in_batches_equals_the_batch(spark, tmp_path):
    """Logins, transfers, starts and queries out of order inside a file; ties by arrival."""
    rows = [login(i, i * DAY, src_ip="8.8.8.8" if i < 30 else "9.9.9.9", geo_country="IN" if i < 33 else "RU") for i in range(40)] + [login(50, 40 * DAY + 9 * HOUR, src_ip="8.8.8.8")]
    rows += [event(100 + i, i * HOUR, event_type="network_connection", action="connect", host="b", dst_ip="8.8.4.4", bytes_out=1_000 + i if i < 39 else 9_000_000) for i in range(40)]
    rows += [event(200 + i, i * 60, event_type="process_start", action="start", host=h, process_name=p) for i, (h, p) in enumerate(
        [("c", f"p{k % 5}.exe") for k in range(41)] + [("c", "Odd.exe"), ("d", "odd.exe"), ("e", "odd.exe"), ("c", "late.exe")])]
    rows += [event(300 + i, 500 + i // 2, event_type="dns_query", action="query", host="q", domain="www.example.com") for i in range(60)]
    rows += [event(400, 700, event_type="dns_query", action="query", host="q", domain="q7w8e9r0t1y2u3i4o5p6.cdn.example.net")]
    rows.sort(key=lambda r: r["timestamp"])
    parts = [rows[:90][::-1], rows[90:150], rows[150:]]
    got = replay(spark, str(tmp_path), parts)
    want = {(r["rule_id"], r["evidence_event_ids"][0], r["description"], r["score"]) for r in R.union_detections(*B.run_baselines(frame(spark, rows))).collect()}
    assert got == want
    assert {r[0] for r in want} == {"ANOM-LOGIN-HOUR", "ANOM-LOGIN-LOCATION", "ANOM-EGRESS-VOLUME", "ANOM-RARE-PROCESS", "ANOM-DNS-ENTROPY", "ANOM-DNS-BURST"}


def test_state_of_an_idle_key_ends(spark, tmp_path):
    """After a pause the user is learned anew, so an odd hour shows nothing yet."""
    rows = [login(i, i * DAY) for i in range(20)] + [login(50, 100 * DAY + 9 * HOUR)]
    assert {r[0] for r in replay(spark, str(tmp_path / "a"), [rows])} == {"ANOM-LOGIN-HOUR"}
    assert replay(spark, str(tmp_path / "b"), [rows], 30 * DAY) == set()


def test_names_are_found_as_whole_words(spark):
    texts = spark.createDataFrame([("t1", "i", "Ann Lee saw ann-lee; bob$ left."), ("t2", "i", "Anna and ann_lee"), ("t3", "j", "ann"), ("t4", "i", None), ("t5", "i", "")], "text_id string, incident_id string, text string")
    names = ["ann", "ann lee", "ann-lee", "lee; bob", "bob$ l", "bob$", "saw ann lee", None]
    vocabulary = spark.createDataFrame([("i", "user", n) for n in names] + [("i", "host", "left")], "incident_id string, kind string, value string")
    got = {(r["text_id"], r["value"]) for r in known_user_claims(texts, vocabulary).collect()}
    assert got == {("t1", "ann"), ("t1", "ann lee"), ("t1", "ann-lee"), ("t1", "lee; bob")}

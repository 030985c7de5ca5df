import gzip
import json
import zipfile

from pyspark.sql import functions as F

from nightjar.operators.intel import current_iocs, match_observables
from nightjar.operators.normalize import normalize, validate
from nightjar.sources import feeds, raw


def test_vendor_records(spark):
    recs = [
        {"EventID": 4625, "Computer": "WS-1", "TimeCreated": "2024-01-01T00:00:00Z", "EventData": {"TargetUserName": "bob", "IpAddress": "1.2.3.4", "LogonType": 10}},
        {"collector": "sysmon", "EventID": 1, "Computer": "WS-1", "TimeCreated": "2024-01-01T00:00:01Z", "EventData": {"Image": "C:\\W\\cmd.exe", "ParentImage": "C:\\O\\WINWORD.EXE"}},
        {"EventID": 10, "Hostname": "h", "@timestamp": "2024-01-01T00:00:02Z", "SourceImage": "C:\\a.exe", "TargetImage": "C:\\lsass.exe", "GrantedAccess": "0x1010"},
        {"EventID": 5156, "Hostname": "h", "@timestamp": "2024-01-01T00:00:02Z", "Application": "\\d\\x.exe", "DestAddress": "8.8.8.8", "DestPort": "443"},
        {"EventID": 4104, "Hostname": "h", "@timestamp": "2024-01-01T00:00:03Z", "ScriptBlockText": "IEX (x)"},
        {"ts": 1704067200.5, "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "id.resp_p": 443, "orig_bytes": 100, "resp_bytes": 0, "collector": "zeek"},
        {"ts": 1704067200, "id.orig_h": "10.0.0.1", "query": "x.example.com", "rcode_name": "NXDOMAIN", "answers": ["9.9.9.9"]},
        {"type": "USER_LOGIN", "acct": "root", "hostname": "lx", "res": "failed", "exe": "/usr/sbin/sshd", "pid": 7, "timestamp": 1704067200},
        {"type": "sudo", "acct": "amy", "hostname": "lx", "timestamp": 1704067200},
        {"source": "edr", "event_type": "file_read", "action": "read", "timestamp": "2024-01-01T00:00:00+00:00", "host": "g", "odd": 1},
        {"source": "nowhere", "event_type": "file_read", "action": "x" * 9000, "timestamp": "2024-01-01T00:00:00Z"},
        {"EventID": 4625, "Computer": "WS-1"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "seq long, j string").select("seq", F.parse_json("j").alias("raw"))
    good, bad = validate(normalize(df))
    g = {r["seq"]: r for r in good.drop("raw").collect()}
    assert (g[0]["event_type"], g[0]["action"], g[0]["outcome"], g[0]["privilege"], g[0]["user"]) == ("authentication", "login_failure", "failure", "rdp", "bob")
    assert (g[1]["process_name"], g[1]["parent_process_name"]) == ("cmd.exe", "WINWORD.EXE")
    assert (g[2]["event_type"], g[2]["tags"]) == ("process_access", ["lsass_access", "suspicious_access"])
    assert (g[3]["event_type"], g[3]["dst_port"], g[3]["process_name"]) == ("network_connection", 443, "x.exe")
    assert (g[4]["process_name"], g[4]["command_line"]) == ("powershell.exe", "IEX (x)")
    assert (g[5]["bytes_out"], g[5]["bytes_in"], g[5]["dst_ip"], g[5]["outcome"]) == (100, None, "8.8.8.8", "success")
    assert (g[6]["event_type"], g[6]["outcome"], g[6]["dst_ip"]) == ("dns_query", "nxdomain", "9.9.9.9")
    assert (g[7]["action"], g[7]["process_name"], g[7]["process_id"]) == ("login_failure", "sshd", 7)
    assert (g[8]["action"], g[8]["privilege"]) == ("sudo_success", "root")
    assert g[9]["source"] == "edr"
    b = {r["seq"]: set(r["violations"]) for r in bad.select("seq", "violations").collect()}
    assert b == {10: {"unknown source", "action too long"}, 11: {"timestamp missing or unreadable"}}


def test_line_files_and_archives(spark, tmp_path):
    text = '{"a": 1}\n\nnot json\n{"b": 2}\n'
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write(text)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("m.jsonl", text)
        z.writestr("skip.txt", text)
    for good, bad in (raw.read_raw_jsonl(spark, str(tmp_path / "x.jsonl.gz")), raw.read_zipped_jsonl(spark, str(tmp_path / "x.zip"))):
        assert (good.count(), bad.count()) == (2, 1)


def test_feeds_load_in_name_order(spark, tmp_path):
    (tmp_path / "feodo_a.csv").write_text('# c\n"first_seen_utc","dst_ip","dst_port","c2_status","last_online","malware"\n"2024-01-01","9.9.9.1","443","online","2024-02-01","Fam"\n')
    (tmp_path / "urlhaus.csv").write_text('# c\n"1","2024-01-01","http://bad.example.com/x","online","","malware_download","exe,zip","l","r"\n"2","2024-01-01","http://9.9.9.2/x","online","","","","l","r"\n')
    (tmp_path / "threatfox.json").write_text(json.dumps({"1": [{"ioc_type": "ip:port", "ioc_value": "9.9.9.3:80", "confidence_level": 50, "malware_printable": "M"}, {"ioc_type": "sha256_hash", "ioc_value": "AB"}]}))
    (tmp_path / "spamhaus_drop.txt").write_text("; c\n9.9.8.0/24 ; SBL1\n9.9.0.0/16\n")
    (tmp_path / "z_own.json").write_text(json.dumps([{"value": "9.9.9.1", "type": "ip", "threat": "newer", "country": "RU"}, {"value": "q", "type": "odd"}]))
    (tmp_path / "broken.json").write_text("{not json")
    iocs = feeds.load_iocs(spark, str(tmp_path))
    now = {(r["type"], r["value"]): r for r in current_iocs(iocs).collect()}
    assert set(now) == {("ip", "9.9.9.1"), ("url", "http://bad.example.com/x"), ("domain", "bad.example.com"), ("url", "http://9.9.9.2/x"), ("ip", "9.9.9.3"), ("hash", "AB"), ("cidr", "9.9.8.0/24"), ("cidr", "9.9.0.0/16")}
    assert now["ip", "9.9.9.1"]["threat"] == "newer" and now["ip", "9.9.9.3"]["confidence"] == 0.5
    seen = spark.createDataFrame([("9.9.8.7", "ip"), ("9.9.7.7", "ip"), ("8.8.8.8", "ip"), ("www.BAD.example.com.", "domain"), ("com", "domain")], "observed string, kind string").withColumn("id", F.col("observed"))
    got = {r["id"]: r["ioc"]["value"] for r in match_observables(seen, iocs, ["id"]).collect()}
    assert got == {"9.9.8.7": "9.9.8.0/24", "9.9.7.7": "9.9.0.0/16", "www.BAD.example.com.": "bad.example.com"}
    feeds.write_iocs(iocs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "json")).count() == 8

import ipaddress
import math

from helpers import event, frame
from pyspark.sql import functions as F

from nightjar.functions.conditions import holds
from nightjar.functions.net import is_private_ip
from nightjar.functions.text import base_name, shannon_entropy, url_host

EDGES = ["0.0.0.0", "0.255.255.255", "1.0.0.0", "9.255.255.255", "10.0.0.0", "11.0.0.0", "100.64.0.1", "126.1.1.1", "127.0.0.1", "128.0.0.1", "169.253.255.255", "169.254.0.0", "169.255.0.0",
         "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.0.99", "192.0.1.0", "192.0.2.1", "192.167.1.1", "192.168.0.1", "192.169.0.0",
         "198.17.1.1", "198.18.0.0", "198.19.255.255", "198.20.0.0", "198.51.99.1", "198.51.100.1", "203.0.112.1", "203.0.113.9", "223.255.255.255", "224.0.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255",
         "::1", "fe80::1", "fc00::1", "ff02::1", "2001:4860:4860:0:0:0:0:8888", "2001:db8::1", "2606:4700:4700::1111", "not an ip", "01.2.3.4", "1.2.3", ""]


def expected(value):
    try:
        ip = ipaddress.ip_address(value)
    except ValueError:
        return True
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved


def test_private_addresses_match_the_registry(spark):
    got = spark.createDataFrame([(v,) for v in EDGES], "ip string").select("ip", is_private_ip(F.col("ip")).alias("p")).collect()
    assert {r["ip"]: r["p"] for r in got} == {v: expected(v) for v in EDGES}


def test_text_helpers(spark):
    row = spark.createDataFrame([("aabb", "C:\\x\\Y.exe", "http://h.example.com/a")], "a string, b string, c string").select(
        shannon_entropy(F.col("a")).alias("e"), base_name(F.col("b")).alias("b"), url_host(F.col("c")).alias("h")).first()
    assert math.isclose(row["e"], 1.0) and (row["b"], row["h"]) == ("Y.exe", "h.example.com")


def test_matcher_truth_table(spark):
    df = frame(spark, [event(0, host="WS-1", bytes_out=5, domain="a.b"), event(1, host=None), event(2, host="")])
    cases = [({"host": "ws-1"}, [0]), ({"host": {"neq": "ws-1"}}, [1, 2]), ({"host": {"in": ["WS-1"]}}, [0]), ({"host": {"not_in": ["x"]}}, [0, 2]), ({"host": {"exists": True}}, [0]),
             ({"host": {"exists": False}}, [1, 2]), ({"bytes_out": {"gte": 5}}, [0]), ({"host": {"gte": 5}}, []), ({"not": {"host": {"gte": 5}}}, [1]), ({"dst_ip": {"private": True}}, []),
             ({"unknown": {"exists": False}}, [0, 1, 2]), ({"any_of": [{"host": ""}, {"domain": "A.B"}]}, [0, 2]), ({"domain": {"len_gte": 3}}, [0])]
    for spec, want in cases:
        assert [r["seq"] for r in df.where(holds(df, spec)).orderBy("seq").collect()] == want, spec


def test_raw_fallback(spark):
    from nightjar.functions.conditions import with_raw_fields
    df = frame(spark, [event(0)]).withColumn("raw", F.parse_json(F.lit('{"ObjectType": "SecretObject", "domain": "x.y"}')))
    df = with_raw_fields(df, {"ObjectType", "domain"})
    assert df.where(holds(df, {"ObjectType": {"in": ["secretobject"]}, "domain": "X.Y"})).count() == 1

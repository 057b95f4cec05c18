"""Edge cases of the text rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from traceloom.functions import actions, edge_text as T, names as N, times
from traceloom.operators import cleaning as C


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()[0]


@pytest.mark.parametrize("ts,keep", [("PM", False), ("am", False), ("...", True), ("12:3", False), ("10:00", True), ("no digits", False)])
def test_timestamps(spark, ts, keep):
    assert one(spark, T.has_usable_timestamp, ts) is keep


@pytest.mark.parametrize("a,b,keep", [("abc", "abd", False), ("abc", "abcd", False), ("abc", "abc", True), ("abc", "xyz", True), ("ab", "ba", True)])
def test_near_equal(spark, a, b, keep):
    assert one(spark, T.ends_not_near_equal, a, b) is keep


@pytest.mark.parametrize("raw,want", [("[[x]]", "x"), ("[x", "[x"), ("[[ ]]", "[ ]"), ("[[a] b]", "[a] b"), ("[]", "[]")])
def test_brackets(spark, raw, want):
    assert one(spark, T.unwrap_brackets, raw) == want


@pytest.mark.parametrize("raw,want", [("a, b(c, d), e", ["a", "b(c, d)", "e"]), ("x", ["x"])])
def test_comma_parts(spark, raw, want):
    assert one(spark, T.comma_parts, raw) == want


@pytest.mark.parametrize("raw,want", [
    ("A handle to an object was requested.", "handle_requested"), ("Accesses READ_CONTROL", "read_control"), ("", "unknown"),
    ("Accesses WriteData", "writedata"), ("x" * 60, "x" * 50), ("Main Thread", "main_thread")])
def test_actions(spark, raw, want):
    assert one(spark, actions.normalize_action, raw) == want


# hand-derived from the numeric rules
@pytest.mark.parametrize("raw,want", [
    ("C:\\\\Users\\bob12\\file-3.txt", "C:/Users/bob/file-.txt"), ("/var/log/syslog.1", "var/log/syslog.1"), ("/proc/123/maps", "proc/maps"),
    ("/tmp/a_12b3/c", "tmp/ab/c"), ("archive.verylongext", "archive"), ("archive.known12", "archive.known12"), ("12345", ""),
    ("/home/u/.bashrc", "home/u/.bashrc"), ("/lib/libc-2.31.so", "lib/libc-.31.so")])
def test_paths(spark, raw, want):
    known = spark.createDataFrame([(".known12",)], "extension string")
    got = C.normalize_paths(spark.createDataFrame([(raw,)], "name string"), known).first()["processed"]
    assert got == want


@pytest.mark.parametrize("raw,want", [
    ("192.168.0.1", True), ("192.168.0.1:80", True), ("300.1.1.1", True), ("::1", True), ("[fe80::1]:443", True), ("fe80:0:0:1", True),
    ("host.example.com", False), ("http://1.2.3.4:80", False), ("", False), ("abc", False)])
def test_addresses(spark, raw, want):
    # 300.1.1.1 is no valid IPv4 address but passes as a text of digits and dots
    assert one(spark, N.is_ip_address, raw) is want


@pytest.mark.parametrize("ts,kind,want", [
    ("2018-11-02 22:01:02.5", "dns", "2018-11-02 22:01:02.500000"), ("10:01:02 PM", "audit", "2018-11-02 22:01:02.000000"),
    ("12:01:02 AM", "audit", "2018-11-02 00:01:02.000000"), ("10:01:02 PM", "dns", "2018-11-02 22:00:00.000000"), (None, "audit", "2018-11-02 22:00:00.000000"),
    ("99:00:00 PM", "audit", "2018-11-02 22:00:00.000000")])
def test_normalize_timestamp(spark, ts, kind, want):
    assert one(spark, times.normalize_timestamp, ts, "2018-11-02 22:00:00_2018-11-02 23:00:00", kind) == want


def test_list_and_types(spark):
    assert one(spark, N.parse_list, "['a', \"b\", '']") == ["a", "b"]
    assert one(spark, lambda c: N.compound_type(N.parse_list(c)), "['B', 'a', 'b']") == "a+b"
    assert one(spark, lambda c: N.longest_name(N.parse_list(c)), "['datum', 'xy', 'zz', 'q']") == "xy"


@pytest.mark.parametrize("raw", ["0x0", "0xFFFFFFFFFFFFFFFF", "0x10000000000000000", "0x" + "0" * 30, "0x" + "f" * 64, "0x000" + "9a3" * 40, " 0X1" + "0" * 17 + " "])
def test_hex_of_any_length(spark, raw):
    assert one(spark, N.hex_to_decimal, raw) == str(int(raw, 16))

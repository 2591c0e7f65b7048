import datetime as dt

import pytest
from pyspark.sql import functions as F

from logtables.functions import syslog
from logtables.functions.text import WHITESPACE, tokens, trimmed
from logtables.operators import parse

ARRIVED = dt.datetime(2024, 5, 6, 7, 8, 9)


@pytest.fixture(scope="module")
def to_lines(spark):
    def build(texts):
        rows = [(i, ARRIVED, "node-0", text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "seq long, received_at timestamp, node_id string, line string")

    return build


def one(lines):
    rows = parse.to_messages(lines).collect()
    assert len(rows) == 1
    return rows[0]


def test_plain_header(to_lines):
    row = one(to_lines(["<34>Oct 11 22:14:15 mymachine su: 'su root' failed for lonvick on /dev/pts/8"]))
    assert (row.priority, row.facility, row.severity, row.hostname) == (34, 4, 2, "mymachine")
    assert row.message == "su: 'su root' failed for lonvick on /dev/pts/8"
    assert not row.is_rfc5424 and row.app_name is None
    assert (row.event_ts, row.ts_source) == (ARRIVED, "received")


def test_structured_header(to_lines):
    row = one(to_lines(["<34>1 2003-10-11T22:14:15.003Z myhost myapp 1234 ID47 - Message content"]))
    assert (row.hostname, row.app_name, row.procid, row.msgid) == ("myhost", "myapp", "1234", "ID47")
    assert (row.message, row.structured_data, row.ts_source) == ("Message content", None, "header")
    assert row.event_ts == dt.datetime(2003, 10, 11, 22, 14, 15, 3000)


def test_structured_data(to_lines):
    row = one(to_lines(['<34>1 2003-10-11T22:14:15.003Z myhost myapp 1234 ID47 [exampleSDID@32473 iut="3"] Message with SD']))
    assert (row.structured_data, row.message) == ('exampleSDID@32473 iut="3"', "Message with SD")


ACCEPTED = [
    ("<191>Oct  1 00:00:00 h m", dict(facility=23, severity=7, hostname="h", message="m", is_rfc5424=False)),
    ("<255>Oct 1 00:00:00 h m", dict(facility=31, severity=7)),
    ("<034>Oct 1 00:00:00 - m", dict(priority=34, hostname="-")),
    ("<34>1 - - - - - - m", dict(hostname=None, app_name=None, procid=None, msgid=None, structured_data=None, message="m")),
    ("<34>1 garbage h a p i - m", dict(event_ts=ARRIVED, ts_source="received")),
    ("<34>1 - h a p i -", dict(message="", structured_data=None)),
    ("<34>1 - h a p i -foo", dict(structured_data=None, message="foo")),
    ("<34>1 - h a p i [] m", dict(structured_data="", message="m")),
    ("<34>1 - h a p i [a][b] m", dict(structured_data="a", message="[b] m")),
    ("<34>1\t-\th a p i - m", dict(hostname="h", message="m")),
    ("<34>1 - h a p i [x y\nz]  two  blanks", dict(structured_data="x y\nz", message="two  blanks")),
    ("  <34>1 - h a p i - m $1 \\n 　", dict(message="m $1 \\n")),
    ("<34>1 - hé a\u001fb p i [k\u001f] ünï\n code", dict(hostname="hé", app_name="a\u001fb", structured_data="k\u001f", message="ünï\n code")),
    ("<34>x\ty\tz q r s  t u", dict(hostname="s", message="t u", is_rfc5424=False)),
]


@pytest.mark.parametrize("line, expected", ACCEPTED)
def test_accepted(to_lines, line, expected):
    row = one(to_lines([line])).asDict()
    assert {name: row[name] for name in expected} == expected


REJECTED = [
    ("", None, "empty"),
    (" \t  ", None, "empty"),
    ("no pri", "rfc3164", "bad_pri"),
    ("<>Oct 1 00:00:00 h m", "rfc3164", "bad_pri"),
    ("<256>Oct 1 00:00:00 h m", "rfc3164", "pri_range"),
    ("<99999999999999999999>Oct 1 00:00:00 h m", "rfc3164", "pri_range"),
    ("<34>Oct 1 00:00:00 h", "rfc3164", "bad_header"),
    ("<34>2023 x y h m", "rfc5424", "bad_header"),
    ("<34>1 - h a b p i - m", "rfc5424", "bad_header"),
    ("<34>300 - h a p i - m", "rfc5424", "version_range"),
    ("<34>1 - h a p i [a m", "rfc5424", "bad_sd"),
    ("<34>1 - h a p i m", "rfc5424", "bad_sd"),
]


def test_quarantine(to_lines):
    lines = to_lines([line for line, _, _ in REJECTED])
    assert parse.parse_lines(lines).count() == 0
    rows = parse.quarantine(lines).orderBy("seq").collect()
    assert [(r.line, r.protocol, r.reason) for r in rows] == REJECTED


def test_every_line_is_judged_once(to_lines):
    lines = to_lines([line for line, *_ in ACCEPTED + REJECTED])
    quality = parse.parse_quality(lines).collect()
    assert sum(r.n_lines for r in quality) == len(ACCEPTED) + len(REJECTED)
    assert sum(r.n_lines for r in quality if r.outcome == "ok") == len(ACCEPTED)


TIMES = [
    ("2023-10-11T22:14:15Z", "2023-10-11 22:14:15"),
    ("2023-10-11t22:14:15.123456789z", "2023-10-11 22:14:15.123456"),
    ("2023-10-11T22:14:15.5+02:30", "2023-10-11 19:44:15.5"),
    ("2023-10-11T22:14:15-23:59", "2023-10-12 22:13:15"),
    ("2023-10-11T22:14:15+19:00", "2023-10-11 03:14:15"),
    ("2016-12-31T23:59:60.250Z", "2017-01-01 00:00:00.25"),
    ("2016-12-31T23:59:60+01:00", "2016-12-31 23:00:00"),
    ("2023-10-11T22:14:61Z", None),
    ("2023-10-11T22:14:15+24:00", None),
    ("2023-10-11T22:14:15", None),
    ("2023-10-11", None),
    ("2023", None),
    ("2023-02-30T00:00:00Z", None),
    ("2023-02-28T24:00:00Z", None),
    ("-", None),
    ("", None),
    (None, None),
]


def test_header_times(spark):
    rows = spark.createDataFrame(TIMES, "text string, expected string")
    got = rows.select("text", syslog.rfc3339_time(F.col("text")).cast("string").alias("got"), "expected").collect()
    assert [(r.text, r.got) for r in got] == [(r.text, r.expected) for r in got]


def test_severity_names(spark):
    rows = spark.range(9).select(syslog.severity_name(F.col("id").cast("int"))).collect()
    assert [r[0] for r in rows] == ["emerg", "alert", "crit", "err", "warn", "notice", "info", "debug", "unknown"]


def test_whitespace_is_trimmed_and_split(spark):
    text = WHITESPACE + "a" + WHITESPACE + "b​c" + WHITESPACE
    row = spark.createDataFrame([(text,)], "t string").select(trimmed(F.col("t")), tokens(F.col("t"))).first()
    assert row[0] == "a" + WHITESPACE + "b​c"
    assert row[1] == ["a", "b​c"]
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace() and i not in (0x1C, 0x1D, 0x1E, 0x1F)}


def test_nodes_are_stamped(spark, to_lines):
    messages = parse.to_messages(to_lines(["<1>Oct 1 00:00:00 a m", "<1>Oct 1 00:00:00 b m"]))
    assert {r.node_id for r in parse.tag_node(messages, "x").collect()} == {"x"}
    owners = spark.createDataFrame([("a", "node-9")], "hostname string, node_id string")
    tagged = parse.tag_nodes(messages, owners, "hostname").collect()
    assert {(r.hostname, r.node_id) for r in tagged} == {("a", "node-9"), ("b", "node-0")}


def test_the_line_pattern_runs_once(to_lines):
    plan = parse.parse_lines(to_lines(["x"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(syslog.RFC5424_LINE) == 1

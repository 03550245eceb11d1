"""The flow view with more users than one octet and more sessions than six digits."""

import duckdb
import pytest

from tidewire.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def compared(spark, d, name):
    """(rows by SQL, rows of SQL only, rows of Spark only)."""
    out = f"{d}/out_{name}"
    QUERIES[name](spark, str(d)).write.parquet(out)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    con.execute(f"CREATE TABLE a AS {SQL[name]}")
    columns = ", ".join(c[0] for c in con.execute("DESCRIBE a").fetchall())
    con.execute(f"CREATE VIEW b AS SELECT {columns} FROM '{out}/*.parquet'")
    one = lambda text: con.execute(f"SELECT count(*) FROM ({text})").fetchall()[0][0]
    return one("FROM a"), one("FROM a EXCEPT ALL FROM b"), one("FROM b EXCEPT ALL FROM a")


def events(folder, n, user):
    kinds = "['view', 'click', 'purchase', 'signup', 'error']"
    duckdb.connect().execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i % 2592000) AS ts, {user} AS user_id, {kinds}[i * 7 % 11 % 5 + 1] AS event_type, i % 977 / 10.0 AS value, '{{}}' AS props FROM range({n}) r(i)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


@pytest.fixture(scope="module")
def many_users(tmp_path_factory):
    """Users on both sides of 64,000, where the third number passes 255, and of 16,384,000, where it passes 65,535."""
    return events(tmp_path_factory.mktemp("many_users"), 3000, "[0, 63900, 16383900][i % 3 + 1] + i * 31 % 200")


@pytest.mark.parametrize("name", ["decode_frames", "decode_dns", "decode_failures", "payload_bytes", "sessions_of_frames"])
def test_frames_of_any_user(spark, many_users, name):
    rows, *differ = compared(spark, many_users, name)
    assert rows and differ == [0, 0]


def test_rules_over_frames_of_any_user(spark, many_users):
    QUERIES["builtin_rules_on_frames"](spark, str(many_users)).collect()


@pytest.fixture(scope="module")
def far_users(tmp_path_factory):
    """Users whose addresses three octets don't hold; each second one has the octets of the one before."""
    return events(tmp_path_factory.mktemp("far_users"), 3000, "[5, 4030464005, 4030463900, 8060927900, 60000000000][i % 5 + 1] + i // 10 % 3")


@pytest.mark.parametrize("name", ["decode_frames", "decode_dns", "decode_failures", "payload_bytes", "sessions_of_frames"])
def test_frames_of_users_beyond_four_octets(spark, far_users, name):
    rows, *differ = compared(spark, far_users, name)
    assert rows and differ == [0, 0]


@pytest.mark.parametrize("name", ["decode_frames", "decode_dns", "decode_failures", "payload_bytes"])
def test_frames_of_the_last_user_of_a_long(spark, tmp_path, name):
    rows, *differ = compared(spark, events(tmp_path, 300, "9223372036854775807 - i"), name)
    assert rows and differ == [0, 0]


def test_rules_keep_users_beyond_four_octets_apart(spark, tmp_path):
    """Two users with the same octets flood within a few seconds; each is a group."""
    slow = events(tmp_path, 6000, "[5, 4030464005][i % 2 + 1]")
    (folder := tmp_path / "fast").mkdir()
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_milliseconds(event_id) AS ts) FROM '{slow}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    groups = {r.grp for r in QUERIES["builtin_rules_on_frames"](spark, str(folder)).collect() if r.rule_id == "NET-TCP-SYN-BURST-001"}
    assert any("10.0.0.6" in g for g in groups) and any("10.0.16121856.6" in g for g in groups)


@pytest.fixture(scope="module")
def many_sessions(tmp_path_factory):
    """A little more than a million sessions, a user each."""
    return events(tmp_path_factory.mktemp("many_sessions"), 1_050_000, "i")


@pytest.mark.parametrize("name", ["conversations_by_packets", "packet_session_lookup", "session_table"])
def test_ids_beyond_six_digits_are_those_of_the_sql(spark, many_sessions, name):
    rows, *differ = compared(spark, many_sessions, name)
    assert rows and differ == [0, 0]


def test_the_operators_own_ids_stay_unique(spark):
    from tidewire.operators.sessions import with_session_ids

    ids = with_session_ids(spark.range(1_000_005).selectExpr("id AS first_seq"))
    assert ids.select("id").distinct().count() == 1_000_005 and ids.where("first_seq = 1000004").first().id == "S-1000005"


@pytest.fixture(scope="module")
def late_sessions(many_sessions, tmp_path_factory):
    """The same sessions; those beyond the millionth have the most bytes."""
    folder = tmp_path_factory.mktemp("late_sessions")
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id >= 1040000 THEN 5 + event_id % 900 / 100.0 ELSE 0.0 END AS value) FROM '{many_sessions}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["conversations_by_bytes", "session_client_server"])
def test_late_sessions_have_the_ids_of_the_sql(spark, late_sessions, name):
    rows, *differ = compared(spark, late_sessions, name)
    assert rows and differ == [0, 0]


def test_busy_late_sessions_have_the_ids_of_the_sql(spark, tmp_path):
    """Three users beyond the millionth session send the most packets."""
    rows, *differ = compared(spark, events(tmp_path, 1_050_000, "CASE WHEN i < 1045000 THEN i ELSE 1045000 + i % 3 END"), "conversations_by_packets")
    assert rows and differ == [0, 0]

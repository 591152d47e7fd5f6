import glob
import gzip
import hashlib

import duckdb
import pytest

from tessella.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload string, record_type string"


def want(rows, least=0):
    best = {}
    for i, _, h, *_ in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        again = len(body) >= least and best.get(h or "", i) != i
        out.append((i, len(body), warc.digest(body), "revisit" if again else "response", best[h or ""] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip_of_odd_rows(spark, tmp_path, least):
    rows = [(i * 13 % 101 - 20, f"http://x/{i}\r\né", ["<p>é</p>", None, "", "a", "WARC/1.1\r\n\r\n" * 3, f"u{i}", "z" * 200_000][i % 7], "", "") for i in range(101)]
    rows += [(None, None, "a", "", ""), (None, "n", "no id", "", ""), (None, "n", "no id", "", ""), (None, "m", "no id", "", ""), (500, "v", "other of 500", "", ""), (500, None, "y" * 3_000_000, "", ""), (500, None, "a", "", ""), (500, None, "a", "", ""), (1 << 60, "u", "far", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    warc.write(df, f"file://{tmp_path}/a", least=least, shard_bytes=100_000, file_bytes=500)
    out = warc.read(spark, f"file://{tmp_path}/a")
    assert got(out) == want(rows, least)
    texts = {(r["page_id"], bytes(r["payload"]).decode()) for r in out.where("payload is not null").collect()}
    assert texts <= {(r[0], r[2] or "") for r in rows}


def test_shards_follow_bytes_whatever_the_ids(spark, tmp_path):
    rng = __import__("random").Random(5)
    ids = [*range(200), 1 << 62, -(1 << 62)]
    rows = [(i, None, "".join(rng.choice("abc") for _ in range(1000)), "", "") for i in ids] + [(None, None, f"{k} " * 400, "", "") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = warc.write(df, f"file://{tmp_path}/a", shard_bytes=20_000).collect()
    assert got(warc.read(spark, f"file://{tmp_path}/a")) == want(rows)
    assert len({r["shard"] for r in m}) >= 16 and max(r["records"] for r in m) <= 30
    limits, lost = warc.bounds(df.select("page_id", "html").selectExpr("page_id AS id", "octet_length(html) AS bytes"), 20_000)
    assert limits == sorted(set(limits)) and lost >= 3
    got_ = spark.range(-5, 250).select("id", warc.count_upto(limits, warc.F.col("id")).alias("n")).collect()
    assert all(r["n"] == sum(x <= r["id"] for x in limits) for r in got_)


def test_what_a_lost_attempt_left_is_written_over(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text", "", "")], SCHEMA)
    warc.write(df, f"file://{tmp_path}/a")
    (file,) = glob.glob(f"{tmp_path}/a/files/*.gz")
    before = open(file, "rb").read()
    open(file, "wb").write(b"half a file")
    warc.write(df, f"file://{tmp_path}/a")
    assert open(file, "rb").read() == before and got(warc.read(spark, f"file://{tmp_path}/a")) == want([(1, "u", "text")])


def test_files_are_the_same_every_time_and_leave_no_debris(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "t" * (i % 50) * 30, "", "") for i in range(300)]
    for k, df in (("a", spark.createDataFrame(rows, SCHEMA)), ("b", spark.createDataFrame(rows[::-1], SCHEMA).repartition(7))):
        m = warc.write(df, f"file://{tmp_path}/{k}", shard_bytes=50_000, file_bytes=4_000).collect()
        assert len(m) > 5 and all(hashlib.sha256(open(f"{tmp_path}/{k}/{r['file']}", "rb").read()).hexdigest() == r["sha256"] for r in m)
    files = {k: {f.rsplit("/", 1)[1]: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/{k}/files/*")} for k in "ab"}
    assert files["a"] == files["b"] and not glob.glob(f"{tmp_path}/a/files/.tmp*")
    first = gzip.open(sorted(glob.glob(f"{tmp_path}/a/files/*"))[0]).read()
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_broken_archives_are_refused(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "text", "", "")], SCHEMA), f"file://{tmp_path}/a")
    (file,) = glob.glob(f"{tmp_path}/a/files/*.gz")
    data = gzip.open(file).read()
    for bad in (data.replace(b"text\r\n", b"tixt\r\n"), data[:-9]):
        open(file, "wb").write(gzip.compress(bad))
        with pytest.raises(Exception, match="does not match|cut off"):
            warc.read(spark, f"file://{tmp_path}/a").collect()
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    rows = con.execute("select page_id, url, html from pages").fetchall()
    assert got(queries.op9_warc(spark, sf)) == want(rows)

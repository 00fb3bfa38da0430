import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from roompulse.llm import blockindex, warc
from tests.llm.conftest import with_clashes

PAGES = "page_id bigint, url string, html string"


def brute(rows, least=0):
    keeper = {}
    for i, _, h in rows:
        h = h or ""
        keeper[h] = max(i, keeper.get(h, i), key=lambda x: -1 if x is None else x) if h in keeper else i
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= least and keeper[h or ""] != i
        out.append((i, "revisit" if again else "response", base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data),
                    keeper[h or ""] if again else None))
    return sorted(out, key=repr)


def back(df, tmp_path, **more):
    archive = warc.archived(df, f"file://{tmp_path}/a", **more)
    return archive, sorted(map(tuple, warc.read_back(archive, df).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    pages = ["<p>%s</p>" % " ".join(rng.choices(["a", "é", "\r\n\r\n", "日本", "\x00", "WARC/1.1"], k=rng.randrange(80))) for _ in range(40)]
    hosts = ["http://www.example.%s/%s" % (t, p) for t in ("com", "org") for p in ("", "a b", "x?y=1&z", "é\n")]
    out = [(i, rng.choice(hosts + [None, "", "HTTPS://u:p@Example.com:443/q#f", "no host"]), rng.choice(pages)) for i in range(300)]
    out += [(900 + i, hosts[0], "the same") for i in range(60)] + [(i, hosts[1], None) for i in (970, 971)]
    out += [(5, None, "five"), (5, None, "five"), (None, None, "nobody"), (None, hosts[2], pages[0]), (980, None, "x" * 3_000_000)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("least", [0, 12])
def test_read_back_equals_brute_force(spark, rows, tmp_path, least):
    df = with_clashes(spark.createDataFrame(rows, PAGES)).repartition(5)
    _, got = back(df, tmp_path, least_bytes=least)
    assert got == brute(rows, least)


def test_one_address(spark, rows, tmp_path):
    """Captures of one address, with the payloads of its responses."""
    df = spark.createDataFrame(rows, PAGES)
    archive, _ = back(df, tmp_path)
    asked = spark.createDataFrame([("https://WWW.example.com:80/#top",), ("http://nowhere.test/",), ("http://www.example.com/",)], "url string")
    found = warc.captures(archive, asked)
    want = [r for r in rows if warc.surt(r[1]) == "com,example,www)/"]
    assert sorted(r["id"] for r in found.collect()) == sorted(r[0] for r in want)
    bodies = {r["id"]: bytes(r["payload"]).decode() for r in warc.fetched(archive, found, payload=True).collect() if r["record_type"] == "response"}
    assert bodies and all(bodies[i] == (h or "") for i, _, h in want if i in bodies)


def test_archives_are_plain_warc(spark, rows, tmp_path):
    """Every record is a gzip member of its own and the whole file is one gzip file."""
    df = spark.createDataFrame(rows, PAGES).repartition(2)
    archive, _ = back(df, tmp_path)
    kinds = []
    for path in (tmp_path / "a/archives").glob("*.warc.gz"):
        data = path.read_bytes()
        while data:
            one = zlib.decompressobj(blockindex.GZIP)
            head, _ = warc.parsed(one.decompress(data) + one.flush())
            kinds.append(head["WARC-Type"])
            data = one.unused_data
    assert kinds.count("warcinfo") == 2 and len(kinds) == len(rows) + 2


def test_damaged_record_is_told(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.test/", "body")], PAGES)
    archive, _ = back(df, tmp_path)
    other = warc.packed(warc.record(1, "http://a.test/", b"other", warc.digest_of(b"body")))
    path = next((tmp_path / "a/archives").glob("*.warc.gz"))
    at = warc.captures(archive, df).first()
    path.write_bytes(path.read_bytes()[:at["offset"]] + other)
    changed = warc.captures(archive, df).withColumn("length", F.lit(len(other)))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.fetched(archive, changed).collect()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], PAGES)
    archive, got = back(df, tmp_path)
    assert got == [] and archive.index.names == []


@pytest.mark.parametrize("lines", [1, 3, 1000])
def test_look_ups_equal_a_scan(spark, tmp_path, lines):
    """Keys that fill blocks and parts, that begin or end one, or lie before, between and behind all."""
    rng = random.Random(4)
    rows = [("k%02d" % rng.randrange(40), "v %d" % i) for i in range(200)] + [("k20", "hot %d" % i) for i in range(300)]
    index = blockindex.build(spark.createDataFrame(rows, "key string, value string").repartition(6), f"file://{tmp_path}/i", lines)
    asked = ["k%02d" % i for i in range(0, 40, 2)] + ["", "a", "k", "k05x", "z", "k20"]
    got = blockindex.look_up(index, spark.createDataFrame([(k,) for k in asked] + [(None,)], "key string"))
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] in asked)
    reader = blockindex.Reader(index)
    assert set(reader.get(k.encode() for k in asked)) == {k.encode() for k, _ in rows if k in asked}


def test_keys_sort_by_host():
    assert warc.surt("http://user@www.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert warc.surt("https://example.com:8080") == "com,example:8080)/" and warc.surt("//h.test/x y") == "test,h)/x%20y"
    assert warc.surt(None) == warc.surt("") == ")/" and warc.surt("http://[::1]:443/é") == "[::1])/é"


def test_no_payload_is_shuffled(spark, rows, tmp_path, monkeypatch):
    """Archives are written from the scan: no exchange lies between."""
    kept = {}

    def keep(df, name):
        kept[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)
    real = warc.staged
    monkeypatch.setattr(warc, "staged", keep)
    back(spark.createDataFrame(rows, PAGES), tmp_path)
    assert "MapInArrow" in kept["warc-captures"] and "Exchange" not in kept["warc-captures"]

"""Archives: an exact round trip, a plain reader of gzip files, splits, damage, and the query's SQL."""

import base64
import gzip
import hashlib
import random

import duckdb
import pytest
from helixlake.llm import warc
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def plain_records(data):
    """(headers, block) of each record of decompressed archives, by their lengths alone."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        assert version == "WARC/1.1"
        head = dict(x.split(": ", 1) for x in lines)
        at = end + 4 + int(head["Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        yield head, data[end + 4 : at]
        at += 4


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é中\r\n<>&") for _ in range(300_000))
    texts = ["<p>same</p>", "<p>same</p>", "<p>same</p>", None, "", "one", noise, noise, "\r\n\r\nWARC/1.1\r\n\r\n", "x" * 2_000_000, "HTTP/1.1 200 OK\r\n\r\n", *(f"page {i}" * (i % 50) for i in range(120))]
    out = [(i * 3 - 50, rng.choice(["http://a.b/c?d=e&f", None, "", "http://x/é\r\nWARC-Type: x", "tab\tand blank"]), t) for i, t in enumerate(texts)]
    return [*out, (4, "u", "twice"), (4, "u", "twice"), (4, "u", "other"), (9, "u", "twice"), (9, "u", "twice"), (None, None, "twice"), (None, "n", "null only"), (None, "n", "null only")]


def plain_answer(rows, least=0):
    most = {}
    for i, _, t in rows:
        if i is not None:
            most[t or ""] = max(i, most.get(t or "", i))
    out = []
    for i, _, t in rows:
        keep = most.get(t or "")
        again = keep is not None and keep != i and len((t or "").encode()) >= least
        out.append((i, len((t or "").encode()), digest(t or ""), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=repr)


def answer(df):
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*):", 1).try_cast("bigint")
    return sorted([tuple(r) for r in df.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to")).collect()], key=repr)


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("most", [warc.BROADCAST_GROUPS, 0])
def test_round_trip(spark, rows, least, most, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", most)
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "original", "sha", "record_id", "a.b")}).repartition(3)
    found = warc.through_archives(pages, least=least)
    assert answer(found) == plain_answer(rows, least)
    assert found.where("not verified").count() == 0


def test_files_are_plain_gzip(spark, rows, tmp_path):
    """Any gzip reader sees the records; those are read by length; payloads come back whole, in splits of any size."""
    path = str(tmp_path / "a")
    pages = warc.with_originals(spark.createDataFrame(rows, SCHEMA).repartition(3))
    warc.write_archives(pages, path)
    want = sorted((r["html"], r["url"]) for r in pages.where("original is null").collect() if r["url"] is not None and r["url"].isprintable() and " " not in r["url"])
    files = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-")]
    seen = [x for p in files for x in plain_records(gzip.decompress(p.read_bytes()))]
    assert len(seen) == len(rows) and sum(h["WARC-Type"] == "revisit" for h, _ in seen) == sum(r[4] is not None for r in plain_answer(rows))
    for head, block in seen:
        assert head["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if head["WARC-Type"] == "response":
            assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block.split(b"\r\n\r\n", 1)[1]).digest()).decode()
    for size in "128m", "1000", "4099", "65536":
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = warc.read_archives(spark, path, payload=True).cache()
            assert got.count() == len(rows) and got.where("not verified").count() == 0
            have = sorted((r["payload"].decode(), r["target_uri"]) for r in got.where("record_type = 'response'").collect() if r["target_uri"] is not None and "%" not in r["target_uri"])
            assert have == want
            got.unpersist()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def foreign(kind, payload, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{len(payload)}>", "Content-Length": str(len(payload)), **more}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def test_archives_of_others_and_damage(spark, tmp_path):
    rng = random.Random(8)
    bodies = [b"", b"a" * 70_000, bytes(rng.randrange(256) for _ in range(200_000)), b"\x1f\x8b\x08 inside"]
    sha = "sha1:" + base64.b32encode(hashlib.sha1(bodies[1]).digest()).decode()
    good = [gzip.compress(foreign("resource", b, **({"WARC-Block-Digest": sha} if k == 1 else {}))) for k, b in enumerate(bodies)]
    (tmp_path / "good.warc.gz").write_bytes(b"".join(good))
    got = warc.read_foreign(spark, str(tmp_path / "good.warc.gz"), payload=True).collect()
    assert [r["payload"] for r in got] == bodies and all(r["verified"] for r in got)
    broken = bytearray(good[2])
    broken[len(broken) // 2] ^= 255
    cases = {
        "bits": (good[0] + bytes(broken) + good[1], [True, False, True]),
        "digest": (gzip.compress(foreign("resource", b"b" * 70_000, **{"WARC-Block-Digest": sha})) + good[0], [False, True]),
        "length": (gzip.compress(foreign("resource", b"abc", **{"Content-Length": "2"})) + good[0], [False, True]),
        "negative": (gzip.compress(foreign("resource", b"abc", **{"Content-Length": "-2"})) + good[0], [False, True]),
        "missing": (gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n\r\n\r\n") + good[0], [False, True]),
        "cut": (good[0] + good[2][:-5], [True, False]),
        "nothing": (b"", []),
        "other": (b"no archive", [False]),
        "two": (gzip.compress(foreign("resource", b"a") * 2) + good[0], [False, True]),
    }
    for name, (data, want) in cases.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
        found = list(warc.read_members(data))
        sound = [r[6] for r in found]
        assert [x for k, x in enumerate(sound) if x or k == 0 or sound[k - 1]] == want, name
        assert sorted(r["verified"] for r in warc.read_foreign(spark, str(tmp_path / f"{name}.warc.gz")).collect()) == sorted(sound)


def test_a_revisit_without_its_original_is_not_verified(spark):
    names = [x.split()[0] for x in warc.COLUMNS.split(", ")]
    rows = [("response", "a", None, "u", 3, "D", True), ("revisit", "b", "a", "u", None, "D", True), ("revisit", "c", "a", "u", None, "E", True), ("revisit", "d", "z", "u", None, "D", True), (None, None, None, None, None, None, False)]
    got = {r["record_id"]: (r["payload_bytes"], r["verified"]) for r in warc.resolved(spark.createDataFrame(rows, warc.COLUMNS).select(*names)).collect()}
    assert got == {"a": (3, True), "b": (3, True), "c": (None, False), "d": (None, False), None: (None, False)}


def test_empty_table(spark):
    assert warc.through_archives(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("table", ["small", "awkward"])
def test_query_and_sql(spark, rows, tmp_path, table):
    folder, last = SMALL, ""
    given = [r for r in rows if r[0] is not None]
    if table == "awkward":
        folder, last = str(tmp_path), "/*.parquet"
        spark.createDataFrame(given, SCHEMA).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    got = warc.op12_warc(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet{last}'")
    want = con.execute(warc.OP12_SQL)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    have = sorted([tuple(r) for r in got.select(*names).collect()], key=repr)
    assert have == sorted(want.fetchall(), key=repr)
    if table == "awkward":
        assert sorted([r[:5] for r in have], key=repr) == plain_answer(given)

"""URL filters, mixing and sharding: against SQL, brute force and the promises of their docstrings."""

import datetime as dt
import random
import re
import uuid

import pytest
from conftest import SF, same_rows

from stripelore.llm import registry
from stripelore.llm.mixing import mix_copies, mix_to_targets
from stripelore.llm.sharding import Conflict, SchemaConflict, ShardStore
from stripelore.llm.url_filter import filter_urls
from stripelore.shared import shared_dir

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(name, spark, duck):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_urls_brute_force(spark):
    rnd = random.Random(3)
    hosts = ["a.org", "x.a.org", "y.x.a.org", "b.net", "B.net", "c.b.net"]
    entries = [(f"d:{rnd.choice(hosts).lower()}" if rnd.random() < 0.7 else f"p:{rnd.choice(hosts).lower()}/{rnd.choice('pq')}", rnd.choice(["block", "allow"]), at(rnd.randint(0, 40) / rnd.choice([1, 500]))) for _ in range(60)]
    entries += [entries[0], (None, "block", at(1)), ("d:a.org", None, at(1)), ("d:a.org", "block", None)]
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'u@'])}{rnd.choice(hosts)}{rnd.choice(['', ':80', '.'])}/{rnd.choice(['', 'p', 'p/q', 'q?x', '/p#y'])}" for _ in range(150)]
    captures = [(i, u, at(rnd.randint(0, 45) / rnd.choice([1, 7])), "own") for i, u in enumerate(urls)]
    captures += [(900, None, at(3), "own"), (901, "no url", at(3), "own"), (902, urls[0], None, "own"), captures[5]]
    got = filter_urls(
        spark.createDataFrame(captures, "id long, url string, fetched_at timestamp, rule string"), spark.createDataFrame(entries, "rule string, action string, listed_at timestamp")
    ).collect()

    def wanted(url, t):
        m = re.match(r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
        if not m or t is None:
            return False, None
        host, path = m[1].lower().rstrip("."), re.match(r"^[a-z]+://[^/?#]*/*([^?#]*)", url)[1]
        labels, steps = host.split("."), [s for s in path.split("/") if s]
        keys = [f"p:{host}/{'/'.join(steps[:i])}" for i in range(len(steps), 0, -1)] + [f"d:{'.'.join(labels[i:])}" for i in range(len(labels))]
        for k in keys:
            now = [(e[2], e[1]) for e in entries if e[0] == k and e[1] and e[2] and e[2] <= t]
            if now:
                return max(now)[1] == "block", k
        return False, None

    assert len(got) == len(captures)
    for r in got:
        _, url, t, _ = next(c for c in captures if c[0] == r.id)
        assert (r.blocked, r.rule) == wanted(url, t), r


def test_urls_empty(spark):
    none = spark.createDataFrame([], "rule string, action string, listed_at timestamp")
    some = spark.createDataFrame([(1, "http://a/", at(1))], "id long, url string, fetched_at timestamp")
    assert [tuple(r) for r in filter_urls(some, none).collect()] == [(1, "http://a/", at(1), False, None, None)]
    assert filter_urls(some.limit(0), none).count() == 0


def test_mixing_edges(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(200)] + [(None, "x y", None), (None, "x y", None), (7, None, "a"), (8, "", "a"), (9, "z " * 500, "rare")]
    docs = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], DOCS + ", size long, target string").select("*", "size")
    docs = docs.drop("size").withColumn("u", docs["target"])
    out = mix_to_targets(docs).collect()
    again = mix_to_targets(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    assert all(r.taken == r.copies * r["size"] <= 3 * r["size"] for r in out)
    total = sum(r["size"] for r in out)
    assert abs(sum(t for _, t in {(r.source, r.target) for r in out}) - total) < 1e-6
    for s in "ab":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5
    assert {r.target for r in out if r.source is None} == {12.0} and sum(r.taken for r in out if r.source is None) == 12
    assert mix_to_targets(docs.limit(0)).count() == 0
    copies = mix_copies(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in out)


def test_mixing_importance(spark):
    docs = spark.createDataFrame([(i, "one two", "s", 1.0 if i % 2 else 3.0) for i in range(4000)], DOCS + ", a double")
    out = mix_to_targets(docs, share=0.25, importance="a").toPandas()
    n = out.groupby("a").copies.sum()
    assert abs(out.taken.sum() - 2000) <= 2 and 2.6 < n[3.0] / n[1.0] < 3.5


def store(spark, **options):
    return ShardStore(spark, f"{shared_dir(spark)}/test-{uuid.uuid4().hex}", **options)


def test_shards(spark):
    s = store(spark, target_bytes=1 << 20, fanout=3, small_bytes=1 << 10)
    assert s.version() == 0 and s.manifest().count() == 0
    with pytest.raises(ValueError):
        s.read()
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else f"t{i}" * 9, "s") for i in range(300)] + [(1, "twice", None)] * 2, DOCS).withColumn("file", DOCS_LIT(spark))
    for k in range(7):
        s.append(docs.where(f"coalesce(doc_id, 0) % 7 = {k}").coalesce(2))
        before = s.read().exceptAll(s.read(s.version())).count()
        s.compact()
        assert before == 0 and not s.due(s.manifest())
    s.append(docs.limit(0))
    assert s.read().exceptAll(docs).count() == 0 and docs.exceptAll(s.read()).count() == 0
    files = s.manifest().count()
    assert s.manifest().agg({"files": "sum"}).first()[0] < 9 and s.manifest().agg({"rows": "sum"}).first()[0] == 302
    old = s.read(2).count()
    assert 0 < old < 302
    s.vacuum()
    assert s.read().count() == 302 and s.manifest().count() == files


def DOCS_LIT(spark):
    from pyspark.sql import functions as F

    return F.lit("a column called file")


def test_two_writers(spark):
    s = store(spark)
    s.append(spark.range(3))
    rows = s._write(spark.range(4), 2)
    s.append(spark.range(5))
    with pytest.raises(Conflict):
        s._commit(2, s.schema(1), rows)
    assert s.read().count() == 8


def test_columns_come_go_and_widen(spark):
    s = store(spark, fanout=2, small_bytes=1 << 10, target_bytes=1 << 20)
    s.append(spark.createDataFrame([(1, 1.5)], "id int, x float").coalesce(1))
    s.append(spark.createDataFrame([(5 << 40, "b", 2.25)], "ID long, b string, x double").coalesce(1))
    s.append(spark.createDataFrame([("c",)], "b string").coalesce(1))
    want = [(1, 1.5, None), (5 << 40, 2.25, "b"), (None, None, "c")]
    for _ in range(2):
        got = s.read()
        assert got.dtypes == [("id", "bigint"), ("x", "double"), ("b", "string")] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        s.compact()
        s.vacuum()
    before = s.version(), len(s._names("data"))
    with pytest.raises(SchemaConflict):
        s.append(spark.createDataFrame([("1",)], "id string"))
    assert (s.version(), len(s._names("data"))) == before and s.read(s.version()).count() == 3


def test_manifests_over_many_versions(spark, monkeypatch):
    monkeypatch.setattr("stripelore.llm.sharding.WHOLE", 3)
    s = store(spark, fanout=3, small_bytes=1 << 10, target_bytes=1 << 20)
    for k in range(8):
        s.append(spark.range(k, k + 1).coalesce(1))
        s.compact()
        assert s.read().count() == k + 1
    assert s.read(2).count() == 2
    s.vacuum(2)
    assert s.read().count() == 8 and s.read(s.version() - 1).count() in (7, 8)

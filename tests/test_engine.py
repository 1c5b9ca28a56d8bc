import gzip
import html
import json
import math
import re

import numpy as np
import pytest
from conftest import rows

from tempora import engine, queries
from tempora.functions import gamma
from tempora.functions import text as T
from tempora.operators import index
from tempora.plans import retrieval as R
from tempora.sources import tables
from tempora.streaming import ingest

SOME = [
    "scan_statuses", "term_stats", "coll_stats", "shard_stats", "bool_query", "lang_filter", "epoch_range", "strip_patterns", "entity_type", "bm25", "search", "topk_search", "qrels_rerank", "recency_rerank", "kde_score", "kde_bandwidth", "select_ranks", "select_topics", "select_crcslogexp",
    "shard_topic_search", "feedback_search", "mf_search", "rmts_features", "ltr_rank", "taily_build", "taily_all", "wiki_search", "wiki_feedback", "stream_archive", "stream_index",
]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(duck.execute(queries.ORACLES[name]).fetchdf())
    assert len(got) > 0


def test_index_scan_is_whole(spark, sf_dir, duck):
    got = queries.QUERIES["scan_index"](spark, sf_dir).toPandas()
    assert rows(got) == rows(duck.execute(queries.ORACLES["scan_index"]).fetchdf())
    assert set(got.term) == {r.term for r in queries.QUERIES["term_stats"](spark, sf_dir).collect()}


def test_term_ranges_skip_files(spark, sf_dir):
    """A range of terms lies in few files of the postings, and its bounds reach the scan."""
    found = index.of(spark, sf_dir)["postings"].where("term >= 'th' and term < 'ti'")
    assert {r.term for r in found.select("term").distinct().collect()} == {r.term for r in index.of(spark, sf_dir)["term_stats"].where("term like 'th%'").collect()}
    assert "GreaterThanOrEqual(term,th)" in found._jdf.queryExecution().toString() and "LessThan(term,ti)" in found._jdf.queryExecution().toString()


def test_texts_move_once_to_their_times(spark, sf_dir):
    """However large events are, the join of statuses sends texts through one exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = tables.statuses(spark, sf_dir)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", told)
    assert len(moved) >= 3 and sum("text#" in x for x in moved) == 1


def test_index_deals_by_size(spark, sf_dir, tmp_path, monkeypatch):
    """A session of one partition doesn't put all documents, or all their postings, in one task."""
    monkeypatch.setattr(tables, "PIECE", 1 << 15, raising=False)
    wanted = {"spark.sql.shuffle.partitions": "1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        index.build(tables.statuses(spark, sf_dir), str(tmp_path / "index"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name in ("statuses", "vectors", "postings"):
        assert len(list((tmp_path / "index" / name).glob("part-*"))) > 4, name
    assert rows(index.read(spark, str(tmp_path / "index"))["postings"].toPandas()) == rows(index.of(spark, sf_dir)["postings"].toPandas())


def test_index_counts_rows_of_one_document_together(spark, tmp_path):
    """Rows of one id add up by name, lengths over all names; rows without words leave no posting."""
    made = [(1, "A", "x y x", 5), (1, "a", "Y z", 6), (1, "b", "x", 5), (2, None, "q q", 1), (3, "c", None, 2), (4, "c", "", 2), (5, "c", "-- !", 3), (6, "d", "b a c a b a", 9)]
    statuses = spark.createDataFrame(made, "id bigint, screen_name string, text string, epoch bigint")
    index.build(statuses, str(tmp_path / "index"))
    found = index.read(spark, str(tmp_path / "index"))
    wanted = {(1, "a", "x", 2, 6), (1, "a", "y", 2, 6), (1, "a", "z", 1, 6), (1, "b", "x", 1, 6), (2, None, "q", 2, 2), (6, "d", "a", 3, 6), (6, "d", "b", 2, 6), (6, "d", "c", 1, 6)}
    for name in ("postings", "vectors"):
        got = [(r.id, r.screen_name, r.term, r.tf, r.dl) for r in found[name].collect()]
        assert len(got) == len(wanted) and set(got) == wanted, name
    assert found["statuses"].count() == len(made) and {(r.id, r.screen_name, r.dl, r.dt, r.mt) for r in found["doclen"].collect()} == {(1, "a", 5, 3, 2), (1, "b", 1, 1, 1), (2, None, 2, 1, 2), (6, "d", 6, 3, 3)}


def test_sample_is_even(spark, sf_dir):
    ids = index.of(spark, sf_dir)["statuses"].select("id")
    n = ids.count()
    for rate in (0.25, 0.5):
        assert abs(ids.where(R.sampled("id", rate)).count() / n - rate) < 0.12
    assert ids.where(R.sampled("id", 0.25)).subtract(ids.where(R.sampled("id", 0.5))).count() == 0
    assert engine.Engine(spark, sf_dir, sample_rate=0.5).select("thing").count() > 0


def test_entry_lists_all():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_gamma():
    assert np.allclose(gamma.upper(np.array([1.0, 1.0, 2.0]), np.array([0.5, 3.0, 2.0])), [math.exp(-0.5), math.exp(-3), 3 * math.exp(-2)])
    k, q = np.array([0.3, 1, 5, 80.0, 400.0]), np.array([0.9, 0.5, 0.01, 0.2, 0.999])
    assert np.allclose(gamma.upper(k, gamma.upper_inverse(k, q)), q, atol=1e-9)
    mean, var, hits, every = np.array([3.0, 2.0]), np.array([1.0, 0.5]), np.array([5, 9]), np.array([4.0, 6.0])
    cut = gamma.upper_inverse(np.array([2.5**2 / 0.8]), np.array([0.5]))[0] * 0.8 / 2.5
    want = every * gamma.upper(mean**2 / var, cut * mean / var)
    assert np.allclose(gamma.taily_raw(mean, var, hits, every, (2.5, 0.8, 10.0), 5.0), want) and 0 < want.sum() < 10
    assert gamma.taily_raw(mean, var, hits, every, (2.5, 0.0, 10.0), 5.0).tolist() == [5, 9]
    assert gamma.taily_raw(mean, var, hits, every, (2.5, 0.8, 0.0), 5.0).tolist() == [3, 2]
    assert gamma.taily_raw(mean, np.zeros(2), hits, every, (2.5, 0.8, 10.0), 5.0).tolist() == [3, 2]


def test_engine_methods(spark, sf_dir):
    e = engine.Engine(spark, sf_dir)
    found = e.search("thing ention^2 ster", limit=10).collect()
    assert [r.j for r in found] == list(range(1, len(found) + 1)) and all(a.rsv >= b.rsv for a, b in zip(found, found[1:]))
    assert e.search("thing", max_id=50).filter("id > 50").count() == 0
    weights = e.wiki_vector().agg({"w": "sum"}).first()[0]
    assert abs(weights - 1) < 1e-6
    taily = e.taily(v=0.0).collect()
    assert all(r.score >= 0 for r in taily)
    assert e.feedback("thing", 10, fb_docs=0).count() == e.search("thing", 10).count()
    assert {r.id for r in e.feedback("thing", 10, rerank_only=True).collect()} == {r.id for r in e.search("thing", 10).collect()}
    assert abs(e.bootstrap_vector().agg({"w": "sum"}).first()[0] - 1) < 1e-6
    assert e.select("thing", "taily", v=0.0).count() > 0 and e.wiki_feedback("thing", 5).count() > 0
    assert e.rmts("thing", 1706572800, 5).count() <= 5 and e.select_search("thing", 20).count() <= 60
    with pytest.raises(ValueError):
        e.search("-thing")


def test_engine_options(spark, sf_dir, tmp_path):
    e = engine.Engine(spark, sf_dir)
    plain = e.multi_feedback("thing ention", 50, max_mean_tf=None)
    assert 0 < plain.count() <= 50
    timed = e.multi_feedback("thing ention", 50, query_epoch=1706572800, model={"f1": 1.0, "f21": 2.0}, max_mean_tf=None)
    assert [r.r for r in timed.orderBy("r").collect()] == list(range(1, timed.count() + 1))
    assert e.multi_feedback("thing", 20, shard="t1", fb_merge=True).count() > 0 and e.multi_feedback("thing", 20, selected=False).count() > 0
    assert e.feedback("thing", 5, min_df=3, min_len=4, max_len=9, stop=frozenset({"thing", "it's"})).count() == 5
    assert e.rmts("thing", 1706572800, 5, max_mean_tf=None).count() == 5
    with gzip.open(tmp_path / "stats.gz", "wt") as f:
        f.write("all\t1000\t50000\nthing\t30\t70\nster\t2\t3\n")
    other = engine.Engine(spark, sf_dir, statistics=str(tmp_path / "stats.gz"))
    found = other.trec_search("thing ster").collect()
    assert {r.total_hits for r in found} == {32} and {r.id for r in found} == {r.id for r in e.search("thing ster", 3000).collect()}
    assert {r.rsv for r in found} != {r.rsv for r in e.search("thing ster", 3000).collect()}
    best = e.search("thing", 20)
    assert engine.Engine.rerank(best).count() == 20 and engine.Engine.rerank(best, lambda d: d.where("j <= 10"), lambda d: d.limit(3)).count() == 3


def test_noise_is_no_feedback(spark):
    p = R.Plan()
    text = R.feedback_vector(p, "fv", "s") and p.steps["fv_tf"]
    terms = spark.createDataFrame([(1, t, 1, 5) for t in ("#tág", "@bob", "a/b", "é", "rt", "word")], "id int, term string, tf int, dl int")
    docs = spark.createDataFrame([(1, 1.0)], "id int, pr double")
    got = spark.sql("WITH fv_docs AS (SELECT * FROM {docs}) " + text, vectors=terms, docs=docs)
    assert sorted(r.term for r in got.collect()) == ["#tág", "word"]


def test_poll_and_decode(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(_status(1))
    q = ingest.poll(tables.flatten(ingest.read_json(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c"), "1 second")
    q.processAllAvailable()
    (tmp_path / "in/b.json").write_text(_status(2))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    assert [r[0] for r in spark.createDataFrame([("a%20b",), ("%zz",)], "q string").select(T.url_decode(engine.F.col("q"))).collect()] == ["a b", None]


def test_boolean(spark):
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "two three", "de"), (3, "three two", None)], "id int, text string, lang string")
    ids = lambda q: sorted(r.id for r in docs.where(engine.parse(q).condition()).collect())
    assert ids("one OR two") == [1, 2, 3] and ids("+two -one") == [2, 3] and ids("one AND two") == [1]
    assert ids('"two three"') == [1, 2] and ids("thr*") == [1, 2, 3] and ids("lang:de") == [2] and ids("(one OR lang:de) AND two") == [1, 2]
    assert ids("id:[2 TO 3]") == [2, 3] and ids("thre~1") == [1, 2, 3] and ids("NOT one") == [2, 3]
    with pytest.raises(ValueError):
        engine.parse("(one")


@pytest.mark.parametrize(("text", "span"), [("5", (0, 5)), ("5:", (5, engine.MAX)), ("5:9", (5, 9)), (":9", (0, engine.MAX)), ("x", (0, engine.MAX))])
def test_epochs(text, span):
    assert engine.parse_epochs(text) == span


def test_time_filter():
    assert R.time_filter(5, (1, 2), True) == "1 = 1" and "BETWEEN 0 AND 5" in R.time_filter(5, (1, 2)) and "epoch" in R.time_filter(None, (0, 2)) and R.time_filter(None, (0, 0)) == "1 = 1"


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "stats.gz", "wt") as f:
        f.write("all\t100\t5000\nrun\t3\t7\nbad line\nx\ty\t2\n")
    terms, totals = tables.term_statistics(spark, str(tmp_path / "stats.gz"))
    assert [tuple(r) for r in terms.collect()] == [("run", 3, 7)] and tuple(totals.first()) == (100, 5000)
    (tmp_path / "qrels").write_text("1 0 77 1\n1 0 78 -1\nbroken\n2 0 9 0\n")
    assert sorted(tuple(r) for r in tables.qrels(spark, str(tmp_path / "qrels")).collect()) == [("1", "77", 1), ("2", "9", 0)]
    (tmp_path / "stop").write_text("the\n\nof\n")
    assert tables.stop_words(spark, str(tmp_path / "stop")) == {"the", "of"}


def _status(i, geo=None):
    return json.dumps({"id": i, "created_at": "2024-01-01T01:00:00Z", "text": f"hello {i}", "lang": "en", "user": {"screen_name": "Bob", "friends_count": 1}, "geo": geo, "retweeted_status": {"id": 9, "retweet_count": 4, "user": {"id": 3}} if i == 2 else None})


def test_live(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([_status(1, {"lat": 1.0, "lon": 2.0}), _status(2), "{broken"]))
    batch = tables.json_statuses(spark, str(tmp_path / "in"))
    first = {r.id: r for r in batch.collect()}
    assert first[2].retweeted_status_id == 9 and first[2].retweeted_count == 4 and first[1].retweeted_status_id == 0 and first[1].screen_name == "bob"
    stream = tables.flatten(ingest.read_json(spark, str(tmp_path / "in")))
    sent = []
    ingest.broadcast(stream, lambda n, df: sent.append([json.loads(r.value) for r in df.collect()]), str(tmp_path / "c1"), geo_only=True).awaitTermination()
    assert [x["id_str"] for b in sent for x in b] == ["1"]
    ingest.into_index(stream, str(tmp_path / "idx"), str(tmp_path / "c2")).awaitTermination()
    assert rows(index.term_stats(spark.read.parquet(str(tmp_path / "idx"))).toPandas()) == rows(index.term_stats(index.postings(batch)).toPandas())


def test_compact(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "a"))
    index.compact(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("part-*"))) == 1 and spark.read.parquet(str(tmp_path / "b")).count() == 100


def test_texts_stay_out_of_python(spark):
    """Entities are blanked by Spark itself, and only references to characters are sent to Python to be unescaped."""
    texts = ["hi @bob/x http://t.co/x x.com/y #été #²x #12 ＃東京", "a &amp; b &lt &#65;&#x42; &notit; &bogus; &#xD800; caf&eacute;", "a." * 5000, "#" + "1" * 5000 + "x", None, "", "&", "no entity"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert "Python" not in df.select(T.blank_entities(df.text))._jdf.queryExecution().executedPlan().toString()
    sent = re.findall(r"(?:ArrowEvalPython|PythonUDF)[^\n]*", df.select(T.unescape_html(df.text))._jdf.queryExecution().optimizedPlan().toString())
    assert sent and all("array" in x or "regexp_extract_all" in x or "run(_" in x for x in sent) and not any("run(text" in x for x in sent)
    found = re.compile(rf"{T.URL}|{T.MENTION}|[#＃]\w*[^\W\d]\w*")
    for t, blank, plain in df.select("text", T.blank_entities(df.text), T.unescape_html(df.text)).collect():
        assert (blank, plain) == ((None, None) if t is None else (found.sub(lambda m: " " * len(m[0]), t), html.unescape(t)))


def test_text_keeps_length(spark):
    df = spark.createDataFrame([("hi @bob http://t.co/x #tag &amp; 5",), (None,), ("",)], "text string")
    got = [tuple(r) for r in df.select(T.blank_entities(df.text), T.clean(df.text)).collect()]
    assert len(got[0][0]) == len("hi @bob http://t.co/x #tag &amp; 5") and "@bob" not in got[0][0] and "&" in got[0][1] and "5" not in got[0][1]
    assert got[1] == (None, None) and got[2] == ("", "")

"""The registered queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora import engine, samples
from tempora.functions import text as T
from tempora.operators import index
from tempora.plans import retrieval as R
from tempora.plans import taily as Y
from tempora.plans import temporal as K
from tempora.plans.base import Plan, run
from tempora.sources import tables
from tempora.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The index tables as DuckDB makes them from the raw ones.
DUCK = {
    "statuses": """SELECT d.doc_id AS id, d.source AS screen_name, d.text, d.lang, CAST(floor(epoch(e.ts)) AS BIGINT) AS epoch,
        CAST(CASE WHEN e.event_type = 'signup' THEN d.doc_id + 1000000 ELSE 0 END AS BIGINT) AS retweeted_status_id,
        CAST(CASE WHEN e.event_type = 'view' THEN d.doc_id + 1 ELSE 0 END AS BIGINT) AS in_reply_to_status_id,
        CAST(floor(e.value) AS INT) AS followers_count, u.n AS statuses_count
        FROM documents d JOIN events e ON e.event_id = d.doc_id JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u ON u.user_id = e.user_id""",
    "words": "SELECT id, lower(screen_name) AS screen_name, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM statuses",
    "postings": "SELECT *, CAST(sum(tf) OVER (PARTITION BY id) AS BIGINT) AS dl FROM (SELECT id, screen_name, term, count(*) AS tf FROM words GROUP BY id, screen_name, term) x",
    "vectors": "SELECT * FROM postings",
    "doclen": "SELECT id, screen_name, CAST(sum(tf) AS BIGINT) AS dl, count(*) AS dt, max(tf) AS mt FROM postings GROUP BY id, screen_name",
    "term_stats": "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM postings GROUP BY term",
    "coll": "SELECT (SELECT count(*) FROM statuses) AS num_docs, count(*) AS num_terms, CAST(sum(df) AS BIGINT) AS sum_df, CAST(sum(ctf) AS BIGINT) AS sum_ctf FROM term_stats",
    "topics": "SELECT DISTINCT 't' || (CAST(substr(lower(screen_name), 4) AS INT) % 5) AS topic, lower(screen_name) AS source FROM statuses",
    "wiki": r"""SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS body, regexp_extract(url, '^[a-z]+://[^/]+/([^/]+)', 1) AS category FROM pages""",
    "samples": samples.SQL,
}
_NEEDS = {"words": ("statuses",), "postings": ("words",), "vectors": ("postings",), "doclen": ("postings",), "term_stats": ("postings",), "coll": ("statuses", "term_stats"), "topics": ("statuses",)}


def duck(text: str, frames: set[str]) -> str:
    wanted: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, ()):
            need(x)
        if name in DUCK and name not in wanted:
            wanted.append(name)

    for f in sorted(frames):
        need(f)
    body = text.format_map({f: f for f in frames})
    head = ", ".join(f"{n} AS MATERIALIZED ({DUCK[n]})" for n in wanted)
    if body.startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body


def plan(name: str) -> Callable:
    """Registers a function that makes a Plan, as a query and as its own twin."""

    def register(make: Callable[[], Plan]) -> Callable[[], Plan]:
        found = make()
        QUERIES[name] = lambda spark, sf_dir: run(spark, found, engine.frames(spark, sf_dir))
        ORACLES[name] = duck(found.text, found.frames)
        return make

    return register


def sql(name: str, text: str) -> None:
    plan(name)(lambda: Plan().then(text))


def pair(name: str, make: Callable[[SparkSession, str], DataFrame], twin: str | None = None, frames: set[str] = frozenset()) -> None:
    QUERIES[name] = make
    if twin:
        ORACLES[name] = duck(twin, set(frames))


# Scans, statistics

sql("scan_statuses", "SELECT id, screen_name, epoch, lang, retweeted_status_id, in_reply_to_status_id, followers_count, statuses_count, CAST(length(text) AS BIGINT) AS n FROM {statuses}")
sql("scan_index", "SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS tf FROM {postings} GROUP BY term")
sql("num_terms", "SELECT count(DISTINCT term) AS num_terms FROM {postings}")
sql("postings", "SELECT id, tf FROM {postings} WHERE term = 'thing'")
sql("term_stats", "SELECT term, df, ctf FROM {term_stats}")
sql("coll_stats", "SELECT num_docs, num_terms, sum_df, sum_ctf FROM {coll}")
sql("top_terms", "SELECT term, df, ctf FROM {term_stats} ORDER BY df DESC, term LIMIT 1000")
sql("qrels_scan", "SELECT '1' AS qid, CAST(doc_id AS VARCHAR(20)) AS docno, quality AS rel FROM {labels} WHERE quality >= 0")
sql("qrels_lookup", "SELECT s.id, coalesce(l.quality, -1) AS rel, sum(CASE WHEN l.quality > 0 THEN 1 ELSE 0 END) OVER () + 0e0 AS num_rel FROM {statuses} s LEFT JOIN {labels} l ON l.doc_id = s.id")
sql("norm_source", "SELECT DISTINCT lower(screen_name) AS source FROM {statuses}")
sql("source_union", "SELECT lower(screen_name) AS source FROM {statuses} UNION SELECT source FROM {topics}")
sql("user_timeline", "SELECT screen_name, count(DISTINCT id) AS n, greatest(1, max(id)) AS latest FROM {statuses} GROUP BY screen_name")
sql("shard_stats", "SELECT t.topic, t.source, count(*) AS n, max(count(*)) OVER () AS max_size, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM {doclen} l JOIN {topics} t ON t.source = l.screen_name GROUP BY t.topic, t.source")
sql("shard_rollup", "SELECT t.topic, t.source, count(*) AS n FROM {doclen} l JOIN {topics} t ON t.source = l.screen_name GROUP BY ROLLUP (t.topic, t.source)")
sql("doc_vectors", "SELECT id, count(*) AS terms, max(tf) AS most, CAST(sum(tf) AS BIGINT) AS n FROM {vectors} GROUP BY id")
sql("vec_norms", "SELECT id, CAST(sum(tf) AS DOUBLE) AS l1, round(sqrt(sum(tf * tf)), 9) AS l2 FROM {vectors} GROUP BY id")
sql("max_tf", "SELECT id FROM {doclen} WHERE mt < 5")
sql("mean_tf", "SELECT id, round(dl / (dt + 0e0), 9) AS mean FROM {doclen} WHERE dl < 3 * dt")

# Filters

sql("retweet_filter", f"SELECT id FROM {{statuses}} WHERE {R.NO_REPOST} UNION ALL SELECT id FROM {{samples}} WHERE upper(substr(text, 1, 3)) <> 'RT '")
sql("max_id", f"SELECT id FROM {{statuses}} WHERE {R.time_filter(max_id=500)}")
sql("epoch_range", f"SELECT id, epoch FROM {{statuses}} WHERE {R.time_filter(epochs=(1704100000, 1704200000))}")
sql("filter_precedence", " UNION ALL ".join(f"SELECT {i} AS request, count(*) AS n FROM {{statuses}} WHERE {R.time_filter(*a)}" for i, a in enumerate([(None, None, True), (300, (1704100000, 0)), (None, (1704100000, 1704200000)), (None, (0, 0)), (None, None)])))
sql("dedup_ids", "SELECT id, score FROM (SELECT id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC) AS i FROM (SELECT id, tf AS score FROM {postings} WHERE term IN ('the', 'thing', 'of')) x) y WHERE i = 1")
sql("shard_filter", "SELECT id FROM {statuses} WHERE lower(screen_name) IN ('src1', 'src3', 'src12')")
sql("filter_query", "SELECT s.id FROM {statuses} s JOIN (SELECT id FROM {postings} WHERE term IN ('thing', 'the') GROUP BY id HAVING count(*) = 2) p ON p.id = s.id")
sql("sort_docs", "SELECT id, tf FROM {postings} WHERE term = 'the' ORDER BY tf DESC, id DESC")


@plan("bool_query")
def _bool_query() -> Plan:
    """+thing -ster the^2 ention: what must, must not and may be there, and weights."""
    parsed = engine.parse("+thing -ster the^2 ention")
    must, never, terms = parsed.must, parsed.never, parsed.terms
    p = Plan().add("q", R.values([(t, w) for t, w in terms], "term, w"))
    p.add("hit", f"SELECT p.id, sum(q.w * p.tf) AS s, max(CASE WHEN p.term IN ({', '.join(map(repr, must))}) THEN 1 ELSE 0 END) AS has FROM {{postings}} p JOIN q ON q.term = p.term GROUP BY p.id")
    return p.then(f"SELECT id, s FROM hit WHERE has = 1 AND id NOT IN (SELECT id FROM {{postings}} WHERE term IN ({', '.join(map(repr, never))}))")


pair(
    "lang_filter",
    lambda s, d: _corpus(s, d).where(F.col("lang").isNull() | (F.col("lang") == "en") | F.regexp_replace("text", r"[\s\p{C}\p{Z}]", " ").rlike(r"^[\x00-\x7F]*$")).select("id"),
    r"SELECT id FROM (SELECT id, lang, text FROM {statuses} UNION ALL SELECT id, lang, text FROM {samples}) x WHERE lang IS NULL OR lang = 'en' OR regexp_matches(regexp_replace(text, '[\s\pC\pZ]', ' ', 'g'), '^[\x00-\x7F]*$')",
    {"statuses", "samples"},
)
pair("epoch_parse", lambda s, d: s.createDataFrame([(x, *engine.parse_epochs(x)) for x in ("5", "5:", "5:9", ":9", "x", "5 9")], "q string, lo bigint, hi bigint"), f"SELECT * FROM (VALUES ('5', CAST(0 AS BIGINT), CAST(5 AS BIGINT)), ('5:', 5, {engine.MAX}), ('5:9', 5, 9), (':9', 0, {engine.MAX}), ('x', 0, {engine.MAX}), ('5 9', 5, 9)) t(q, lo, hi)")
pair("epoch_day", lambda s, d: engine.frames(s, d)["statuses"].select("id", engine.day_start(F.col("epoch")).alias("lo"), (engine.day_start(F.col("epoch")) + 86399).alias("hi")), "SELECT id, epoch - epoch % 86400 AS lo, epoch - epoch % 86400 + 86399 AS hi FROM {statuses}", {"statuses"})

# Text


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal cases, then the statuses."""
    return samples.frame(spark).select("id", "lang", "text").unionAll(tables.statuses(spark, sf_dir).select("id", "lang", "text"))


_BOTH = "(SELECT id, lang, text FROM {samples} UNION ALL SELECT id, lang, text FROM {statuses}) x"


def _text(name: str, column: Callable, twin: str) -> None:
    pair(name, lambda s, d: _corpus(s, d).select("id", column(F.col("text")).alias("out")), f"SELECT id, {twin} AS out FROM {_BOTH}", {"samples", "statuses"})


def _swap(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, '{pattern}', ' ', 'g')"


_text("strip_numbers", T.strip_numbers, _swap("text", T.NUMBERS))
_text("strip_microsyntax", T.strip_microsyntax, _swap("text", T.MICROSYNTAX))
_text("strip_rt", T.strip_rt, _swap("text", T.RT))
_text("strip_via", T.strip_via, _swap("text", T.VIA))
_text("strip_patterns", T.strip_patterns, _swap(_swap(_swap("text", T.MICROSYNTAX), T.RT), T.VIA))
_text("strip_nonalnum", T.strip_nonalnum, r"regexp_replace(text, '[^\pL\d]', '', 'g')")
_text("abbreviate", T.abbreviate, "CASE WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END")
_text("extract_urls", lambda c: F.array_join(T.extract_urls(c), " "), "array_to_string(regexp_extract_all(text, '" + T.URL.replace("'", "''") + "'), ' ')")
_text("stop_apply", lambda c: T.stop_apply(c, engine.ENGLISH), f"array_to_string(list_filter(string_split(text, ' '), lambda w: w NOT IN ({', '.join(repr(w) for w in sorted(engine.ENGLISH))})), ' ')")
_text("tokens", lambda c: F.array_join(index.word_tokens(c), " "), "array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')")
_text("cache_key", lambda c: F.sha1(F.concat(F.lit("host:80:"), c, F.lit(":0:3000"))), "sha1('host:80:' || text || ':0:3000')")
_text("norm_qid", lambda c: F.regexp_replace(c, "^MB0*", ""), "regexp_replace(text, '^MB0*', '')")
_text("entity_type", lambda c: T.entity_type(F.element_at(F.split(c, " "), 1)), "CASE " + " ".join(f"WHEN regexp_full_match(split_part(text, ' ', 1), '{p}') THEN '{k}'" for k, p in (("url", T.URL.replace("'", "''")), ("mention", T.MENTION), ("hashtag", "[#＃][\\pL\\pN_]*[\\pL_][\\pL\\pN_]*"))) + " ELSE 'none' END")
pair(
    "entity_counts",
    lambda s, d: _corpus(s, d).select("id", *(T.count_of(F.col("text"), p).cast("bigint").alias(n) for n, p in (("urls", T.URL), ("mentions", T.MENTION), ("hashtags", "[#＃][A-Za-z0-9_]+")))),
    "SELECT id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {n}" for n, p in (("urls", T.URL.replace("'", "''")), ("mentions", T.MENTION), ("hashtags", "[#＃][A-Za-z0-9_]+"))) + f" FROM {_BOTH}",
    {"samples", "statuses"},
)
pair("stop_filter", lambda s, d: engine.frames(s, d)["postings"].where(~F.col("term").isin(*sorted(engine.ENGLISH))).groupBy("id").agg(F.count("*").alias("n")), f"SELECT id, count(*) AS n FROM {{postings}} WHERE term NOT IN ({', '.join(repr(w) for w in sorted(engine.ENGLISH))}) GROUP BY id", {"postings"})
for _name, _f in (("blank_entities", T.blank_entities), ("clean_text", T.clean), ("unescape_html", T.unescape_html)):
    pair(_name, lambda s, d, f=_f: _corpus(s, d).select("id", f(F.col("text")).alias("out")))
pair("analyze_tweet", lambda s, d: engine.analyze(_corpus(s, d)))

# Scores

_Q = lambda: (p := Plan(), R.query(p))[0]
_HIT = "FROM {postings} p JOIN q ON q.term = p.term JOIN {term_stats} t ON t.term = p.term JOIN {doclen} l ON l.id = p.id CROSS JOIN {coll} c"


def _score(name: str, formula: str) -> None:
    plan(name)(lambda: _Q().then(f"SELECT p.id, p.term, round({formula}, 9) AS score {_HIT}"))


_score("lm_dirichlet", "greatest(0e0, ln(1e0 + p.tf / (2500e0 * (t.ctf + 1e0) / (c.sum_ctf + 1e0))) + ln(2500e0 / (l.dl + 2500e0)))")
_score("indri_feature", "ln((p.tf + 2500e0 * t.ctf / c.sum_ctf) / (l.dl + 2500e0))")
_score("bm25", "ln((c.num_docs - t.df + 0.5e0) / (t.df + 0.5e0)) * ((1e0 + 0.1e0) * p.tf) / ((0.1e0 * ((1e0 - 0e0) + 0e0 * l.dl / 28e0) + p.tf) + p.tf)")
_score("idf", "ln((c.num_docs + 1e0) / (t.df + 1e0)) + 1e0")
_score("tf_variants", "CASE WHEN p.tf >= 1 THEN 1e0 ELSE 0e0 END + 1000e0 * (1e0 + ln(p.tf + 0e0))")
AT = 1706572800
sql("age_days", f"SELECT id, round(({AT}e0 - epoch) / 86400e0, 9) AS age FROM {{statuses}}")
sql("recency", f"SELECT id, round(0.01e0 * exp(-0.01e0 * ({AT}e0 - epoch) / 86400e0), 12) AS density FROM {{statuses}}")
sql("prune_terms", "SELECT term, round(w / sum(w) OVER (), 12) AS w FROM (SELECT term, ctf + 0e0 AS w FROM {term_stats} ORDER BY ctf DESC, term LIMIT 25) x")


def _search(name: str, final: str, **k: object) -> None:
    def make() -> Plan:
        p = _Q()
        R.search(p, "s", "q", **k)
        return p.then(final)

    plan(name)(make)


_RESULT = "SELECT id, screen_name, lang, epoch, rsv, CAST(j AS BIGINT) AS j FROM s"
_search("search", _RESULT)
_search("search_by_time", _RESULT, where=R.time_filter(epochs=(1704100000, 1704220000)), limit=100)
_search("topk_search", "SELECT id, score, CAST(i AS BIGINT) AS i FROM s_kept", limit=20)
_search("ql_search", _RESULT, limit=20)
_search("trec_search", "SELECT s.id, s.rsv, (SELECT CAST(CASE WHEN sum(df) > 0 THEN sum(df) ELSE max(n) END AS BIGINT) FROM s_df CROSS JOIN s_size) AS total_hits FROM s", limit=3000)
_search("rsv_prob", "SELECT id, round(CASE WHEN rsv >= 0 THEN rsv ELSE exp(rsv) END, 12) AS pr FROM s", limit=100)
_search("qrels_rerank", "SELECT s.id, round(s.rsv + 100e0 * coalesce(l.quality, -1), 6) AS rsv FROM s LEFT JOIN {labels} l ON l.doc_id = s.id", limit=100)


@plan("recency_rerank")
def _recency_rerank() -> Plan:
    p = _Q()
    K.recency(p, "r", K.ages(p, "a", R.search(p, "s", "q", limit=200), AT))
    return p.then("SELECT id, round(density, 9) AS density, round(recent, 6) AS rsv FROM r")


def _kde(name: str, kind: str, beta: float = 1.0, reflect: bool = True) -> None:
    def make() -> Plan:
        p = _Q()
        K.ages(p, "a", R.search(p, "s", "q", limit=200), AT)
        K.weights(p, "w", "a", kind)
        K.density(p, "k", "a", "w", reflect)
        return p.then(f"SELECT a.id, round(a.rsv + {beta!r}e0 * coalesce(k.f, 0e0), 6) AS rsv FROM a JOIN k ON k.id = a.id")

    plan(name)(make)


for _kind in ("uniform", "score", "rank"):
    _kde(f"kde_{_kind}", _kind)


@plan("kde_standard")
def _kde_standard() -> Plan:
    p = _Q()
    K.ages(p, "a", R.search(p, "s", "q", limit=40), AT)
    K.weights(p, "w", "a", "uniform")
    K.ages(p, "every", "{statuses}", AT)
    K.density(p, "k", "every", "w", False)
    return p.then("SELECT id, round(f, 9) AS f FROM k")


@plan("kde_reflect")
def _kde_reflect() -> Plan:
    p = _Q()
    K.ages(p, "a", R.search(p, "s", "q", limit=40), AT)
    K.weights(p, "w", "a", "score")
    K.ages(p, "every", "{statuses}", AT)
    K.density(p, "k", "every", "w", True)
    return p.then("SELECT id, round(f, 9) AS f FROM k")


@plan("kde_external")
def _kde_external() -> Plan:
    p = _Q()
    K.ages(p, "a", R.search(p, "s", "q", limit=200), AT)
    p.add("w", R.values([(1.0, 2.0), (4.0, 1.0), (8.5, 0.5), (21.0, 3.0)], "x, w"))
    K.density(p, "k", "a", "w")
    return p.then("SELECT a.id, round(a.rsv + coalesce(k.f, 0e0), 6) AS rsv FROM a JOIN k ON k.id = a.id")


@plan("kde_bandwidth")
def _kde_bandwidth() -> Plan:
    p = Plan()
    K.ages(p, "a", "{statuses}", AT)
    p.add("one", "SELECT x FROM a WHERE id = 1")
    K.bandwidth(p, "h", "a")
    K.bandwidth(p, "g", "a", 0.9)
    K.bandwidth(p, "o", "one")
    return p.then("SELECT round(h.h, 9) AS scott, round(g.h, 9) AS silverman, round(o.h, 9) AS single FROM h CROSS JOIN g CROSS JOIN o")


# Selection


def _hits(p: Plan, by_topic: bool = False, limit: int = 50) -> str:
    R.search(p, "c", "q", limit=max(limit, 50), sample=R.SAMPLE_RATE, reposts=True)
    return R.shard_hits(p, "hits", "c", by_topic, limit)


def _select(name: str, method: str, normalize: bool = False, by_topic: bool = False, max_col: int = 1000, min_ranks: float = 0.0, final: str = "SELECT shard, round(score, 6) AS score, CAST(r AS BIGINT) AS r FROM sel") -> None:
    def make() -> Plan:
        p = _Q()
        R.select(p, "sel", _hits(p, by_topic), method, normalize, max_col, min_ranks, by_topic)
        return p.then(final)

    plan(name)(make)


for _m in ("votes", "sizes", "crcslin", "crcsexp", "crcslogexp", "ranks"):
    _select(f"select_{_m}", _m)
_select("select_normalize", "crcsexp", True)
_select("select_ranks_norm", "ranks", True)
_select("select_topics", "ranks", True, True)
_select("select_limit", "ranks", True, max_col=3, min_ranks=1e-5)
_select("select_sources", "ranks", True, max_col=3)
_select("select_pipeline", "crcslin", True, True, 3)


@plan("selection_cost")
def _selection_cost() -> Plan:
    p = _Q()
    _hits(p)
    return p.then("SELECT (SELECT CAST(sum(df) AS BIGINT) FROM c_df) AS c_sel, (SELECT count(*) FROM c_first) AS total_hits, (SELECT count(DISTINCT shard) FROM hits) AS shards")


def _in_shards(name: str, by_topic: bool, final: str) -> None:
    def make() -> Plan:
        p = _Q()
        R.select(p, "sel", _hits(p, by_topic), "ranks", True, 3, 1e-5, by_topic)
        R.search(p, "s", "q", limit=300, reposts=True)
        R.within(p, "sh", "s", "sel", 100, by_topic)
        R.shard_cost(p, "cr", "q", "sel", by_topic)
        return p.then(final)

    plan(name)(make)


_in_shards("shard_search", False, "SELECT sh.id, sh.rsv, CAST(sh.k AS BIGINT) AS k, cr.c_r FROM sh CROSS JOIN cr")
_in_shards("shard_topic_search", True, "SELECT sh.id, sh.topic, sh.rsv, cr.c_r FROM sh CROSS JOIN cr")
_in_shards("select_search", True, "SELECT sh.id, sh.rsv, cr.c_r, (SELECT CAST(sum(df) AS BIGINT) FROM c_df) AS c_sel FROM sh CROSS JOIN cr")
plan("shard_cost")(lambda: (p := _Q(), R.shard_cost(p, "cr", "q", None), p.then("SELECT c_r FROM cr"))[-1])

# Feedback

_VECTOR = "SELECT term, round(w, 9) AS w FROM v"
plan("query_fv")(lambda: (p := Plan(), R.query(p, terms=(("thing", 1.0), ("of", 1.0), ("thing", 1.0))), R.query_vector(p, "v"), p.then(_VECTOR))[-1])


def _feedback(name: str, final: str) -> None:
    def make() -> Plan:
        p = _Q()
        R.search(p, "s", "q")
        R.feedback_vector(p, "fv", "s")
        R.interpolate(p, "v", R.query_vector(p), "fv")
        R.search(p, "again", "v", terms=None)
        return p.then(final)

    plan(name)(make)


_feedback("feedback_terms", "SELECT term, round(w, 9) AS w FROM fv")
_feedback("fv_interpolate", _VECTOR)
_feedback("fv_add", "SELECT term, round(sum(w), 9) AS w FROM (SELECT term, w FROM fv UNION ALL SELECT term, w FROM qv) x GROUP BY term")
_feedback("fv_norms", "SELECT round(sum(abs(w)), 9) AS l1, round(sqrt(sum(w * w)), 9) AS l2, count(*) AS n FROM v")
_feedback("fv_jaccard", "SELECT round(count(b.term) / ((SELECT count(*) FROM fv) + (SELECT count(*) FROM v) - count(b.term) + 0e0), 9) AS jaccard FROM fv a LEFT JOIN v b ON b.term = a.term")
_feedback("feedback_search", "SELECT id, rsv FROM again")
_feedback("fb_terms", "SELECT term, round(f, 9) AS f FROM fv_tf WHERE length(term) >= 3")
pair("build_query", lambda s, d: engine.frames(s, d)["term_stats"].orderBy(F.desc("ctf"), "term").limit(20).agg(F.sort_array(F.collect_list(F.struct((-F.col("ctf")).alias("o"), F.concat_ws("^", "term", F.col("ctf").cast("string")).alias("t")))).alias("x")).select(F.array_join(F.transform("x", lambda e: e["t"]), " ").alias("q")), "SELECT string_agg(term || '^' || ctf, ' ' ORDER BY ctf DESC, term || '^' || ctf) AS q FROM (SELECT * FROM {term_stats} ORDER BY ctf DESC, term LIMIT 20) x", {"term_stats"})


def _vertical(name: str, selected: bool, merge: bool = False) -> None:
    def make() -> Plan:
        p = _Q()
        if selected:
            R.select(p, "sel", _hits(p, True), "ranks", True, 3, 1e-5, True)
        R.search(p, "s", "q", reposts=True)
        R.within(p, "sh", "s", "sel" if selected else None, 50, True)
        p.add("shj", "SELECT id, rsv, row_number() OVER (ORDER BY rsv DESC, id DESC) AS j FROM sh")
        vector = R.feedback_vector(p, "fv", "shj")
        if merge:
            vector = R.interpolate(p, "mv", vector, R.feedback_vector(p, "cv", "s"))
        R.interpolate(p, "v", R.query_vector(p), vector)
        R.search(p, "again", "v", terms=None)
        return p.then("SELECT id, rsv FROM (" + K.mean_tf("again") + ") x")

    plan(name)(make)


_vertical("mf_search", True)
_vertical("mf_search_merged", True, True)
_vertical("shards_feedback", False)
pair("feedback_bootstrap", lambda s, d: engine.Engine(s, d).bootstrap_vector())

# Learning to rank


def _rmts(name: str, final: str) -> None:
    def make() -> Plan:
        p = _Q()
        R.select(p, "sel", _hits(p, True), "ranks", True, 3, 1e-5, True)
        R.search(p, "c2", "q", limit=300, reposts=True)
        R.within(p, "sh", "c2", "sel", 50, True)
        K.ages(p, "sha", "sh", AT)
        K.weights(p, "shw", "sha", "score")
        R.search(p, "s", "q", limit=200)
        K.features(p, "f", "s", "s", "shw", AT)
        K.rank(p, "ltr", "f", 100)
        return p.then(final)

    plan(name)(make)


_rmts("rmts_features", "SELECT id, " + ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(1, 22)) + " FROM f")
_rmts("ltr_rank", "SELECT id, score, CAST(r AS BIGINT) AS r FROM ltr")
_rmts("rmts_pipeline", "SELECT id, score FROM (" + K.mean_tf("ltr") + ") x")

# Taily


def _taily(name: str, final: str, by_topic: bool = False) -> None:
    def make() -> Plan:
        p = _Q()
        Y.build(p, by_topic, "q")
        Y.shard_sizes(p, by_topic)
        Y.features(p)
        Y.every(p)
        Y.gamma(p)
        return p.then(final)

    plan(name)(make)


def _taily_build() -> Plan:
    p = Plan()
    Y.build(p)
    return p.then("SELECT shard, term, df, round(f, 6) AS f, round(f2, 6) AS f2, round(m, 6) AS m FROM taily")


plan("taily_build")(_taily_build)
_taily("taily_sizes", "SELECT shard, n FROM taily_size")
_taily("taily_topic_sizes", "SELECT shard, n FROM taily_size", True)
_taily("taily_query_feats", "SELECT shard, round(mean, 6) AS mean, round(var, 6) AS var, hits FROM feats")
_taily("taily_all", "SELECT shard, round(any_n, 6) AS any_n, round(all_n, 6) AS all_n FROM alls")
_taily("taily_gamma", "SELECT shard, round(k, 6) AS k, round(theta, 6) AS theta FROM fit")
_taily("taily_degenerate", "SELECT f.shard, CASE WHEN c.var < 1e-10 THEN 'hits' WHEN z.all_n < 1e-10 OR f.var < 1e-10 THEN 'mean' ELSE 'gamma' END AS how FROM feats f CROSS JOIN (SELECT var FROM feats WHERE shard IS NULL) c CROSS JOIN (SELECT all_n FROM alls WHERE shard IS NULL) z WHERE f.shard IS NOT NULL")
pair("taily_rank", lambda s, d: engine.Engine(s, d).taily(v=0.0))
pair("taily_select", lambda s, d: engine.Engine(s, d).taily(v=10.0, by_topic=True))

# Encyclopedia

_WIKI_TOKENS = "regexp_extract_all(lower(body), '[a-z0-9]+')"
pair("facets", lambda s, d: engine.frames(s, d)["wiki"].groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(10), "SELECT category, count(*) AS n FROM {wiki} GROUP BY category ORDER BY n DESC, category LIMIT 10", {"wiki"})
_WIKI_CTE = f"""words AS (SELECT id, unnest({_WIKI_TOKENS}) AS term FROM wiki), post AS (SELECT id, term, count(*) AS tf FROM words GROUP BY id, term), len AS (SELECT id, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY id),
    stat AS (SELECT q.term, (coalesce(sum(p.tf), 0) + 1e0) / ((SELECT sum(dl) FROM len) + 1e0) AS p FROM (VALUES ('thing'), ('ention'), ('ster')) q(term) LEFT JOIN post p ON p.term = q.term GROUP BY q.term),
    cand AS (SELECT DISTINCT id FROM post WHERE term IN ('thing', 'ention', 'ster')),
    res AS (SELECT c.id, round(sum(ln((coalesce(p.tf, 0) + 2500e0 * s.p) / (l.dl + 2500e0))), 6) AS rsv FROM cand c CROSS JOIN stat s JOIN len l ON l.id = c.id LEFT JOIN post p ON p.id = c.id AND p.term = s.term GROUP BY c.id ORDER BY rsv DESC, c.id DESC LIMIT 50)"""
pair("wiki_search", lambda s, d: engine.Engine(s, d).wiki_search(), f"WITH wiki AS ({DUCK['wiki']}), {_WIKI_CTE} SELECT r.id, r.rsv, w.title, w.category, CASE WHEN length(w.body) > 500 THEN substr(w.body, 1, 497) || '...' ELSE w.body END AS summary FROM res r JOIN wiki w ON w.id = r.id")
pair(
    "wiki_feedback",
    lambda s, d: engine.Engine(s, d).wiki_vector(),
    f"""WITH wiki AS ({DUCK['wiki']}), {_WIKI_CTE}, pr AS (SELECT id, exp(rsv - max(rsv) OVER ()) AS pr FROM res), f AS (SELECT p.term, sum(p.tf * r.pr / l.dl) AS f FROM pr r JOIN post p ON p.id = r.id JOIN len l ON l.id = r.id GROUP BY p.term),
    w AS (SELECT f.term, round(f.f * (ln(((SELECT sum(dl) FROM len) + 1e0) / (t.ctf + 1e0)) + 1e0), 12) AS w FROM f JOIN (SELECT term, sum(tf) AS ctf FROM post GROUP BY term) t ON t.term = f.term), c AS (SELECT term, w FROM w ORDER BY w DESC, term LIMIT 20)
    SELECT term, round(w / sum(w) OVER (), 9) AS w FROM c""",
)

# Streams: what one pass over a stream leaves equals the batch


pair("build_index", lambda s, d: engine.frames(s, d)["postings"].groupBy("screen_name").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")), "SELECT screen_name, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM {postings} GROUP BY screen_name", {"postings"})
pair("stream_ingest", ingest.ingest_events, "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, user_id, event_type FROM events")
pair("stream_archive", ingest.archive_events, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d-%H') AS hour, CASE WHEN event_type = 'error' THEN 'warnings' ELSE 'statuses' END AS kind, count(*) AS n FROM events GROUP BY ALL")
pair("stream_index", ingest.index_stream, "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM {postings} GROUP BY term", {"postings"})
pair("stream_windows", ingest.window_counts, "SELECT CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")

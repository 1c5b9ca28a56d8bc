"""The engine: a method for each way to ask. All results are DataFrames; steps of few rows run at once, the rest on an action."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora import samples
from tempora.functions import analysis, gamma
from tempora.functions import text as T
from tempora.functions.analysis import ENGLISH
from tempora.operators import index
from tempora.operators.boolean import parse
from tempora.plans import retrieval as R
from tempora.plans import taily as Y
from tempora.plans import temporal as K
from tempora.plans.base import Plan, run
from tempora.sources import tables

__all__ = ["ENGLISH", "MAX", "Engine", "analyze", "day_start", "frames", "parse", "parse_epochs"]

MAX = (1 << 63) - 1


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The index tables over sf_dir and what plans read besides them."""
    return {**index.of(spark, sf_dir).frames, "labels": tables.table(spark, sf_dir, "labels"), "wiki": tables.wiki(spark, sf_dir), "samples": samples.frame(spark)}


def parse_epochs(text: str) -> tuple[int, int]:
    """'A' ends at A, 'A:' begins there, 'A:B' is a range (a blank serves too); anything else is all time."""
    parts = re.split("[: ]", text)
    if len(parts) == 1 and parts[0].isdigit():
        return 0, int(parts[0])
    if len(parts) == 2 and parts[0].isdigit() and (not parts[1] or parts[1].isdigit()):
        return int(parts[0]), int(parts[1]) if parts[1] else MAX
    return 0, MAX


def day_start(epoch: Column) -> Column:
    return epoch - F.pmod(epoch, F.lit(86400))


def analyze(docs: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """id and the terms of the analyzer for statuses."""
    return docs.select("id", analysis.analyzer(**options)(F.col(text)).alias("terms"))


class Engine:
    """Searches over one set of tables. Parameters have the defaults of the service that this replaces.

    sample_rate: the share of documents in the sample that resource selection searches, drawn by a hash of the id.
    statistics: a file of term statistics of another collection (see tables.term_statistics), which then take the place of
    the index's own in all scores.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, sample_rate: float = R.SAMPLE_RATE, statistics: str | None = None) -> None:
        self.spark, self.frames, self.sample_rate = spark, frames(spark, sf_dir), sample_rate
        if statistics:
            terms, totals = tables.term_statistics(spark, statistics)
            own = terms.agg(F.count("*").alias("num_terms"), F.sum("df").alias("sum_df"))
            self.frames |= {"term_stats": terms, "coll": totals.crossJoin(own).select("num_docs", "num_terms", "sum_df", "sum_ctf")}

    def _run(self, plan: Plan) -> DataFrame:
        return run(self.spark, plan, self.frames)

    @staticmethod
    def _plan(query: str) -> tuple[Plan, tuple]:
        terms = tuple(parse(query).terms)
        if not terms:
            raise ValueError("the query has no term")
        p = Plan()
        R.query(p, terms=terms)
        return p, terms

    def _where(self, max_id: int | None, epoch: str | None, future: bool) -> str:
        return R.time_filter(max_id, parse_epochs(epoch) if epoch else None, future)

    def search(self, query: str, limit: int = 1000, reposts: bool = False, max_id: int | None = None, epoch: str | None = None, future: bool = False) -> DataFrame:
        p, terms = self._plan(query)
        R.search(p, "s", "q", limit, self._where(max_id, epoch, future), reposts=reposts, terms=terms)
        return self._run(p.then("SELECT * FROM s"))

    def trec_search(self, query: str, limit: int = 1000, **k: object) -> DataFrame:
        """The best documents, 3,000 to 10,000 of them, with the total of hits that term statistics tell."""
        p, terms = self._plan(query)
        R.search(p, "s", "q", min(R.MOST, max(3000, limit)), self._where(k.get("max_id"), k.get("epoch"), bool(k.get("future"))), terms=terms)
        return self._run(p.then("SELECT s.*, (SELECT CAST(CASE WHEN sum(df) > 0 THEN sum(df) ELSE max(n) END AS BIGINT) FROM s_df CROSS JOIN s_size) AS total_hits FROM s"))

    @staticmethod
    def rerank(found: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """found through a cascade of rerankers; none leaves it as it is."""
        for step in steps:
            found = found.transform(step)
        return found

    def filter(self, query: str) -> DataFrame:
        """Statuses that a query with operators admits, unranked."""
        return self.frames["statuses"].where(parse(query).condition())

    def _selection(self, p: Plan, terms: tuple, method: str, limit: int, max_col: int, min_ranks: float, normalize: bool, by_topic: bool) -> str:
        R.search(p, "c", "q", limit, sample=self.sample_rate, reposts=True, terms=terms)
        return R.select(p, "sel", R.shard_hits(p, "hits", "c", by_topic, limit), method, normalize, max_col, min_ranks, by_topic, self.sample_rate)

    def select(self, query: str, method: str = "ranks", limit: int = 50, max_col: int = 3, min_ranks: float = 1e-5, normalize: bool = True, by_topic: bool = True, v: float = 10.0) -> DataFrame:
        """shard, score, r. The method taily needs no search; v is the least score that it returns."""
        if method.lower() == "taily":
            return self.taily(query, v, by_topic)
        p, terms = self._plan(query)
        self._selection(p, terms, method, limit, max_col, min_ranks, normalize, by_topic)
        return self._run(p.then("SELECT * FROM sel"))

    def select_search(self, query: str, limit: int = 1000, s_limit: int = 50, method: str = "ranks", max_col: int = 3, by_topic: bool = True) -> DataFrame:
        """Results within the selected shards, with the costs of selection (c_sel) and of search (c_r)."""
        p, terms = self._plan(query)
        self._selection(p, terms, method, s_limit, max_col, 1e-5, True, by_topic)
        R.search(p, "s", "q", limit, reposts=True, terms=terms)
        R.within(p, "sh", "s", "sel", limit, by_topic)
        R.shard_cost(p, "cr", "q", "sel", by_topic)
        return self._run(p.then("SELECT sh.*, cr.c_r, (SELECT sum(df) FROM c_df) AS c_sel FROM sh CROSS JOIN cr"))

    def feedback(self, query: str, limit: int = 1000, fb_docs: int = 50, fb_terms: int = 20, fb_weight: float = 0.5, rerank_only: bool = False, min_df: int = 0, min_len: int = 1, max_len: int = 0, stop: frozenset[str] = frozenset()) -> DataFrame:
        """A search whose query is mixed with terms of its own best results. Without feedback documents or terms it is
        the plain search. rerank_only scores the first results anew instead of searching again."""
        if not fb_docs or not fb_terms:
            return self.search(query, limit)
        p, terms = self._plan(query)
        R.search(p, "s", "q", limit, terms=terms)
        R.feedback_vector(p, "fv", "s", fb_docs, fb_terms, min_len, max_len, min_df, stop)
        R.interpolate(p, "v", R.query_vector(p), "fv", fb_weight, fb_terms)
        R.search(p, "again", "v", limit, terms=None)
        if rerank_only:
            p.add("old", "SELECT id, screen_name, text, lang, epoch FROM s").cut("old")
            p.add("anew_stat", "SELECT * FROM again_stat").add("anew_len", "SELECT * FROM again_len").add("anew_hit", "SELECT * FROM again_hit")
            R.rescore(p, "anew", "old", limit, f"{R.MU!r}e0")
            return self._run(p.then("SELECT * FROM anew"))
        return self._run(p.then("SELECT * FROM again"))

    def multi_feedback(self, query: str, limit: int = 1000, method: str = "ranks", fb_docs: int = 50, fb_terms: int = 20, fb_weight: float = 0.5, fb_cols: int = 3, fb_merge: bool = False, by_topic: bool = True, selected: bool = True, shard: str | None = None, query_epoch: int | None = None, beta: float = 1.0, model: dict[str, float] | None = None, max_mean_tf: int | None = 3) -> DataFrame:
        """Feedback from the results within selected shards (or the one named, or all); fb_merge mixes in feedback from all
        results. With query_epoch the results within shards are ranked by their density over time too; with a model the
        last results are ranked by it."""
        p, terms = self._plan(query)
        if shard:
            p.add("sel", f"{R.values([(shard.lower(), 1.0, 1)], 'shard, score, r')}")
        elif selected:
            self._selection(p, terms, method, 50, fb_cols, 1e-5, True, by_topic)
        R.search(p, "s", "q", limit, reposts=True, terms=terms)
        R.within(p, "sh", "s", "sel" if selected or shard else None, fb_docs, by_topic)
        at = R.LATEST if query_epoch is None else query_epoch
        K.weights(p, "shw", K.ages(p, "sha", "sh", at), "score")
        if query_epoch is None:
            p.add("shj", "SELECT id, rsv, row_number() OVER (ORDER BY rsv DESC, id DESC) AS j FROM sh")
        else:
            K.density(p, "shk", "sha", "shw")
            p.add("shr", f"SELECT a.id, round(a.rsv + {beta!r}e0 * coalesce(k.f, 0e0), 6) AS rsv FROM sha a LEFT JOIN shk k ON k.id = a.id")
            p.add("shj", "SELECT id, rsv, row_number() OVER (ORDER BY rsv DESC, id DESC) AS j FROM shr")
        p.cut("shw", "shj")
        vector = R.feedback_vector(p, "fv", "shj", fb_docs, fb_terms)
        if fb_merge:
            vector = R.interpolate(p, "mv", vector, R.feedback_vector(p, "cv", "s", fb_docs, fb_terms), 0.5, fb_terms)
        R.interpolate(p, "v", R.query_vector(p), vector, fb_weight, fb_terms)
        last = R.search(p, "again", "v", limit, terms=None)
        if model:
            K.features(p, "f", "again", "again", "shw", at)
            last = K.rank(p.cut("f_t"), "ltr", "f", limit, model)
        return self._run(p.then(K.mean_tf(last, max_mean_tf) if max_mean_tf else f"SELECT * FROM {last}"))

    def rmts(self, query: str, query_epoch: int, limit: int = 1000, method: str = "ranks", fb_docs: int = 50, fb_cols: int = 3, num_rerank: int = 1000, model: dict[str, float] | None = None, by_topic: bool = True, max_mean_tf: int | None = 3) -> DataFrame:
        """Results by a model over 21 features. query_epoch stands for the present."""
        p, terms = self._plan(query)
        self._selection(p, terms, method, 50, fb_cols, 1e-5, True, by_topic)
        R.search(p, "c2", "q", limit, reposts=True, terms=terms)
        R.within(p, "sh", "c2", "sel", fb_docs, by_topic)
        K.weights(p, "shw", K.ages(p, "sha", "sh", query_epoch), "score")
        R.search(p, "s", "q", num_rerank, terms=terms)
        K.features(p, "f", "s", "s", "shw", query_epoch)
        K.rank(p, "ltr", "f", limit, model)
        return self._run(p.then(K.mean_tf("ltr", max_mean_tf) if max_mean_tf else "SELECT * FROM ltr"))

    def taily(self, query: str = "thing ention ster", v: float = 10.0, by_topic: bool = False, n_c: float = 400.0) -> DataFrame:
        """shard, score: how many of the best n_c documents a shard is expected to have, at least v."""
        p, _ = self._plan(query)
        Y.build(p, by_topic, "q")
        Y.shard_sizes(p, by_topic)
        Y.features(p)
        Y.every(p)
        p.cut("every_shard").add("every_shard", "SELECT f.shard, f.mean, f.var, CAST(f.hits AS DOUBLE) AS hits, a.all_n FROM feats f JOIN alls a ON coalesce(a.shard, '') = coalesce(f.shard, '')")
        rows = self._run(p.then("SELECT s.*, c.mean AS c_mean, c.var AS c_var, c.all_n AS c_all FROM every_shard s CROSS JOIN (SELECT mean, var, all_n FROM every_shard WHERE shard IS NULL) c WHERE s.shard IS NOT NULL"))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    corpus = tuple(float(rows[c].iloc[0]) for c in ("c_mean", "c_var", "c_all"))
                    yield pd.DataFrame({"shard": rows["shard"], "raw": gamma.taily_raw(*(rows[c].to_numpy() for c in ("mean", "var", "hits", "all_n")), corpus, n_c)})

        raw = rows.mapInPandas(score, "shard string, raw double")
        scaled = raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("total")))).select("shard", F.when(F.col("total") > 0, F.col("raw") * n_c / F.col("total")).otherwise(F.col("raw")).alias("score"))
        return scaled.where(F.col("score") >= v).orderBy(F.desc("score"), "shard")

    def bootstrap_vector(self, query: str = "thing ention ster", samples: int = 30, fb_docs: int = 50, fb_terms: int = 20, seed: int = 1) -> DataFrame:
        """Feedback terms over bootstrap samples of the best documents, drawn by their probabilities."""
        p, terms = self._plan(query)
        R.search(p, "s", "q", terms=terms)
        docs = self._run(p.then(f"SELECT id, exp(rsv - max(rsv) OVER ()) AS pr FROM s WHERE j <= {fb_docs}"))
        total = docs.agg(F.sum("pr").alias("total"), F.count("*").alias("n"))
        # A document's draws in one sample are about Poisson with its expected number; summed over all samples.
        draw = F.pmod(F.xxhash64("id", "b", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        times = docs.crossJoin(F.broadcast(total)).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("mean", F.col("pr") / F.col("total") * F.col("n"))
        low, parts = F.lit(0.0), F.lit(0)
        term = F.exp(-F.col("mean"))
        for k in range(12):
            low = low + term
            parts = parts + F.when(draw >= low, 1).otherwise(0)
            term = term * F.col("mean") / (k + 1)
        drawn = times.groupBy("id").agg(F.sum(parts).alias("k"))
        f = self.frames
        weighed = F.broadcast(drawn).join(f["postings"], "id").groupBy("term").agg(F.sum(F.col("k") * F.col("tf") / F.col("dl")).alias("f"))
        idf = F.log((F.col("sum_ctf") + 1) / (F.col("ctf") + 1)) + 1
        best = weighed.join(f["term_stats"], "term").crossJoin(F.broadcast(f["coll"])).select("term", (F.col("f") * idf).alias("w")).orderBy(F.desc("w"), "term").limit(fb_terms)
        return best.crossJoin(F.broadcast(best.agg(F.sum("w").alias("s")))).select("term", (F.col("w") / F.col("s")).alias("w"))

    def top_terms(self, n: int = 100) -> DataFrame:
        return self.frames["term_stats"].orderBy(F.desc("df"), "term").limit(min(n, 1000))

    def shard_stats(self) -> DataFrame:
        f = self.frames
        return f["doclen"].join(F.broadcast(f["topics"]), F.col("screen_name") == F.col("source")).groupBy("topic", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"))

    # Encyclopedia

    def _wiki_index(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        wiki = self.frames["wiki"]
        post = wiki.select("id", F.explode(index.word_tokens(F.col("body"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        return wiki, post, post.groupBy("id").agg(F.sum("tf").alias("dl"))

    def _wiki_results(self, query: str, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        wiki, post, length = self._wiki_index()
        terms = [t for t, _ in parse(query).terms]
        hits = post.where(F.col("term").isin(terms))
        stats = self.spark.createDataFrame([(t,) for t in terms], "term string").join(hits.groupBy("term").agg(F.sum("tf").alias("ctf")), "term", "left").crossJoin(length.agg(F.sum("dl").alias("c")))
        stats = stats.select("term", ((F.coalesce("ctf", F.lit(0)) + 1.0) / (F.col("c") + 1.0)).alias("p"))
        scored = hits.select("id").distinct().crossJoin(F.broadcast(stats)).join(length, "id").join(hits, ["id", "term"], "left")
        rsv = F.round(F.sum(F.log((F.coalesce("tf", F.lit(0)) + R.MU * F.col("p")) / (F.col("dl") + R.MU))), 6)
        return scored.groupBy("id").agg(rsv.alias("rsv")).orderBy(F.desc("rsv"), F.desc("id")).limit(limit), post, length

    def wiki_search(self, query: str = "thing ention ster", limit: int = 50, full: bool = False) -> DataFrame:
        found, _, _ = self._wiki_results(query, limit)
        body = F.col("body") if full else T.abbreviate(F.col("body"))
        return F.broadcast(found).join(self.frames["wiki"], "id").select("id", "rsv", "title", "category", body.alias("summary"))

    def wiki_vector(self, query: str = "thing ention ster", fb_docs: int = 50, fb_terms: int = 20) -> DataFrame:
        """Expansion terms from the best encyclopedia entries."""
        found, post, length = self._wiki_results(query, fb_docs)
        pr = found.crossJoin(F.broadcast(found.agg(F.max("rsv").alias("best")))).select("id", F.exp(F.col("rsv") - F.col("best")).alias("pr"))
        f = F.broadcast(pr).join(post, "id").join(length, "id").groupBy("term").agg(F.sum(F.col("tf") * F.col("pr") / F.col("dl")).alias("f"))
        weighed = f.join(post.groupBy("term").agg(F.sum("tf").alias("ctf")), "term").crossJoin(F.broadcast(length.agg(F.sum("dl").alias("c"))))
        w = weighed.select("term", F.round(F.col("f") * (F.log((F.col("c") + 1.0) / (F.col("ctf") + 1.0)) + 1.0), 12).alias("w")).orderBy(F.desc("w"), "term").limit(fb_terms)
        return w.crossJoin(F.broadcast(w.agg(F.sum("w").alias("s")))).select("term", F.round(F.col("w") / F.col("s"), 9).alias("w"))

    def wiki_feedback(self, query: str, limit: int = 1000, fb_weight: float = 0.5, fb_terms: int = 20) -> DataFrame:
        """A search over statuses whose query is mixed with terms of encyclopedia entries."""
        p, _ = self._plan(query)
        p.add("wv", "SELECT term, w FROM {wiki_vector}")
        R.interpolate(p, "v", R.query_vector(p), "wv", fb_weight, fb_terms)
        R.search(p, "again", "v", limit, terms=None)
        return run(self.spark, p.then("SELECT * FROM again"), {**self.frames, "wiki_vector": self.wiki_vector(query, fb_terms=fb_terms)})

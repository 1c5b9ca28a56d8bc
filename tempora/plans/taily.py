"""Taily: selection from vocabulary statistics of shards. The gamma functions are in tempora.functions.gamma."""

from __future__ import annotations

from .base import Plan
from .retrieval import MU


def build(p: Plan, by_topic: bool = False, terms: str | None = None) -> None:
    """taily: shard, term, df, f, f2, m of the language-model score; the length of a document is its distinct terms."""
    n = f"{MU!r}e0"
    shard = "o.topic" if by_topic else "o.source"
    only = f"JOIN {terms} q ON q.term = p.term" if terms else ""
    p.add("taily_f", f"SELECT p.term, {shard} AS shard, ln((p.tf + {n} * t.ctf / c.sum_ctf) / (l.dt + {n})) AS f FROM {{postings}} p {only} JOIN {{term_stats}} t ON t.term = p.term CROSS JOIN {{coll}} c JOIN {{doclen}} l ON l.id = p.id JOIN {{topics}} o ON o.source = p.screen_name")
    p.add("taily", "SELECT shard, term, count(*) AS df, sum(f) AS f, sum(f * f) AS f2, min(f) AS m FROM taily_f GROUP BY shard, term")


def shard_sizes(p: Plan, by_topic: bool = False) -> None:
    shard = "t.topic" if by_topic else "t.source"
    p.add("taily_size", f"SELECT {shard} AS shard, count(*) AS n FROM {{doclen}} l JOIN {{topics}} t ON t.source = l.screen_name GROUP BY {shard}")


def features(p: Plan) -> None:
    """feats: shard (null: all of them), mean and variance of a document's score, each term shifted by its least."""
    p.add("taily_pool", "SELECT * FROM taily UNION ALL SELECT CAST(NULL AS VARCHAR(9)) AS shard, term, sum(df) AS df, sum(f) AS f, sum(f2) AS f2, min(m) AS m FROM taily GROUP BY term")
    p.add("taily_low", "SELECT term, min(m) AS low FROM taily GROUP BY term")
    p.add("feats", "SELECT x.shard, sum(x.f / x.df - y.low) AS mean, sum(greatest(0e0, x.f2 / x.df - power(x.f / x.df, 2))) AS var, CAST(sum(x.df) AS BIGINT) AS hits FROM taily_pool x JOIN taily_low y ON y.term = x.term GROUP BY x.shard")


def every(p: Plan, q: str = "q") -> None:
    """alls: how many documents of a shard have any of the terms, and all, if terms were independent."""
    p.add("taily_scope", "SELECT shard, n FROM taily_size UNION ALL SELECT CAST(NULL AS VARCHAR(9)) AS shard, sum(n) AS n FROM taily_size")
    p.add("taily_df", f"SELECT s.shard, s.n, x.term, coalesce(t.df, 0) AS df FROM taily_scope s CROSS JOIN (SELECT DISTINCT term FROM {q}) x LEFT JOIN taily_pool t ON t.term = x.term AND coalesce(t.shard, '') = coalesce(s.shard, '')")
    p.add("taily_any", "SELECT shard, max(n) AS n, max(n) * (1e0 - CASE WHEN min(1e0 - df / (n + 0e0)) <= 0 THEN 0e0 ELSE exp(sum(ln(CASE WHEN df >= n THEN 1e0 ELSE 1e0 - df / (n + 0e0) END))) END) AS any_n FROM taily_df GROUP BY shard")
    p.add("alls", "SELECT a.shard, max(a.n) AS n, max(a.any_n) AS any_n, CASE WHEN max(a.any_n) <= 0 OR min(d.df) = 0 THEN 0e0 ELSE max(a.any_n) * exp(sum(ln(CASE WHEN d.df = 0 THEN 1e0 ELSE d.df / CASE WHEN a.any_n <= 0 THEN 1e0 ELSE a.any_n END END))) END AS all_n FROM taily_any a JOIN taily_df d ON coalesce(d.shard, '') = coalesce(a.shard, '') GROUP BY a.shard")


def gamma(p: Plan) -> None:
    p.add("fit", "SELECT shard, mean, var, hits, CASE WHEN var >= 1e-10 THEN mean * mean / var END AS k, CASE WHEN var >= 1e-10 THEN var / CASE WHEN mean = 0 THEN 1e0 ELSE mean END END AS theta FROM feats")
